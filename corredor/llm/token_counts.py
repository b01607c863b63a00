"""Token counts by a two-tier lookup on the map side: no pre-token is ever shuffled.

First tier: a broadcast table of the frequent pre-tokens' lengths, at most ``FREQUENT`` entries. It comes
from one pass over all documents in which each task keeps a bounded frequency summary (Misra-Gries
counters of its words) and passes on its ``SUMMARY`` most frequent words. Second tier: the worker's
bounded cache; a miss is encoded once. The tiers change the speed only, never a count.

Null text counts as empty (0 tokens); repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.llm.tokens import PIECES, encoder, tokenizer_path
from corredor.llm.util import strings

FREQUENT = 16_384
SUMMARY = 1_024
COUNTERS = 65_536


def _summaries(batches):
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in strings(batch.column(0)).to_pylist():
            counts.update(text.split(" "))
            if len(counts) > COUNTERS:  # all counters lose the same amount, the small ones go
                cut = sorted(counts.values(), reverse=True)[COUNTERS // 4]
                counts = Counter({w: n - cut for w, n in counts.items() if n > cut})
    top = [x for x in counts.most_common(SUMMARY) if len(x[0]) <= 64]
    yield pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """Lengths of the pre-tokens of the most frequent words; at most ``FREQUENT`` words reach the driver."""
    words = docs.select("text").mapInArrow(_summaries, "word string, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT)
    enc, out = encoder(path), {}
    for row in top.collect():
        for spelled in (row["word"], f" {row['word']}"):
            if enc.plain(spelled):
                out.update((piece, enc.lengths[piece]) for piece in PIECES.findall(spelled))
    return out


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens."""
    path = path or tokenizer_path()
    known = {} if path.endswith(".model") else frequent_lengths(docs, path)
    table = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        enc = encoder(path)
        enc.learn(table.value)
        for batch in batches:
            texts = strings(batch.column(1)).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(map(enc.count, texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
