"""Packing by concatenate and cut: documents one after the other, cut into windows of fixed length.

Pass 1 encodes every document once and writes the ids with their offset inside the partition. The
partitions' totals (one row per partition) give each partition its global offset by a prefix sum. Pass 2
cuts: a document's ids are split where a multiple of the sequence length falls, so a document that
crosses a border leaves one piece on each side. No text is shuffled, and only the last sequence has room left.

Null text is an empty document (its end id only). Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corredor.llm.tokens import encoder, tokenizer_path
from corredor.llm.util import strings, written


#: Partitions of the input up to which their offsets are broadcast; beyond it the ids join by shuffle.
MOST_PARTS = 1_000_000


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(part, at, n, doc_id, ids): ids little-endian, two bytes each where the vocabulary allows; ``at`` within the part."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = strings(batch.column(1)).to_pylist()
            for lo in range(0, len(texts), 500):
                ids, places, counts = [], [], []
                for text in texts[lo : lo + 500]:
                    own = np.append(enc.encode(text), np.uint32(end_id))
                    ids.append(own.astype("<u2" if own.max() < 65536 else "<u4").tobytes())
                    places.append(at)
                    counts.append(len(own))
                    at += len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(counts, pa.int64()),
                        batch.column(0).slice(lo, 500), pa.array(ids, pa.binary()),
                    ],
                    ["part", "at", "n", "doc_id", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(encode, f"part int, at long, n long, doc_id {kind}, ids binary")


def pack(docs: DataFrame, length: int = 1024, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    stored = written(encoded(docs, path or tokenizer_path(), end_id), "packing-ids", compression="zstd")
    totals = stored.groupBy("part").agg(F.sum("n").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    if totals.count() <= MOST_PARTS:
        offsets = F.broadcast(offsets)  # one row of 12 bytes per partition of the input
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches):
        for batch in batches:
            ids = batch.column(3)
            first, counts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo in range(0, len(ids), 500):
                doc, rows = [], []
                for i in range(lo, min(lo + 500, len(ids))):
                    raw, n, g = ids[i].as_py(), int(counts[i]), int(first[i])
                    own = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                    edges = [0, *range(length - g % length, n, length), n]
                    for a, b in zip(edges, edges[1:]):
                        doc.append(i)
                        rows.append((a, b - a, n, (g + a) // length, (g + a) % length, own[a:b].tobytes()))
                columns = zip(*rows) if rows else [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names
                )

    return (
        stored.join(offsets, "part")
        .select("doc_id", (F.col("at") + F.col("base")).alias("at"), "n", "ids")
        .mapInArrow(cut, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    )


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the pieces of a sequence in order; padded to ``length`` except where the
    number of tokens is a power of two. A sequence holds at most ``length`` ids, so grouping is bounded."""
    joined = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")
    )
    hexed = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    pad = F.when(F.expr("bit_count(n_tokens) = 1"), 0).otherwise(length - F.col("n_tokens"))
    one = F.lit(pad_id.to_bytes(4, "little").hex())
    return joined.select("sequence_id", "n_tokens", F.unhex(F.concat(hexed, F.repeat(one, pad.cast("int")))).alias("ids"))
