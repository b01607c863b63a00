"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

Two dictionaries share a base trained on ordinary windows. The ordinary one ends with frequent ordinary
words, the toxic one with as many bytes of words and word beginnings (``SHORTEST`` letters or more) that recur
in toxic documents (in ``CONTEXTS`` different neighbourhoods, so copies of a document do not count) and begin
no word of the sample's ordinary texts. A window is
one word; every byte of it is spelled as ``SPELLING`` fixed bytes, so that what a match saves outweighs
what it costs to write down. The distance of a window is the length under the ordinary dictionary less
the length under the toxic one. A document's largest distances, their share and its length go through a
logistic calibration, fitted on the same sample, to a score from 0 to 1.

The fit uses a bounded sample of labelled rows: at most ``toxic_rows`` and ``ordinary_rows`` of them, the
first by a seeded hash, of texts up to ``LONGEST`` characters. Scoring reads every whole text.

Null and empty texts have no windows and get the calibrated score of a document without distances. Labels
that are null or other than 0 and 1 are not used. Without toxic or without ordinary rows every score is 0.
Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import random
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.llm.util import strings

CONTEXTS = 3
SHORTEST = 4
SPELLING = 3
BASE_BYTES = 112_640
BASE_ROWS = 4000
LONGEST = 200_000
CACHED = 400_000


def words(text: str) -> list[str]:
    return text.lower().split()


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from: remainder 2 of the id's checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Dictionaries and calibration; a plain value that is broadcast (under a megabyte)."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None, mean: np.ndarray, scale: np.ndarray, spelling: list[bytes], lead: bytes):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self.mean, self.scale, self.spelling, self.lead = mean, scale, spelling, lead

    def spell(self, text: bytes) -> bytes:
        return b"".join(map(self.spelling.__getitem__, text))

    def compressors(self):
        params = zstandard.ZstdCompressionParameters(
            window_log=20, hash_log=18, chain_log=19, search_log=9, min_match=3, target_length=256,
            strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_dict_id=0,
        )
        made = []
        for tail in (self.ordinary, self.toxic):
            content = zstandard.ZstdCompressionDict(tail, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=content).compress)
        return made


class Distances(dict):
    """Distance of each word; at most ``CACHED`` words are remembered in a worker."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, (self.ordinary, self.toxic) = model, model.compressors()

    def __missing__(self, word: str) -> tuple[int, float]:
        shown = self.model.lead + self.model.spell(f" {word} ".encode(errors="replace"))
        plain = len(self.ordinary(shown))
        value = plain - len(self.toxic(shown))
        if len(self) < CACHED and len(word) <= 64:
            self[word] = value
        return value

    def features(self, text: str) -> np.ndarray:
        own = words(text)
        d = np.fromiter(map(self.__getitem__, own), dtype=np.float64, count=len(own))
        top = np.zeros(3)
        head = np.sort(np.partition(d, len(d) - 3)[-3:] if len(d) > 3 else d)[::-1]
        top[: len(head)] = np.clip(head, 0, 16)
        share = float((d >= 6).sum()) / np.sqrt(max(1, len(d)))
        longest = max((16.0 * x / (SPELLING * len(w)) for w, x in zip(own, d) if x >= 3), default=0.0)
        return np.array([*top, top[0] >= 6, top[1] >= 6, min(share, 4.0), np.log1p(len(d)), longest])

    def score(self, text: str) -> float:
        if self.model.weights is None:
            return 0.0
        x = (self.features(text) - self.model.mean) / self.model.scale
        return float(1 / (1 + np.exp(-np.clip(self.model.weights[0] + x @ self.model.weights[1:], -30, 30))))


def sampled(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int, seed: int) -> DataFrame:
    """(doc_id, text, mark) of a bounded sample of the labelled rows that may be learned from, toxic ones marked 1."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    parts = [
        known.filter(F.col("toxic") == mark).select("doc_id", F.lit(mark).alias("mark")).distinct().orderBy(order).limit(rows)
        for mark, rows in ((1, toxic_rows), (0, ordinary_rows))
    ]
    chosen = F.broadcast(parts[0].unionAll(parts[1]))  # at most toxic_rows + ordinary_rows ids
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.length("text") <= LONGEST).dropDuplicates(["doc_id"])
    return texts.select("doc_id", "text", "mark")


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int, ordinary_rows: int, seed: int) -> pa.Table:
    """(text, mark) of the sample, by doc_id."""
    return _ordered(sampled(docs, labels, toxic_rows, ordinary_rows, seed).toArrow())


def _ordered(rows: pa.Table) -> pa.Table:
    return rows.sort_by("doc_id").select(["text", "mark"])


def _texts(rows: pa.Table, mark: int):
    """The texts of one mark, a few at a time: word lists of the whole sample would not fit a task."""
    for batch in rows.filter(pc.equal(rows.column("mark"), mark)).to_batches(max_chunksize=500):
        yield from strings(batch.column(0)).to_pylist()


def _marked(rows: pa.Table) -> list[str]:
    """Words and word beginnings that recur in toxic texts and begin no word of ordinary ones, rarest first."""
    common = sorted({w for text in _texts(rows, 0) for w in set(words(text))})

    def begins(text: str) -> Iterator[tuple[str, str]]:
        own = words(text)
        for before, word in zip(["", *own], own):
            for n in range(SHORTEST, min(len(word), 24) + 1):
                yield before, word[:n]

    seen = Counter(start for text in _texts(rows, 1) for _, start in begins(text))
    often = {w for w, n in seen.items() if n >= CONTEXTS and not _is_begun(common, w)}
    near: dict[str, set[str]] = {w: set() for w in often}
    for text in _texts(rows, 1):
        for before, start in begins(text):
            if start in near:
                near[start].add(before)
    return sorted((w for w, n in near.items() if len(n) >= CONTEXTS), key=lambda w: (len(near[w]), w))


def _is_begun(ordered: list[str], start: str) -> bool:
    at = bisect_left(ordered, start)
    return at < len(ordered) and ordered[at].startswith(start)


def fit(rows: pa.Table, seed: int = 11) -> Model:
    """Trains both dictionaries and the calibration on labelled texts."""
    rnd = random.Random(seed)
    spelling, lead = [rnd.randbytes(SPELLING) for _ in range(256)], rnd.randbytes(16)
    if not any(map(words, _texts(rows, 0))) or not any(map(words, _texts(rows, 1))):
        return Model(b" " * 8, b" " * 8, None, np.zeros(8), np.ones(8), spelling, lead)
    toxic = f" {' '.join(_marked(rows))} ".encode(errors="replace")[-BASE_BYTES:]
    windows, usual = [], Counter()
    for text in islice(_texts(rows, 0), BASE_ROWS):
        own = words(text)
        usual.update(set(own))
        windows += [f" {' '.join(own[i : i + 16])} ".encode(errors="replace") for i in range(0, len(own), 16)]
    filler, size = [], 0
    for word, _ in sorted(usual.items(), key=lambda x: (-x[1], x[0])):
        if size >= len(toxic):
            break
        filler.append(word)
        size += len(word.encode(errors="replace")) + 1
    ordinary = f" {' '.join(filler)} ".encode(errors="replace")[: len(toxic) - 1] + b" "
    base = _trained(windows)
    model = Model(b"", b"", None, np.zeros(8), np.ones(8), spelling, lead)
    model.ordinary, model.toxic = (model.spell(base + tail) + lead for tail in (ordinary, toxic))
    _calibrate(model, rows)
    return model


def _trained(windows: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(BASE_BYTES, windows, k=24, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: they fit whole
        return b"".join(windows)[:BASE_BYTES]


def _calibrate(model: Model, rows: pa.Table) -> None:
    """Logistic regression (Newton steps); ordinary rows beyond ``BASE_ROWS`` are weighted instead of scored."""
    table = Distances(model)
    bad = [table.features(t) for t in _texts(rows, 1)]
    plain = [table.features(t) for t in islice(_texts(rows, 0), BASE_ROWS)]
    x, y = np.array(bad + plain), np.repeat([1.0, 0.0], [len(bad), len(plain)])
    weight = np.where(y == 1, 1.0, (rows.num_rows - len(bad)) / len(plain))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - model.mean) / model.scale]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ z + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (weight * (y - p)) - 0.1 * w)
    model.weights = w


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 4000, ordinary_rows: int = 10_000, seed: int = 11) -> Model:
    """The fit of the bounded sample, made in a task: only the model comes to the driver."""
    rows = sampled(docs, labels, toxic_rows, ordinary_rows, seed)

    def learn(batches):
        held = [*batches]
        if held:
            model = pickle.dumps(fit(_ordered(pa.Table.from_batches(held)), seed))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(_ordered(rows.limit(0).toArrow()), seed)


_TABLES: dict[str, Distances] = {}


def _table(packed: bytes) -> Distances:
    key = hashlib.sha256(packed).hexdigest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Distances(pickle.loads(packed))
    return _TABLES[key]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches):
        table = _table(shared.value)
        for batch in batches:
            got = pa.array([table.score(t) for t in strings(batch.column(1)).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), got], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without rows whose score reaches ``threshold``; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    at = docs.columns.index("text")

    def keep(batches):
        table = _table(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([table.score(t) < threshold for t in strings(batch.column(at)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
