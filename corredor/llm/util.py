"""Shared helpers of the training-data operators: tables, fixed layouts, and vectorised words of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corredor.session import work_dir

#: Bytes of text that one vectorised step works on; a longer text makes a step of its own.
STEP_BYTES = 2 << 20
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a fixed layout that survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strings(column: pa.Array) -> pa.Array:
    """Text column without nulls (null counts as empty)."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def offsets_of(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(column.buffers()[1] or b"\0\0\0\0", dtype=np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``limit`` bytes of text, or one row."""
    offs, i, n = offsets_of(column), 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Stands for a null id inside chunks; sorts before all others.
NO_ID = -(2**63)


def ids_of(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.int64())
    return (column.fill_null(NO_ID) if column.null_count else column).to_numpy()


def packed(ids: np.ndarray, text: pa.Array) -> bytes:
    """Documents by id as one compressed value: a chunk moves through a shuffle as one row."""
    order = pa.array(np.argsort(ids, kind="stable"))
    batch = pa.RecordBatch.from_arrays([pa.array(ids).take(order), text.take(order)], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> tuple[np.ndarray, pa.Array]:
    with pa.ipc.open_stream(payload) as stream:
        batch = stream.read_next_batch()
    return batch.column(0).to_numpy(), batch.column(1)


def runs(batches, keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by integer ``keys``, cut so that no group spans two; with the groups' bounds."""
    held = None
    for batch in batches:
        if held is not None and held.num_rows:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for key in keys:
            value = ids_of(batch.column(key))
            change |= value[1:] != value[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1])
        if len(bounds) > 1:
            yield batch.slice(0, int(bounds[-1])), bounds
        held = batch.slice(int(bounds[-1]))
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: byte spans in ``data`` and the words of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # text i has the words first[i] .. first[i + 1] - 1

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(column: pa.Array, lower: bool = False) -> Words:
    offs = offsets_of(column)
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    data = LOWER[raw] if lower else raw
    n = len(data)
    solid = np.empty(n + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(BLANK[data], out=solid[1:-1])
    inner = offs[1:-1]
    edge = solid[1:] != solid[:-1]  # edge[i]: a word starts or ends before byte i
    starts = edge[:n] & solid[1 : n + 1]
    ends = edge[1:] & solid[1 : n + 1]
    inner = inner[(inner > 0) & (inner < n)]
    starts[inner] = solid[inner + 1]  # texts lie side by side: a border ends a word
    ends[inner - 1] = solid[inner]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offs))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _constants(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def word_hashes(w: Words, seed: int = 1) -> np.ndarray:
    """64-bit hash of each word's bytes; equal words have equal hashes in every task."""
    if not len(w.starts):
        return np.zeros(0, dtype=np.uint64)
    lens = w.ends - w.starts
    cum = np.cumsum(lens)
    begin = cum - lens
    at = np.arange(cum[-1]) - np.repeat(begin, lens)  # place in the word
    value = _constants(seed, 256)[w.data[np.repeat(w.starts, lens) + at]]
    value *= _powers(seed, int(lens.max()))[at]
    return mix(np.add.reduceat(value, begin) + lens.astype(np.uint64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(seed: int, n: int) -> np.ndarray:
    have = _POWERS.get(seed)
    if have is None or len(have) < n:
        have = np.full(max(n, 256), _constants(seed + 7, 1)[0], dtype=np.uint64)
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 20:
            _POWERS[seed] = have
    return have[:n]


def gram_hashes(h: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring word hashes (runs across text borders included)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, by = np.zeros(n, dtype=np.uint64), _constants(seed + 3, 1)[0]
    for k in range(size):
        out *= by
        out += h[k : k + n]
    return mix(out)


def inside(w: Words, size: int) -> np.ndarray:
    """For each run of ``size`` words of ``gram_hashes``: does it lie within one text?"""
    total = len(w.starts) - size + 1
    if total <= 0:
        return np.zeros(0, dtype=bool)
    ok = np.ones(total, dtype=bool)
    for border in w.first[1:-1]:
        ok[max(0, border - size + 1) : border] = False
    return ok


def kept_bytes(w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words, each followed by a space, and the byte offset at which each text's part begins."""
    idx = np.flatnonzero(keep)
    s, lens = w.starts[idx], w.ends[idx] - w.starts[idx]
    out_at = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(int(out_at[-1]), 32, dtype=np.uint8)
    if len(idx):
        shift = np.repeat(s - out_at[:-1], lens)
        place = np.arange(int(lens.sum())) + np.repeat(np.arange(len(idx)), lens)
        out[place] = w.data[place + shift]
    return out.tobytes(), out_at[np.searchsorted(idx, w.first)]
