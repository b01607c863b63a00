"""Substring deduplication with prefix-partitioned suffix trees over words.

Every position with ``window`` words left in its text is a suffix. Suffixes are split by variable-length
word prefixes (1, 2, 4, 8 words, then the whole window): a fixed-size histogram per prefix length, counted
over all suffixes, says where a prefix holds more than ``group`` suffixes and must be told apart by a
longer one; neighbouring prefixes fill up memory-sized groups. A group's task sorts its suffixes into the
leaf order of their tree, cut at ``window`` words: an inner node at that depth is a class of equal
windows, and all its leaves but the first (by doc_id, then position) are repeats. Runs of repeated windows
that touch are the maximal repeats whose words go.

What is shipped stays small: equal windows inside one chunk of documents are one leaf; a window goes out
only if its anchor, the smallest hash of its half-length word runs, also occurs in another chunk (equal
windows have equal anchors, so none is lost); leaves carry 96-bit fingerprints instead of words. Chunks are
written once, so all passes see the same layout. A passage that a third of the rows share costs one leaf a chunk.

Null text has no words; a null doc_id sorts before all others; repeated rows count in the order of their
chunks. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.llm.util import (
    NO_ID, Words, gram_hashes, ids_of, inside, kept_bytes, packed, steps, strings, unpacked, word_hashes, words_of, written,
)

LEVELS = (1, 2, 4, 8)  # prefix lengths in words before the whole window
BITS = 14  # histogram cells per prefix length: bounds what reaches the driver and the tasks


class Chunk:
    """Documents of a chunk by doc_id, their words and suffixes."""

    def __init__(self, payload: bytes, window: int):
        self.ids, text = unpacked(payload)
        self.words: Words = words_of(text)
        self.hashes, self.window = word_hashes(self.words), window
        self.valid = inside(self.words, window)

    def prefix(self, length: int) -> np.ndarray:
        """Hash of the first ``length`` words of each suffix that has a whole window (by position)."""
        return gram_hashes(self.hashes, length, seed=40 + length)[: len(self.valid)]

    def anchors(self) -> np.ndarray:
        if not len(self.valid):
            return np.zeros(0, dtype=np.uint64)
        half = max(1, self.window // 2)
        low, width, want = gram_hashes(self.hashes, half, seed=5), 1, self.window - half + 1
        while width < want:
            by = min(width, want - width)
            low = np.minimum(low[: len(low) - by], low[by:])
            width += by
        return low

    def fingerprints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(gram_hashes(self.hashes, self.window, seed=s)[at] for s in (11, 12))

    def documents(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.words.first, at, side="right") - 1]


def _runs(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; neighbours are mostly equal."""
    return np.unique(values[np.flatnonzero(np.append(True, values[1:] != values[:-1]))]) if len(values) else values


def chunks(docs: DataFrame, window: int, chunk_bytes: int) -> DataFrame:
    """(chunk, payload, words, cells): documents of up to ``chunk_bytes`` of text; one row per task holds its histogram."""

    def pack(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        cells = np.zeros((len(LEVELS) + 1, 1 << BITS), dtype=np.int64)
        for batch in batches:
            ids = ids_of(batch.column(0))
            text = strings(batch.column(1))
            for i, j in steps(text, chunk_bytes):
                payload = packed(ids[i:j], text.slice(i, j - i))
                chunk = Chunk(payload, window)
                for level, length in enumerate((*LEVELS, window)):
                    cell = chunk.prefix(min(length, window))[chunk.valid] >> np.uint64(64 - BITS)
                    cells[level] += np.bincount(cell.astype(np.int64), minlength=1 << BITS)
                yield _row(part + number, payload, len(chunk.words.starts), None)
                number += 1
        yield _row(-1, None, 0, cells.ravel())

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(pack, "chunk long, payload binary, words long, cells array<long>"), "substring-chunks")


def _row(chunk, payload, words, cells):
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([payload], pa.binary()), pa.array([words], pa.int64()), pa.array([cells], pa.list_(pa.int64()))],
        ["chunk", "payload", "words", "cells"],
    )


def prefix_groups(stored: DataFrame, group: int) -> tuple[np.ndarray, np.ndarray]:
    """For each prefix length and cell: the first group, and how many groups it fills (0: take a longer prefix)."""
    cells = np.zeros((len(LEVELS) + 1) << BITS, dtype=np.int64)
    summed = stored.filter("chunk < 0").select(F.posexplode("cells").alias("cell", "n")).filter("n > 0")
    got = summed.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 5 * 2**BITS rows
    cells[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    cells = cells.reshape(len(LEVELS) + 1, -1)
    share = np.where(cells <= group, 1, 0)
    share[-1] = np.maximum(1, -(-cells[-1] // group))
    weight = np.where(share > 0, np.minimum(cells, group), 0).ravel()
    # cells of a longer prefix also count what a shorter one has taken: groups are then smaller, never larger
    first = (np.cumsum(weight) - weight) // group
    whole = share.ravel() > 1  # overfull even as whole windows: told apart by further fingerprint bits
    extra = np.cumsum(np.where(whole, share.ravel(), 0)) - np.where(whole, share.ravel(), 0)
    first = np.where(whole, first.max(initial=0) + 1 + extra, first)
    return first.reshape(cells.shape), share


def _grouped(chunk: Chunk, at: np.ndarray, low: np.ndarray, tables) -> np.ndarray:
    first, share = tables
    out = np.full(len(at), -1, dtype=np.int64)
    for level, length in enumerate((*LEVELS, chunk.window)):
        cell = (chunk.prefix(min(length, chunk.window))[at] >> np.uint64(64 - BITS)).astype(np.int64)
        take = (out < 0) & (share[level][cell] > 0)
        out[take] = (first[level][cell] + (low % np.maximum(share[level][cell], 1).astype(np.uint64)).astype(np.int64))[take]
    return out


def _u64(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def shared_anchors(stored: DataFrame, window: int, buckets: int) -> DataFrame:
    """(chunk, anchors): the chunk's anchors that occur in another chunk too."""

    def post(batches):
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chunk = Chunk(payload, window)
                values = _runs(chunk.anchors()[chunk.valid])
                own = (values % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(own, kind="stable")
                keys, begin = np.unique(own[order], return_index=True)
                parts = [x.tobytes() for x in np.split(values[order], begin[1:])] if len(keys) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([number] * len(keys), pa.int64()), pa.array(parts, pa.binary())],
                    ["bucket", "chunk", "anchors"],
                )

    def repeated(rows: pa.Table) -> pa.Table:
        parts = _u64(rows.column("anchors"))
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        twice = np.zeros(len(flat), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = np.cumsum([0, *map(len, parts)])
        found = [p[twice[a:b]].tobytes() for p, a, b in zip(parts, at, at[1:])]
        out = pa.table({"chunk": rows.column("chunk"), "anchors": pa.array(found, pa.binary())})
        return out.filter(pa.array([len(x) > 0 for x in found]))

    posts = stored.filter("chunk >= 0").select("chunk", "payload").mapInArrow(post, "bucket long, chunk long, anchors binary")
    return posts.groupBy("bucket").applyInArrow(repeated, "chunk long, anchors binary")


def leaves(stored: DataFrame, shared: DataFrame, window: int, tables) -> DataFrame:
    """(grp, chunk, high, low, at, doc): suffixes whose anchor is shared, first of their window in the chunk."""
    table = stored.sparkSession.sparkContext.broadcast(tables)  # of fixed size

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {n: [] for n in _LEAVES.names}
        if left.num_rows and right.num_rows:
            chunk = Chunk(left.column("payload")[0].as_py(), window)
            wanted = np.sort(np.concatenate(_u64(right.column("anchors"))))
            own = chunk.anchors()
            place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
            at = np.flatnonzero(chunk.valid & (wanted[place] == own))
            high, low = chunk.fingerprints(at)
            order = np.lexsort((at, low, high))
            new = np.append(True, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])) if len(at) else np.zeros(0, bool)
            pick = np.sort(order[new])
            at, high, low = at[pick], high[pick], low[pick]
            grp = _grouped(chunk, at, low, table.value)
            order = np.argsort(grp, kind="stable")
            keys, begin = np.unique(grp[order], return_index=True)
            docs = chunk.documents(at)
            for key, part in zip(keys.tolist(), np.split(order, begin[1:])):
                for name, value in zip(_LEAVES.names, (
                    key, left.column("chunk")[0].as_py(), high[part].tobytes(), low[part].astype(np.uint32).tobytes(),
                    at[part].astype(np.uint32).tobytes(), docs[part].tobytes(),
                )):
                    out[name].append(value)
        return pa.table({n: pa.array(v, _LEAVES.field(n).type) for n, v in out.items()})

    chunk_rows = stored.filter("chunk >= 0").select("chunk", "payload")
    both = chunk_rows.groupBy("chunk").cogroup(shared.groupBy("chunk"))
    return both.applyInArrow(deal, "grp long, chunk long, high binary, low binary, at binary, doc binary")


_LEAVES = pa.schema([
    ("grp", pa.int64()), ("chunk", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("at", pa.binary()), ("doc", pa.binary()),
])


def subtree(rows: pa.Table) -> pa.Table:
    """One group's tree: leaves in order; inner nodes at full depth give (chunk, at) of all leaves but their first."""
    high = np.concatenate(_u64(rows.column("high")))
    low, at = (np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in rows.column(n).to_pylist()]) for n in ("low", "at"))
    doc = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows.column("doc").to_pylist()])
    chunk = np.repeat(rows.column("chunk").to_numpy(), [len(x) // 8 for x in rows.column("high").to_pylist()])
    order = np.lexsort((at, chunk, doc, low, high))
    inner = np.flatnonzero((high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])) + 1
    again = order[inner]
    again = again[np.argsort(chunk[again], kind="stable")]
    keys, begin = np.unique(chunk[again], return_index=True)
    parts = [np.sort(at[p]).tobytes() for p in np.split(again, begin[1:])] if len(keys) else []
    return pa.table({"chunk": pa.array(keys, pa.int64()), "at": pa.array(parts, pa.binary())})


def _cut(chunk: Chunk, marked: np.ndarray) -> np.ndarray:
    """Words to keep: covered by no window that is marked or starts earlier in the chunk."""
    at = np.flatnonzero(chunk.valid)
    high, low = chunk.fingerprints(at)
    order = np.argsort(high, kind="stable")
    same = high[order][1:] == high[order][:-1]
    if (low[order][1:][same] != low[order][:-1][same]).any():
        order = np.lexsort((at, low, high))
        same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    starts = np.concatenate([at[order[1:][same]], marked.astype(np.int64)])
    change = np.zeros(len(chunk.words.starts) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + chunk.window, -1)
    return np.cumsum(change)[:-1] == 0


def remove_repeats(docs: DataFrame, window: int = 20, chunk_bytes: int = 2 << 20, group: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the kept words joined by one space)."""
    stored = chunks(docs, window, chunk_bytes)
    tables = prefix_groups(stored, group)
    words = stored.agg(F.sum("words")).first()[0] or 0
    shared = written(shared_anchors(stored, window, max(1, -(-2 * words // group))), "substring-anchors")
    repeats = leaves(stored, shared, window, tables).groupBy("grp").applyInArrow(subtree, "chunk long, at binary")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows:
            chunk = Chunk(left.column("payload")[0].as_py(), window)
            marked = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, dtype=np.uint32) for x in right.column("at").to_pylist())])
            keep = _cut(chunk, marked)
            body, at = kept_bytes(chunk.words, keep)
            kept = np.concatenate([[0], np.cumsum(keep)])[chunk.words.first]
            total = chunk.words.per_text
            out = [
                [None if i == NO_ID else i for i in chunk.ids.tolist()], total, total - np.diff(kept),
                [body[a : max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
            ]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table({n: pa.array(v, k) for n, v, k in zip(("doc_id", "n_words", "n_removed", "kept"), out, kinds)})

    both = stored.filter("chunk >= 0").select("chunk", "payload").groupBy("chunk").cogroup(repeats.groupBy("chunk"))
    return both.applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
