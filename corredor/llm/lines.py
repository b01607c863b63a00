"""Line deduplication with SimHash: fuzzy lines, one occurrence kept per connected group.

Lines end at line feeds. A line is normalised (A-Z lower-cased, digits as 0, blanks as one space); lines
without words are blank and stay. Equal normalised lines are one class. Each class has a 64-bit SimHash
of its distinct words. Two classes are linked when their SimHashes differ in at most ``distance`` bits and their
edit similarity, 1 - distance / longer length in characters, is ``similarity`` or more; of each connected
group the first occurrence (by doc_id, then place) stays and all others go.

Pairs within ``distance`` bits agree in ``blocks - distance`` of the ``blocks`` bit blocks (pigeonhole), so
classes are joined on every choice of as many blocks. More blocks make longer keys and more tables with the
same pairs; their number follows the number of classes. Buckets yield spanning forests, never all pairs.
The members of a candidate component then meet with their texts for the edit similarity. Texts move as
compressed chunks. Buckets and components above ``block`` members are cut, each pair of chunks a task.

With ``distance=None`` digits count as they are and edit similarity alone links. Pairs whose longer line has at most ``SHORT`` characters are
all found: of the ``d + 1`` segments of the shorter one, where ``d`` edits are allowed, one stays whole. Longer
pairs become candidates if one of ``BANDS`` bands of ``ROWS`` minima over runs of ``GRAM`` bytes is equal and
``AGREE`` of all minima agree in two bits, or if their SimHashes are within 3 bits; the README gives the recall.
Components are those of pairs that agree in ``STRONG`` minima; all other candidates are confirmed pair by pair.

Null text counts as one blank line; a null doc_id sorts first; rows that share an id count one after the
other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corredor.llm.graph import components
from corredor.llm.minhash import forest, in_blocks
from corredor.llm.util import (
    LOWER, NO_ID, STEP_BYTES, Words, ids_of, kept_bytes, mix, offsets_of, packed, runs, steps, strings, unpacked, word_hashes, words_of, written,
)
from corredor.session import scratch_scope, write_once

PLAIN = LOWER.copy()
PLAIN[48:58] = 48
SHORT = 19
SEGMENT, LANES, FEW = 64, 4096, 16  # of fewer pairs, each one's distance is the shorter way
LIKELY = 1.6  # runs of three apart per edit allowed, up to which the upper bound is tried first; an edit changes six at most
PIECES = 8
GRAM = 5
BANDS, ROWS = 20, 3
AGREE, STRONG = 27, 42
CELL = 6
_HASH = np.uint32(2**32 - 4**CELL)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MINIMA = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_BIT_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


@dataclass
class Lines:
    """Words of several texts by line; line i has the words first[i] .. first[i + 1] - 1."""

    words: Words
    first: np.ndarray
    of_text: np.ndarray  # text i has the lines of_text[i] .. of_text[i + 1] - 1

    @property
    def spoken(self) -> np.ndarray:
        """Lines that hold words."""
        return np.flatnonzero(np.diff(self.first) > 0)


def lines_of(text: pa.Array, plain: np.ndarray = PLAIN) -> Lines:
    words = words_of(text)
    offs = offsets_of(text)
    offs = offs - offs[0]
    breaks = np.flatnonzero(words.data == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    of_text = np.arange(len(offs)) + np.searchsorted(breaks, offs)
    # a line's words begin where its bytes do; of lines that start together only the last has any
    first = np.append(np.searchsorted(words.starts, starts), len(words.starts))
    words.data = plain[words.data]
    return Lines(words, first, of_text)


def _class_keys(lines: Lines, h: np.ndarray) -> np.ndarray:
    """64-bit key of each line with words, of the words' hashes."""
    begin, counts = lines.first[lines.spoken], np.diff(lines.first)[lines.spoken]
    if not len(begin):
        return np.zeros(0, dtype=np.int64)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(begin, counts).astype(np.uint64)
    return mix(np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), begin) + counts.astype(np.uint64)).view(np.int64)


def _spans(begin: np.ndarray, total: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of the groups that begin at ``begin`` in ``total`` rows, of at most ``limit`` rows or one group."""
    lo = 0
    while lo < len(begin):
        hi = len(begin) if total - begin[lo] <= limit else int(np.searchsorted(begin, begin[lo] + limit, side="right")) - 1
        yield lo, max(hi, lo + 1)
        lo = max(hi, lo + 1)


def line_keys(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines with words, 64-bit key, SimHash)."""
    spoken = lines.spoken
    if not len(spoken):
        empty = np.zeros(0, dtype=np.int64)
        return spoken, empty, empty
    h = word_hashes(lines.words, seed=3)
    keys, counts = _class_keys(lines, h), np.diff(lines.first)[spoken]
    # each word of a line counts once: a mark between all words must not drown them
    line = np.repeat(np.arange(len(spoken)), counts)
    # 40 bits of the hash sort the words of a line in one key
    order = np.argsort(line.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)) if len(spoken) < 1 << 24 else np.lexsort((h, line))
    new = np.append(True, (line[order][1:] != line[order][:-1]) | (h[order][1:] != h[order][:-1]))
    h, distinct = h[order][new], np.bincount(line[order][new], minlength=len(spoken))
    begin = np.cumsum(distinct) - distinct
    sim = np.zeros(len(spoken), dtype=np.uint64)
    for lo, hi in _spans(begin, len(h), 1 << 16):
        own = h[begin[lo] : begin[hi - 1] + distinct[hi - 1]]
        at, half = begin[lo:hi] - begin[lo], distinct[lo:hi, None]
        lanes = np.uint64 if half.max() < 256 else np.int32  # eight counts of a byte, or one of four bytes
        for byte in range(8):
            value = (own >> np.uint64(8 * byte)).astype(np.uint8)
            if lanes is np.uint64:
                ones = np.add.reduceat(_BIT_LANES[value], at).view(np.uint8).reshape(-1, 8)
            else:
                ones = np.add.reduceat(np.unpackbits(value[:, None], axis=1), at, axis=0, dtype=np.int32)
            bits = np.packbits(2 * ones.astype(np.int32) > half, axis=1).ravel()
            sim[lo:hi] |= bits.astype(np.uint64) << np.uint64(8 * byte)
    return spoken, keys, sim.view(np.int64)


def normalised(lines: Lines, line: int) -> str:
    w = lines.words
    own = range(int(lines.first[line]), int(lines.first[line + 1]))
    return b" ".join(w.data[w.starts[i] : w.ends[i]].tobytes() for i in own).decode()


def _agreeing(a: str, b: str, way: int) -> int:
    """Length of the longest common beginning (end, if ``way`` is -1) of two texts, the second no longer than the first."""
    low, high = 0, len(b)
    while low < high:
        half = (low + high + 1) // 2
        if a.startswith(b[:half]) if way > 0 else a.endswith(b[len(b) - half :]):
            low = half
        else:
            high = half - 1
    return low


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the longer text."""
    if len(a) < len(b):
        a, b = b, a
    head = _agreeing(a, b, 1)
    a, b = a[head:], b[head:]
    tail = _agreeing(a, b, -1)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not b:
        return len(a)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for c in b:
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, diagonal & plus
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
    return score


def similar(a: str, b: str, similarity: float) -> bool:
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    if shorter < similarity * longer:
        return False
    return longer - edit_distance(a, b) >= similarity * longer


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, text = ids_of(batch.column(0)), strings(batch.column(1))
            for i, j in steps(text, chunk_bytes):
                payload = packed(ids[i:j], text.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([payload], pa.binary())], ["chunk", "payload"])
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(pack, "chunk long, payload binary"), "line-chunks")


def _occurrences(stored: DataFrame, plain: np.ndarray) -> DataFrame:
    """(key, sim, doc, chunk, line) of every line with words."""

    def read(batches):
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, text = unpacked(payload)
                lines = lines_of(text, plain)
                spoken, keys, sim = line_keys(lines)
                doc = ids[np.searchsorted(lines.of_text, spoken, side="right") - 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(sim), pa.array(doc), pa.array(np.full(len(keys), number)), pa.array(spoken.astype(np.int64))],
                    ["key", "sim", "doc", "chunk", "line"],
                )

    return written(stored.mapInArrow(read, "key long, sim long, doc long, chunk long, line long"), "line-keys", compression="zstd")


def _near(classes: DataFrame, distance: int, block: int) -> DataFrame:
    """(a, b): forests of the classes whose SimHashes differ in at most ``distance`` bits."""
    blocks, lines = distance + 1, classes.count()
    while lines >> (64 * (blocks - distance) // blocks + 6) and blocks < 2 * distance + 2:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << b) - (1 << a) for a, b in zip(edges, edges[1:]) if a in pick) for pick in combinations(edges[:-1], blocks - distance)]

    def posts(batches):
        for batch in batches:
            keys, sim = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for table, mask in enumerate(masks):
                value = mix((sim & np.uint64(mask)) + np.uint64(table)) >> np.uint64(32)
                yield table, [value.astype(np.uint32), keys, sim]

    def links(value, keys, sim):
        order = np.argsort(value, kind="stable")
        value, keys, sim = value[order], keys[order], sim[order]
        bounds = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
        length, found = np.diff(bounds), [np.zeros((2, 0), dtype=np.int64)]
        for one, other in _meetings(np.repeat(np.where(length <= FLAT, bounds[1:], 0), length)):
            hit = np.bitwise_count(sim[one] ^ sim[other]) <= distance
            found.append(np.stack([one[hit], other[hit]]))
        for i in np.flatnonzero(length > FLAT):
            own = sim[bounds[i] : bounds[i + 1]]
            x, y = forest(np.arange(len(own)), lambda one, rest, own=own: np.bitwise_count(own[rest] ^ own[one]) <= distance)
            found.append(bounds[i] + np.stack([x, y]))
        a, b = np.concatenate(found, axis=1)
        kept, _ = _spanning(a, b, len(keys))
        return keys[a[kept]], keys[b[kept]]

    return _met(classes.select("key", "sim"), posts, (np.uint32, np.int64, np.uint64), links, "a long, b long", lines, block)


def minima(body: np.ndarray, at: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Smallest value of each line's byte runs under each of ``BANDS * ROWS`` hashes; line i is body[at[i]:at[i + 1]].

    The low ``2 * CELL`` bits of a value are the cells of its run: those of the first and the last such run of the line.
    """
    out = np.empty((BANDS * ROWS, len(at) - 1), dtype=np.uint32)
    for lo, hi in _spans(at[:-1], int(at[-1]), 1 << 15):  # what one step works on stays in the cache
        own = np.append(body[at[lo] : at[hi]], np.zeros(8, dtype=np.uint8))
        n = len(own) - 8 - GRAM + 1
        gram = np.ndarray((n,), dtype="<u8", buffer=own, strides=(1,)) & np.uint64((1 << 8 * GRAM) - 1)
        h, cell = mix(gram), cells[at[lo] : at[lo] + n].copy()
        first = at[lo:hi] - at[lo]  # lines are longer than a run
        for k in range(1, GRAM):  # a run across a border counts as its line's first
            h[first[1:] - k], cell[first[1:] - k] = h[first[:-1]], cell[first[:-1]]
        one, two = h.astype(np.uint32) & _HASH, (h >> np.uint64(32)).astype(np.uint32)
        two = two & _HASH | _extents(two, np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(np.append(first, n))), cell)
        x = np.empty_like(one)
        for k, c in enumerate(_MINIMA):
            np.multiply(one, c, out=x)
            x += two  # its low bits are the cells
            np.minimum.reduceat(x, first, out=out[k, lo:hi])
    return out


def _extents(h: np.ndarray, line: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """First and last cell, side by side, of the runs with the line and hash of each run; cells grow along a line."""
    bits = np.uint64(len(h).bit_length())  # a step holds one line or few bytes: all three fit one word
    by = np.sort((line << np.uint64(32) | h) << bits | np.arange(len(h), dtype=np.uint64))
    place, by = (by & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), by >> bits
    same = by[1:] == by[:-1]
    some = np.flatnonzero(np.append(same, False) | np.append(False, same))  # most runs are alone
    out = cell << np.uint32(CELL) | cell
    if len(some):
        place, new = place[some], np.flatnonzero(np.append(True, by[some][1:] != by[some][:-1]))
        count = np.diff(np.append(new, len(some)))
        out[place] = np.repeat(cell[place[new]] << np.uint32(CELL) | cell[place[new + count - 1]], count)
    return out


def _sketch(lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each minimum, in two words."""
    out = []
    for part in (lows[:32], lows[32:]):
        word = np.zeros(lows.shape[1], dtype=np.uint64)
        for x in part:
            word = word << np.uint64(2) | (x >> np.uint32(7) & np.uint32(3)).astype(np.uint64)
        out.append(word)
    return out[0], out[1]


def allowed(longer: int, similarity: float) -> int:
    """Edits that ``similar`` allows a pair by its longer line."""
    return max(d for d in range(longer + 1) if longer - d >= similarity * longer)


def _segments(short: int, similarity: float) -> list[tuple[int, int]]:
    """(start, end) of the segments of a line of ``short`` characters: one more than edits allowed with any partner."""
    longer = max(n for n in range(short, SHORT + 1) if short >= similarity * n)
    parts = min(short, allowed(longer, similarity) + 1)
    cuts = [short * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _short_keys(text: str, similarity: float) -> tuple[list[str], list[str]]:
    """Segments of a short line, and the pieces in which it would hold a segment of a shorter or equally long partner."""
    n = len(text)
    own = [f"{n} {i} {text[a:b]}" for i, (a, b) in enumerate(_segments(n, similarity))]
    found, edits = set(), allowed(n, similarity)
    for short in range(1, n + 1):
        if short >= similarity * n:
            for i, (a, b) in enumerate(_segments(short, similarity)):
                for at in range(max(0, a - edits), min(n - (b - a), a + edits) + 1):
                    found.add(f"{short} {i} {text[at : at + b - a]}")
    return own, sorted(found)


def _short_links(bands: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair of classes of at most ``SHORT`` characters whose edit similarity suffices."""

    def post(batches):
        for batch in batches:
            out = [(s, k, t, probe) for k, t in zip(*(x.to_pylist() for x in batch.columns)) for probe, own in enumerate(_short_keys(t, similarity)) for s in own]
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["segment", "key", "line", "probe"])

    short = bands.select(F.explode(F.arrays_zip("short", "texts")).alias("s")).select("s.short", "s.texts").distinct()
    posted = written(short.mapInArrow(post, "segment string, key long, line string, probe int"), "line-segments")
    one = posted.filter("probe = 0").select("segment", F.col("key").alias("a"), F.col("line").alias("x"))
    two = posted.filter("probe = 1").select("segment", F.col("key").alias("b"), F.col("line").alias("y"))
    longer = F.greatest(F.length("x"), F.length("y"))
    near = longer - F.levenshtein("x", "y") >= F.lit(similarity) * longer
    return one.join(two, "segment").filter((F.col("a") != F.col("b")) & near).select("a", "b").distinct()


def _bodies(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Words of all lines, each with a space behind it, and where each line begins."""
    w = lines.words
    body, at = kept_bytes(Words(w.data, w.starts, w.ends, lines.first), np.ones(len(w.starts), dtype=bool))
    return np.frombuffer(body, dtype=np.uint8), at


def _flat(parts: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def _columns(payload: bytes, kinds: tuple) -> list[np.ndarray]:
    """The arrays of equal length that ``_flat`` has joined."""
    n, at, out = len(payload) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        out.append(np.frombuffer(payload, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


#: What is stored of a line for the gate (key, sketch in two words, characters), and of a post (value before it, cells of its minima behind).
_LINE = (np.int64, np.uint64, np.uint64, np.uint32)
_POST = (np.uint32, *_LINE, *(np.uint16,) * ROWS)
#: Bands are joined some at a time: the posts of one pass are on disk at once.
PASSES = 5


def _cells(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters of each line but the space behind it, which of 2^CELL equal parts of its line each byte lies in)."""
    if len(at) == 1:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
    lead = (body & 0xC0) != 0x80
    size, length = np.add.reduceat(lead, at[:-1], dtype=np.int32), np.diff(at)
    place = np.cumsum(lead, dtype=np.int32) - np.repeat(np.cumsum(size, dtype=np.int32) - size, length) - 1
    cells = (place * np.repeat(((1 << CELL) / size).astype(np.float32), length)).astype(np.uint32)
    return (size - 1).astype(np.uint32), np.minimum(cells, np.uint32((1 << CELL) - 1))


def _band_values(stored: DataFrame, similarity: float) -> DataFrame:
    """(n, lines, pass0, ..., short, texts): of each chunk its longer lines for the gate, their band values pass by pass, and its short lines."""
    least = int(similarity * SHORT)  # a partner of a line above SHORT characters has as many at least
    each = BANDS // PASSES

    def post(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                lines = lines_of(unpacked(payload)[1], LOWER)
                spoken, keys = lines.spoken, _class_keys(lines, word_hashes(lines.words, seed=3))
                keys, pick = np.unique(keys, return_index=True)
                body, at = _bodies(lines)
                begin, size = at[spoken[pick]], (at[1:] - at[:-1])[spoken[pick]]
                few = np.flatnonzero(size <= 4 * SHORT + 1)
                texts = [body[i : i + n - 1].tobytes().decode() for i, n in zip(begin[few], size[few])]
                short = [(int(k), t) for k, t in zip(keys[few], texts) if len(t) <= SHORT]
                long = np.flatnonzero(size > max(least, GRAM))
                keys, begin, size = keys[long], begin[long], size[long]
                own = np.concatenate([[0], np.cumsum(size)])
                flat = body[np.arange(own[-1]) + np.repeat(begin - own[:-1], size)]
                chars, cells = _cells(flat, own)
                lows = minima(flat, own, cells)
                places, lows = (lows & ~_HASH).astype(np.uint16), lows >> np.uint32(2 * CELL)
                values = []
                for k in range(BANDS):
                    value = np.full(len(keys), k, dtype=np.uint64)
                    for x in lows[k * ROWS : (k + 1) * ROWS]:
                        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + x)
                    values.append((value >> np.uint64(32)).astype(np.uint32))
                row = [len(keys), _flat([keys, *_sketch(lows << np.uint32(7)), chars])]
                for p in range(0, BANDS, each):
                    row.append(_flat([*values[p : p + each], *places[p * ROWS : (p + each) * ROWS]]))
                row = [pa.array([x]) for x in row] + [pa.array([[x[i] for x in short]], pa.list_(k)) for i, k in enumerate((pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(row, ["n", "lines", *(f"pass{p}" for p in range(PASSES)), "short", "texts"])

    kinds = ", ".join(f"pass{p} binary" for p in range(PASSES))
    return write_once(stored.select("payload").mapInArrow(post, f"n long, lines binary, {kinds}, short array<long>, texts array<string>"), "line-bands", compression="none")


def _meetings(last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of which the second is behind the first and before its ``last``, many at a time."""
    one, step = np.arange(len(last)), 1
    while len(one := one[one + step < last[one]]):
        yield one, one + step
        step += 1


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the links of a forest that connects what the links of n members do, tree of each member)."""
    tree, left, kept = np.arange(n), np.arange(len(a)), [np.zeros(0, dtype=np.int64)]
    while True:
        x, y = tree[a[left]], tree[b[left]]
        left, high, low = left[x != y], np.maximum(x, y)[x != y], np.minimum(x, y)[x != y]
        if not len(left):
            return np.concatenate(kept), tree
        order = np.lexsort((low, high))  # each tree goes to the least one that it is linked with
        pick = order[np.append(True, high[order][1:] != high[order][:-1])]
        kept.append(left[pick])
        to = np.arange(n)
        to[high[pick]] = low[pick]
        while (to[to] != to).any():
            to = to[to]
        tree = to[tree]


#: Members of a value that meet pair by pair at once; of more, those that agree in most minima are joined first.
FLAT = 1024


def _value_links(value: np.ndarray, keys: np.ndarray, high: np.ndarray, low: np.ndarray, size: np.ndarray, similarity: float, *places: np.ndarray):
    """(a, b, strong) of the lines that share a value and pass the gate.

    Pairs that agree in ``STRONG`` minima come as a forest of each group, all others as pairs, but those within a tree.
    Of the others, those stay whose shared minima (cells of each in ``places``) lie where the edits allowed can move them.
    """
    by = value.astype(np.uint64) << np.uint64(32) | size
    order = np.lexsort((keys, by))
    by, keys = by[order], keys[order]
    new = np.append(True, (by[1:] != by[:-1]) | (keys[1:] != keys[:-1]))  # a class counts once per value
    order, by, keys = order[new], by[new], keys[new]
    value = by >> np.uint64(32)
    bounds = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
    length = np.diff(bounds)
    high, low, size = high[order], low[order], size[order].astype(np.float64)
    places = [x[order] for x in places]
    even = np.uint64(0x5555555555555555)
    reach, last_cell = (1 - similarity) / 2 + 0.5**CELL, (1 << CELL) - 1

    def agreed(one, rest):
        apart = np.zeros(len(rest), dtype=np.uint8)
        for word in (high, low):
            x = word[rest] ^ word[one]
            apart += np.bitwise_count((x | x >> np.uint64(1)) & even)
        near = np.minimum(size[rest], size[one]) >= similarity * np.maximum(size[rest], size[one])
        return np.where(near, BANDS * ROWS - apart, 0)

    def placed(one, rest):
        n, m = size[one], size[rest]
        ahead, room, ok = (m - n) / 2, np.maximum(n, m) * reach + 1, np.ones(len(rest), dtype=bool)
        for x in places:
            p, q = x[one], x[rest]
            ok &= m * (q & last_cell) / (1 << CELL) - n * (p >> CELL) / (1 << CELL) >= ahead - room
            ok &= m * (q >> CELL) / (1 << CELL) - n * (p & last_cell) / (1 << CELL) <= ahead + room
        return ok

    strong, weak, held = [np.zeros((2, 0), dtype=np.int64)], [np.zeros((2, 0), dtype=np.int64)], 0

    def forests():
        both = np.concatenate(strong, axis=1)
        kept, tree = _spanning(*both, len(keys))
        return [both[:, kept]], tree

    # sorted by length: no partner of a line lies behind its last
    longest = np.minimum(size / similarity + 1e-6, 2**32 - 1).astype(np.uint64)
    last = np.searchsorted(by, value << np.uint64(32) | longest, side="right")
    for one, other in _meetings(np.where(np.repeat(length <= FLAT, length), last, 0)):
        n = agreed(one, other)
        hit = np.flatnonzero(n >= AGREE)
        firm = n[hit] >= STRONG
        strong.append(np.stack([one[hit[firm]], other[hit[firm]]]))
        hit = hit[~firm]
        hit = hit[placed(one[hit], other[hit])]
        weak.append(np.stack([one[hit], other[hit]]))
        held += strong[-1].shape[1]
        if held > 1 << 20:
            strong, held = forests()[0], 0
    for i in np.flatnonzero(length > FLAT):
        lo, count = bounds[i], length[i]
        x, y = forest(np.arange(count), lambda one, rest, lo=lo: agreed(lo + one, lo + rest) >= STRONG)
        strong.append(np.stack([lo + x, lo + y]))
        _, tree = _spanning(x, y, count)
        # small trees first: their members meet all behind them, those of the largest only these
        members = np.bincount(tree, minlength=count)[tree]
        order = np.lexsort((tree, members))
        ends = np.searchsorted(members[order].astype(np.int64) << 32 | tree[order], members[order].astype(np.int64) << 32 | tree[order], side="right")
        for u, end in zip(order, ends):
            if end == count:
                break
            rest = lo + order[end:]
            rest = rest[agreed(lo + u, rest) >= AGREE]
            rest = rest[placed(lo + u, rest)]
            weak.append(np.stack([np.full(len(rest), lo + u), rest]))
    (strong,), tree = forests()
    weak = np.concatenate(weak, axis=1)
    weak = weak[:, tree[weak[0]] != tree[weak[1]]]
    a, b = np.concatenate([strong, weak], axis=1)
    return keys[a], keys[b], np.arange(len(a)) < strong.shape[1]


def _banded(bands: DataFrame, number: int, similarity: float, block: int) -> DataFrame:
    """(a, b, strong): links of the longer lines that share a band of this pass and agree in enough of all minima."""
    each = BANDS // PASSES
    lines = bands.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def posts(batches):
        for batch in batches:
            for lines, bands in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _columns(lines, _LINE)
                found = _columns(bands, (np.uint32,) * each + (np.uint16,) * each * ROWS)
                for band, value in enumerate(found[:each]):
                    yield band, [value, *own, *found[each + band * ROWS : each + (band + 1) * ROWS]]

    def links(value, *own):
        return _value_links(value, *own[: len(_LINE)], similarity, *own[len(_LINE) :])

    kept = bands.select("lines", F.col(f"pass{number}").alias("bands"))
    return _met(kept, posts, _POST, links, "a long, b long, strong boolean", lines, block)


def _met(kept: DataFrame, posts, kinds: tuple, links, schema: str, lines: int, block: int) -> DataFrame:
    """Distinct rows of ``links`` over the posts of ``kept`` with a table and value in common.

    ``posts`` gives (table, columns of ``kinds``, the value first). They move as packed arrays by table and range of values.
    Ranges above ``256 * block`` posts are cut, each pair of chunks a task.
    """
    room = 64 * block
    shift = 32 - min(20, max(0, (lines // room).bit_length()))

    def cells(table, value):
        return (table << 32) + (value >> np.uint32(shift) if shift < 32 else value * 0).astype(np.int64)

    def count(batches):
        for table, own in posts(batches):
            cell, n = np.unique(cells(table, own[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], ["cell", "n"])

    def post(batches):
        held, rows, number = [], 0, TaskContext.get().partitionId() << 32

        def together():
            parts = [np.concatenate(x) for x in zip(*held)]
            cell = parts[0]
            order = np.argsort(cell, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0, [True]]))
            picked = [x[order] for x in parts[1:]]
            payloads = [_flat([x[lo:hi] for x in picked]) for lo, hi in zip(bounds, bounds[1:])]
            numbers = np.arange(number, number + len(payloads))
            return pa.RecordBatch.from_arrays(
                [pa.array(cell[order][bounds[:-1]]), pa.array(numbers), pa.array(payloads, pa.binary())], ["cell", "number", "payload"]
            )

        for table, own in posts(batches):
            held.append([cells(table, own[0]), *own])
            rows += len(own[0])
            if rows >= 1 << 19:
                out = together()
                yield out
                held, rows, number = [], 0, number + out.num_rows
        if rows:
            yield together()

    def join(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch, bounds in runs(batches, ["cell", "piece"]):
            payloads = batch.column("payload")
            for lo, hi in zip(bounds, bounds[1:]):
                parts = [_columns(x, kinds) for x in payloads.slice(lo, hi - lo).to_pylist()]
                found = links(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)

    sizes = kept.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("members")).filter(F.col("members") > 4 * room)
    posted = kept.mapInArrow(post, "cell long, number long, payload binary")
    sized = posted.join(F.broadcast(sizes), "cell", "left").withColumn("members", F.coalesce("members", F.lit(1)))  # each stands for many posts
    placed = in_blocks(sized, "cell", "number", "members", room)
    # cells are many small groups: as many tasks as there are cells, up to those of a shuffle
    dealt = placed.repartition("cell", "piece").sortWithinPartitions("cell", "piece")
    return dealt.select("cell", "piece", "payload").mapInArrow(join, schema).distinct()


def _texts(stored: DataFrame, classes: DataFrame, nodes: DataFrame, plain: np.ndarray) -> DataFrame:
    """(node, text): the normalised line of each class of ``nodes``."""
    wanted = nodes.join(classes, nodes["node"] == classes["key"]).select("first.chunk", "first.line", "node")

    def texts(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            lines = lines_of(unpacked(left.column("payload")[0].as_py())[1], plain)
            out = [normalised(lines, i) for i in right.column("line").to_pylist()]
        else:
            right = right.slice(0, 0)
        return right.select(["node"]).append_column("text", pa.array(out, pa.string()))

    found = stored.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(texts, "node long, text string")
    return written(found, "line-texts", compression="zstd")


def _runs_of_three(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(runs of three symbols of each text as row << 24 | symbols, symbols per text); a symbol is a character's first byte."""
    offs = offsets_of(text)
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offs[0] : offs[-1]]
    row = np.repeat(np.arange(len(text)), np.diff(offs))
    lead = (data & 0xC0) != 0x80
    data, row = data[lead].astype(np.int64), row[lead]
    whole = row[2:] == row[:-2]
    runs = (row[2:] << 24 | data[:-2] << 16 | data[1:-1] << 8 | data[2:])[whole]
    return np.sort(runs), np.bincount(row, minlength=len(text))


def _may_be_similar(a: pa.Array, b: pa.Array, similarity: float) -> np.ndarray:
    """False where ``similar`` is certain to be: an edit changes three runs of three symbols at most."""
    (x, n), (y, m) = _runs_of_three(a), _runs_of_three(b)
    both = np.concatenate([x, y])
    # the k-th of equal runs of one side meets the k-th of the other
    same = np.sort(np.concatenate([_numbered(x), _numbered(y)])) if len(both) else both
    common = np.bincount(same[1:][same[1:] == same[:-1]] >> 36, minlength=len(a)) if len(both) else np.zeros(len(a))
    longer = np.maximum(n, m)
    edits = longer - np.ceil(similarity * longer - 1e-6)
    return (np.minimum(n, m) >= similarity * longer - 1e-6) & (common >= longer - 2 - 3 * edits)


def _numbered(x: np.ndarray) -> np.ndarray:
    """Sorted values, each with its number among its equals (up to 4095) below it."""
    if not len(x):
        return x
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    number = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return x << 12 | np.minimum(number, 4095)


def _symbols(text: list[str], bits: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(``bits`` bits of each character, where each text begins)."""
    flat = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return (flat & np.uint32((1 << bits) - 1)).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in text], dtype=np.int64)])


def _least_edits(own: np.ndarray, begin: np.ndarray, size: np.ndarray, other: np.ndarray, lo: np.ndarray, hi: np.ndarray, ends=None, whole=False) -> np.ndarray:
    """Least edits that turn own[begin:begin + size] (``SEGMENT`` symbols at most) into any part of other[lo:hi], or the ``whole``.

    The bit-parallel distance of ``edit_distance``, a word per segment and many segments at a time. For any part, a window may
    be read beyond its end, which only makes the result smaller; ``ends`` gets where the part ends.
    """
    out = np.empty(len(begin), dtype=np.int64)
    symbols = 1 + max(int(own.max(initial=0)), int(other.max(initial=0)))
    seen = np.bincount(own, minlength=symbols) + np.bincount(other, minlength=symbols) > 0
    code = np.cumsum(seen, dtype=np.int32) - np.int32(1)
    own, other, one = code[own], code[other], np.uint64(1)
    order = np.argsort(hi - lo, kind="stable")
    for at in range(0, len(order), LANES):
        pick = order[at : at + LANES]
        n, lane = np.int32(len(pick)), np.arange(len(pick), dtype=np.int32)
        where = np.zeros(int(seen.sum()) * len(pick), dtype=np.uint64)
        for k in range(int(size[pick].max())):
            some = np.flatnonzero(size[pick] > k)
            where[own[begin[pick[some]] + k] * n + lane[some]] |= np.uint64(1 << k)
        top, place = (size[pick] - 1).astype(np.uint64), lo[pick].copy()
        plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64)
        score = size[pick].astype(np.uint64)
        least = score.copy()
        eq, diagonal, up, down = (np.empty(n, dtype=np.uint64) for _ in range(4))
        cell, end, length = np.empty(n, dtype=np.int32), np.zeros(n, dtype=np.int64), (hi - lo)[pick]
        for step in range(1, 1 + int(length.max())):  # in place: most of the time is the calls'
            other.take(place, out=cell, mode="clip")
            place += 1
            cell *= n
            cell += lane
            where.take(cell, out=eq, mode="clip")
            np.bitwise_and(eq, plus, out=diagonal)
            diagonal += plus
            diagonal ^= plus
            diagonal |= eq
            diagonal |= minus
            np.bitwise_or(diagonal, plus, out=up)
            np.invert(up, out=up)
            up |= minus
            np.bitwise_and(diagonal, plus, out=down)
            np.right_shift(up, top, out=eq)
            eq &= one
            score += eq
            np.right_shift(down, top, out=eq)
            eq &= one
            score -= eq
            if whole:
                np.copyto(least, score, where=length == step)
            else:
                if ends is not None:
                    np.copyto(end, step, where=score < least)
                np.minimum(least, score, out=least)
            up <<= one
            if whole:
                up |= one
            down <<= one
            np.bitwise_or(diagonal, up, out=plus)
            np.invert(plus, out=plus)
            plus |= down
            np.bitwise_and(up, diagonal, out=minus)
        out[pick] = least
        if ends is not None:
            ends[pick] = end
    return out


def _may_meet(a: list[str], b: list[str], similarity: float) -> np.ndarray:
    """False where ``similar`` is certain to be: the segments of one text need more edits than allowed, each at its best place.

    With as many edits no place moves further than half of them, and half of what the lengths differ by. Half of the segments
    settle most pairs; the others are tried where they do not.
    """
    (x, at), (y, from_) = _symbols(a), _symbols(b)
    n, m = np.diff(at), np.diff(from_)
    longer = np.maximum(n, m)
    edits = np.floor(longer - similarity * longer + 1e-6).astype(np.int64)
    may, needed, parts = np.abs(n - m) <= edits, np.zeros(len(n), dtype=np.int64), -(-m // SEGMENT)
    for first, last in ((0 * parts, -(-parts // 2)), (-(-parts // 2), parts)):
        row = np.repeat(np.arange(len(n)), np.where(may, last - first, 0))
        if not len(row):
            continue
        new = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        part = first[row] + np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
        start, end, drift = m[row] * part // parts[row], m[row] * (part + 1) // parts[row], (n - m)[row]
        lo = np.clip(start + (drift - edits[row]) // 2, 0, n[row])
        hi = np.clip(end - (-(drift + edits[row]) // 2), 0, n[row])
        found = _least_edits(y, from_[row] + start, end - start, x, at[row] + lo, at[row] + hi)
        np.add.at(needed, row, found)
        may &= needed <= edits
    return may


def _surely_meet(a: list[str], b: list[str], similarity: float) -> np.ndarray:
    """True only where ``similar`` is: the segments of one text become consecutive parts of the other with as many edits as allowed.

    The other is cut where its segments fit best. Texts with characters beyond nine bits are left out.
    """
    plain = np.array([x.isascii() and y.isascii() or max(max(x, default=" "), max(y, default=" ")) < "\u0200" for x, y in zip(a, b)], dtype=bool)
    sure, some = np.zeros(len(a), dtype=bool), np.flatnonzero(plain)
    (x, at), (y, from_) = _symbols([a[i] for i in some], 9), _symbols([b[i] for i in some], 9)
    n, m = np.diff(at), np.diff(from_)
    longer = np.maximum(n, m)
    edits = np.floor(longer - similarity * longer + 1e-6).astype(np.int64)
    parts = np.where(np.abs(n - m) <= edits, -(-m // SEGMENT), 0)
    row = np.repeat(np.arange(len(n)), parts)
    if not len(row):
        return sure
    new = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    part = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
    start, stop, drift = m[row] * part // parts[row], m[row] * (part + 1) // parts[row], (n - m)[row]
    lo = np.clip(start + (drift - edits[row]) // 2, 0, n[row])
    hi = np.clip(stop - (-(drift + edits[row]) // 2), 0, n[row])
    ends = np.zeros(len(row), dtype=np.int64)
    _least_edits(y, from_[row] + start, stop - start, x, at[row] + lo, at[row] + hi, ends)
    final = np.append(row[1:] != row[:-1], True)
    cut = np.minimum(lo + ends, n[row]) + row * (int(n.max()) + 1)
    cut[final] = (n + np.arange(len(n)) * (int(n.max()) + 1))[row[final]]
    cut = np.maximum.accumulate(cut) - row * (int(n.max()) + 1)  # parts follow one another
    before = np.where(part == 0, 0, np.append(0, cut[:-1]))
    needed = np.zeros(len(n), dtype=np.int64)
    np.add.at(needed, row, _least_edits(y, from_[row] + start, stop - start, x, at[row] + before, at[row] + cut, whole=True))
    sure[some] = (parts > 0) & (needed <= edits)
    hit = np.flatnonzero(sure)  # the last word on what is allowed is that of ``similar``
    longer = np.array([max(len(a[i]), len(b[i])) for i in hit])
    back = np.full(len(a), 0)
    back[some] = needed
    sure[hit] = longer - back[hit] >= similarity * longer
    return sure


def _alike(a: list[str], b: list[str], similarity: float, likely: np.ndarray | None = None) -> np.ndarray:
    """``similar`` of many pairs: bounds settle most of them, of ``likely`` pairs the upper one first."""
    if len(a) < FEW:
        return np.array([similar(x, y, similarity) for x, y in zip(a, b)], dtype=bool)

    def settled(bound, some):
        return bound([a[i] for i in some], [b[i] for i in some], similarity)

    hit, likely = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool) if likely is None else likely
    first = np.flatnonzero(likely)
    if len(first):
        hit[first] = settled(_surely_meet, first)
    left = np.flatnonzero(~hit)
    left = left[settled(_may_meet, left)]
    others = left[~likely[left]]
    if len(others):
        hit[others] = settled(_surely_meet, others)
        left = left[~hit[left]]
    left = left[_may_be_similar(*(pa.array([k[i] for i in left], pa.string()) for k in (a, b)), similarity)]
    hit[left] = [similar(a[i], b[i], similarity) for i in left]
    return hit


def _paired(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs whose edit similarity suffices."""

    def confirm(batches):
        for batch in batches:
            x, y = (strings(batch.column(k)) for k in ("x", "y"))
            begin = offsets_of(x)[:-1] + offsets_of(y)[:-1]
            for lo, hi in _spans(begin - begin[:1], int(np.diff(offsets_of(x)[[0, -1]])[0] + np.diff(offsets_of(y)[[0, -1]])[0]), STEP_BYTES * 2):
                a, b = (k.slice(lo, hi - lo).to_pylist() for k in (x, y))
                hit = _alike(a, b, similarity)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(lo, hi - lo).filter(pa.array(hit)) for k in ("a", "b")], ["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _linked(near: DataFrame, texts: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b): links confirmed by edit similarity within the candidate components."""
    groups = written(components(near), "line-groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    # all members of a group of unlike lines meet: so many a task that the largest group is not the longest task
    size = max(2, block // PIECES)
    placed = in_blocks(groups.join(sizes, "component").join(texts, "node"), "component", "node", "members", size)
    own, low, high = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / size)), F.shiftright("piece", 24), F.col("piece").bitwiseAND((1 << 24) - 1)
    # chunks meet their own members in a piece of their own
    placed = placed.withColumn("side", F.when((F.col("piece") < 0) | (low == high), 0).when(own == low, 1).otherwise(2))

    def confirm(batches):
        for batch, bounds in runs(batches, ["component", "piece"]):
            nodes, texts = batch.column("node").to_numpy(), batch.column("text").to_pylist()
            a, b = _similar_forests(texts, bounds, similarity, batch.column("side").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    # little text and much work: not to be drawn together into few tasks by size
    tasks = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(tasks, "component", "piece").sortWithinPartitions("component", "piece")
    return dealt.select("component", "piece", "node", "text", "side").mapInArrow(confirm, "a long, b long")


def _run_counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(how many runs of three symbols of each text fall into each of 1024 cells, symbols per text)."""
    counts, sizes = [np.zeros((0, 1024), dtype=np.uint8)], [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(text), 512):
        part = text.slice(i, 512)
        runs, size = _runs_of_three(part)
        cell = (mix((runs & 0xFFFFFF).astype(np.uint64)) >> np.uint64(54)).astype(np.int64)
        found = np.bincount((runs >> 24) << 10 | cell, minlength=len(part) << 10)
        counts.append(np.minimum(found, 255).astype(np.uint8).reshape(-1, 1024))
        sizes.append(size)
    return np.concatenate(counts), np.concatenate(sizes)


def _similar_forest(ids: np.ndarray, text: list[str], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the texts whose edit similarity suffices."""
    a, b = _similar_forests(text, np.array([0, len(text)]), similarity)
    return ids[a], ids[b]


#: Pairs that a walk asks for at once while its members find nothing more.
ASKED = 1 << 14


def _visits(lo: int, hi: int, side: np.ndarray, links: list):
    """As ``forest``: gives members with the unvisited ones that each meets, and takes the pairs (a, b) of these that are linked.

    Members of one tree go more at a time while they find nothing. Those of several trees must not: what two of them find would never meet.
    """
    rest = np.arange(lo, hi)
    while len(rest):
        queue, rest, turn = [rest[0]], rest[1:], 1
        while queue and len(rest):
            ones, queue = queue[: -turn - 1 : -1], queue[:-turn]
            x, y = yield [(one, rest[(side[rest] != side[one]) | (side[one] == 0)]) for one in ones]
            links.append(np.stack([x, y]))
            found = np.unique(y)
            queue += found.tolist()
            rest = rest[~np.isin(rest, found)]
            turn = 1 if len(found) else min(2 * turn, 1 + ASKED // len(rest))


def _similar_forests(text: list[str], bounds: np.ndarray, similarity: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): spanning forests of the similar texts of each group, by place; the groups go on side by side.

    Texts of ``side`` 1 meet those of side 2 only, all others each other.
    """
    side = np.zeros(len(text), dtype=np.int32) if side is None else side
    counts, size = _run_counts(pa.array(text, pa.string()))
    links = [np.zeros((2, 0), dtype=np.int64)]
    waiting = [(walk, next(walk)) for walk in (_visits(lo, hi, side, links) for lo, hi in zip(bounds, bounds[1:]) if hi - lo > 1)]
    while waiting:
        asked, likely, ends = [], [], []
        for _, wanted in waiting:
            for one, rest in wanted:
                longer = np.maximum(size[rest], size[one])
                edits = longer - np.ceil(similarity * longer - 1e-6)
                near = np.flatnonzero(np.minimum(size[rest], size[one]) >= similarity * longer - 1e-6)
                # an edit takes and makes three runs at most
                own, other = counts[one], counts[rest[near]]
                apart = (np.maximum(other, own) - np.minimum(other, own)).sum(axis=1, dtype=np.int64)
                close = apart <= 6 * edits[near]
                likely.append((apart <= LIKELY * edits[near])[close])
                asked.append(np.stack([np.full(int(close.sum()), one), rest[near[close]]]))
            ends.append(len(asked))
        ends = np.cumsum([0, *(x.shape[1] for x in asked)])[[0, *ends]]
        (x, y), likely = np.concatenate(asked, axis=1), np.concatenate(likely)
        alike, at, step = np.zeros(len(x), dtype=bool), 0, np.cumsum(size[x] + size[y])
        while at < len(x):  # some megabytes of text at a time
            to = max(at + 1, int(np.searchsorted(step, (step[at - 1] if at else 0) + STEP_BYTES, side="right")))
            alike[at:to] = _alike([text[i] for i in x[at:to]], [text[i] for i in y[at:to]], similarity, likely[at:to])
            at = to
        going, waiting = waiting, []
        for (walk, _), lo, hi in zip(going, ends, ends[1:]):
            own = lo + np.flatnonzero(alike[lo:hi])
            try:
                waiting.append((walk, walk.send((x[own], y[own]))))
            except StopIteration:
                pass
    a, b = np.concatenate(links, axis=1)
    kept, _ = _spanning(a, b, len(text))
    return a[kept], b[kept]


@contextmanager
def _freed(spark: SparkSession):
    """Inside, a query's shuffle files go when it ends: every step is stored in the shared folder, none is read twice."""
    held = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, held)


def remove_repeated_lines(docs: DataFrame, distance: int | None = 3, similarity: float = 0.8, block: int = 4000, chunk_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, kept (the lines that stay), classes (of its removed lines)."""
    plain = PLAIN if distance is not None else LOWER
    place = F.struct("doc", "chunk", "line")
    with _freed(docs.sparkSession):
        stored = _chunks(docs, chunk_bytes)
        seen = _occurrences(stored, plain)
        classes = seen.groupBy("key").agg(F.min(place).alias("first"), F.first("sim").alias("sim"), F.count("*").alias("n"))
        classes = written(classes, "line-classes")
        near, weak = written(_near(classes, 3 if distance is None else distance, block), "line-near"), None
        if distance is None:
            found = []
            with scratch_scope(docs.sparkSession):  # the largest copy goes when its links are stored
                bands = _band_values(stored, similarity)
                for number in range(PASSES):
                    found.append(written(_banded(bands, number, similarity, block), "line-near"))
                short = written(_short_links(bands, similarity), "line-links")
            near = reduce(DataFrame.unionAll, [near, *(x.filter("strong").select("a", "b") for x in found)])
            weak = reduce(DataFrame.unionAll, [x.filter("NOT strong").select("a", "b") for x in found])
            weak = written(weak.distinct(), "line-pairs")
        ends = near if weak is None else near.unionAll(weak)
        texts = _texts(stored, classes, ends.select(F.explode(F.array("a", "b")).alias("node")).distinct(), plain)
        links = written(_linked(near, texts, similarity, block), "line-links")
        if weak is not None:
            turns = 1 + weak.count() // (100 * block)  # pairs move with their texts: so many at once
            for turn in range(turns):
                own = weak.filter(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn)
                links = links.unionAll(written(_paired(own, texts, similarity), "line-links"))
            links = links.unionAll(short)
        groups = written(components(links), "line-groups")
        named = classes.join(groups, classes["key"] == groups["node"], "left").select(
            "key", "first", "n", F.coalesce("component", "key").alias("group")
        )
        kept = named.groupBy("group").agg(F.min("first").alias("keep"), F.sum("n").alias("lines")).filter("lines > 1")
        doomed = named.join(kept, "group").select(F.col("key").alias("k"), "group", "keep")
        marks = seen.join(doomed, seen["key"] == doomed["k"]).filter(place != F.col("keep")).select("chunk", "line", "group")
        marks = written(marks, "line-marks")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if left.num_rows:
            ids, text = unpacked(left.column("payload")[0].as_py())
            of_text = lines_of(text).of_text
            gone = dict(zip(right.column("line").to_pylist(), right.column("group").to_pylist()))
            places = np.sort(np.array(list(gone), dtype=np.int64))
            cuts = np.searchsorted(places, of_text)
            for i, body in enumerate(text.to_pylist()):
                own = places[cuts[i] : cuts[i + 1]].tolist()
                if own:
                    lost = {x - int(of_text[i]) for x in own}
                    body = "\n".join(x for n, x in enumerate(body.split("\n")) if n not in lost)
                for column, value in zip(out, (
                    None if ids[i] == NO_ID else int(ids[i]), int(of_text[i + 1] - of_text[i]), len(own), body, [gone[x] for x in own],
                )):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        names = ("doc_id", "n_lines", "n_removed", "kept", "classes")
        return pa.table({n: pa.array(v, k) for n, v, k in zip(names, out, kinds)})

    both = stored.groupBy("chunk").cogroup(marks.groupBy("chunk"))
    return both.applyInArrow(cut, "doc_id long, n_lines long, n_removed long, kept string, classes array<long>")
