"""Vector code compression: product quantisation with memoised grid cells.

Components become integers floor(1024 x); vectors are cut into equal consecutive parts, and each part position has a
codebook. A task finds the nearest entry of a part through the part's coarse cell: the cell of a grid of width ``cell`` is
hashed, and the memo holds for every cell met those entries that no other entry dominates across the cell's box, that is,
whose least distance to the box does not exceed the smallest of the greatest distances. Only those entries are evaluated
exactly. A memo keeps the cell's coordinates, so a hash collision is seen and its part gets all entries; a full memo starts
anew. Distances are integers, so every form of the work gives the same codes.

The codebook starts from the parts of the ``entries`` vectors of smallest id (ties by vector) and is refined in ``rounds``
of assignment and componentwise floor(sum / count); an entry without parts stays. Each round sends one row per task,
position and used entry to the aggregate, and at most positions x entries rows to the driver.

Vectors that are null or hold a null or non-finite component take no part. Rows without id take part and count as the
largest ids. Repeated rows are rows each. Where lengths differ the shorter vector counts as padded with zeros, up to the
longest length rounded up to whole parts; empty vectors are all zero. Components beyond +-262144 would leave exact 64-bit
arithmetic and raise an error. With fewer vectors than ``entries`` the codebook has as many entries; an empty table gives
no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.llm.util import mix, written

#: |floor(scale * x)| up to here: 16 million squared differences still fit 64 bits for parts of that many components.
BOUND = 1 << 28
#: Cells a memo holds; a cell takes some 500 bytes at 256 entries.
CELLS = 1 << 15
#: Parts handled in one vectorised step.
STEP = 4096


class Memo:
    """Entries per grid cell of one part position."""

    def __init__(self, book: np.ndarray, cell: int, limit: int = CELLS):
        self.book, self.cell, self.limit = book, cell, limit
        self.slots: dict[int, int] = {}
        self.cells = np.zeros((0, book.shape[1]), dtype=np.int64)
        self.open = np.zeros((0, len(book)), dtype=bool)
        odd = np.arange(1, 2 * book.shape[1], 2, dtype=np.uint64)
        self.weights = mix(odd * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def _dominance(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries may be nearest to some integer point of its box."""
        least = np.zeros((len(cells), len(self.book)), dtype=np.int64)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            # a coordinate has few values: its distances to all entries are computed once per value
            values, back = np.unique(cells[:, d], return_inverse=True)
            low = (values * self.cell)[:, None]
            high = low + self.cell - 1
            entry = self.book[:, d][None, :]
            gap = np.maximum(np.maximum(low - entry, entry - high), 0)
            far = np.maximum(np.abs(entry - low), np.abs(high - entry))
            least += (gap * gap)[back]
            most += (far * far)[back]
        return least <= most.min(axis=1, keepdims=True)

    def _slots(self, cells: np.ndarray) -> np.ndarray:
        """Memo slot of each cell, -1 where another cell has the same hash."""
        keys = mix((cells.astype(np.uint64) * self.weights).sum(axis=1, dtype=np.uint64))
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.slots) + len(unique) > self.limit:
            self.slots, self.cells, self.open = {}, self.cells[:0], self.open[:0]
        known = [self.slots.get(k, -1) for k in unique.tolist()]
        slot = np.array(known, dtype=np.int64)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            new = cells[first[fresh]]
            slot[fresh] = len(self.cells) + np.arange(len(fresh))
            self.slots.update(zip(unique[fresh].tolist(), slot[fresh].tolist()))
            self.cells = np.concatenate([self.cells, new])
            self.open = np.concatenate([self.open, self._dominance(new)])
        slot = slot[back]
        return np.where((self.cells[slot] == cells).all(axis=1), slot, -1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and squared distance of the nearest entry of each part; ties go to the lower place."""
        code, error = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
        for at in range(0, len(parts), STEP):
            part = parts[at : at + STEP]
            slot = self._slots(part // self.cell)
            allowed = self.open[slot]
            allowed[slot < 0] = True
            row, entry = np.nonzero(allowed)  # by row, entries ascending
            away = np.zeros(len(row), dtype=np.int64)
            for d in range(part.shape[1]):
                gap = part[row, d] - self.book[entry, d]
                away += gap * gap
            begin = np.searchsorted(row, np.arange(len(part)))
            best = np.minimum.reduceat(away, begin)
            hit = np.flatnonzero(away == best[row])
            _, first = np.unique(row[hit], return_index=True)
            code[at : at + STEP], error[at : at + STEP] = entry[hit[first]], best
        return code, error


def _integers(column: pa.Array, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their integer components padded to ``width``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    lens = np.diff(column.offsets.to_numpy()).astype(np.int64)
    values = column.values.slice(column.offsets[0].as_py(), int(lens.sum())) if len(column) else column.values
    x = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lens)), lens)
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    ok[row[~np.isfinite(x)]] = False
    keep = ok[row]
    place = (np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens))[keep]
    x, row = np.floor(x[keep] * scale), row[keep]
    if len(x) and (np.abs(x) > BOUND).any():
        raise ValueError(f"a vector component is beyond {BOUND / scale}")
    out = np.zeros((len(lens), width), dtype=np.int64)
    out[row, place] = x.astype(np.int64)
    kept = np.flatnonzero(ok)
    return kept, out[kept]


def _assign(books: np.ndarray, cell: int, scale: float, each, schema: str, name: str):
    """``mapInArrow`` function: parts of each batch with their codes go to ``each``; what it holds comes out at the end."""

    def run(batches):
        memos = [Memo(book, cell) for book in books]
        state = None
        for batch in batches:
            kept, q = _integers(batch.column("embedding"), books.shape[0] * books.shape[2], scale)
            parts = q.reshape(len(q), books.shape[0], books.shape[2])
            found = [m.nearest(parts[:, p]) for p, m in enumerate(memos)]
            state, out = each(state, batch, kept, parts, found)
            if out is not None:
                yield out
        _, out = each(state, None, None, None, None)
        if out is not None:
            yield out

    return run


def _sums(books: np.ndarray):
    n_parts, n_entries, width = books.shape
    names = ["part", "entry", "n", *[f"s{d}" for d in range(width)]]

    def each(state, batch, kept, parts, found):
        if state is None:
            state = np.zeros((n_parts, n_entries), np.int64), np.zeros((n_parts, n_entries, width), np.int64)
        count, total = state
        if batch is None:
            part, entry = np.nonzero(count)
            columns = [part, entry, count[part, entry], *total[part, entry].T]
            return None, pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)
        for p, (code, _) in enumerate(found):
            count[p] += np.bincount(code, minlength=n_entries)
            np.add.at(total[p], code, parts[:, p])
        return state, None

    return each, ", ".join(f"{n} long" for n in names)


def _codes(digits: int):
    def each(state, batch, kept, parts, found):
        if batch is None:
            return None, None
        text = ["".join(f"{c:0{digits}x}" for c in row) for row in np.stack([c for c, _ in found], axis=1).tolist()]
        error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
        at = pa.array(kept)
        columns = [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(text, pa.string()), pa.array(error)]
        return None, pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return each


def first_books(vectors: DataFrame, parts: int, entries: int, scale: float) -> np.ndarray:
    """Starting codebooks (parts x entries x width) from the vectors of smallest id: at most ``entries`` rows."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = vectors.filter(x.isNotNull() & fine)
    longest = usable.agg(F.max(F.size(x))).first()[0]
    if longest is None:
        return np.zeros((parts, 0, 1), dtype=np.int64)
    width = max(1, -(-longest // parts))
    rows = usable.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    _, q = _integers(rows.column("embedding"), parts * width, scale)
    return np.ascontiguousarray(q.reshape(len(q), parts, width).transpose(1, 0, 2))


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, cell: int = 64, scale: float = 1024.0) -> np.ndarray:
    """Codebooks after ``rounds`` of assignment and averaging; ``vectors`` has vec_id and embedding."""
    source = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    books = first_books(source, parts, entries, scale)
    for _ in range(rounds if books.shape[1] else 0):
        each, schema = _sums(books)
        partial = source.select("embedding").mapInArrow(_assign(books, cell, scale, each, schema, "sums"), schema)
        sums = partial.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(f"s{d}") for d in range(books.shape[2])])
        found = np.array([list(r) for r in sums.collect()], dtype=np.int64)  # positions x entries rows at most
        books = books.copy()
        books[found[:, 0], found[:, 1]] = found[:, 3:] // found[:, 2:3]
    return books


def books_text(books: np.ndarray) -> str:
    """All entries' components in decimal, by part, entry and place, joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))


def encode(vectors: DataFrame, books: np.ndarray, cell: int = 64, scale: float = 1024.0) -> DataFrame:
    """(vec_id, label, code, error) of every vector that takes part; a code has two hex digits (or more) per part."""
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    label = kinds["label"].simpleString() if "label" in kinds else "int"
    source = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("label") if "label" in kinds else F.lit(None).cast("int")).alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    schema = f"vec_id long, label {label}, code string, error long"
    if not books.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    digits = max(2, len(f"{books.shape[1] - 1:x}"))
    return source.mapInArrow(_assign(books, cell, scale, _codes(digits), schema, "codes"), schema)


#: A label of more than one row in so many is joined by broadcast; there are fewer of those.
HOT_LABELS = 1000


def compressed(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, cell: int = 64, scale: float = 1024.0) -> tuple[DataFrame, np.ndarray]:
    """Codes with the error of each vector and the error summed over its label (nulls together), and the codebooks.

    Labels that hold more than 1/1000 of the rows are fewer than 1000 and are broadcast; the others are joined by key.
    """
    books = train(vectors, parts, entries, rounds, cell, scale)
    codes = written(encode(vectors, books, cell, scale), "vector-codes")
    per_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    sums = written(per_label.select(F.col("label").alias("l"), "label_error", "n"), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_LABELS > total
    hot = F.broadcast(sums.filter(is_hot).drop("n").withColumn("hot", F.lit(True)))
    tagged = codes.join(hot, codes["label"].eqNullSafe(hot["l"]), "left").drop("l")
    done = tagged.filter("hot").select("vec_id", "label", "code", "error", "label_error")
    rare = sums.filter(~is_hot).drop("n")
    rest = tagged.filter("hot IS NULL").drop("label_error", "hot")
    rest = rest.join(rare, rest["label"].eqNullSafe(rare["l"])).select("vec_id", "label", "code", "error", "label_error")
    return done.unionAll(rest), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()
