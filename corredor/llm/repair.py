"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation's rows, by (turn, role, text) with null turns first, become the cheapest sequence of edits whose result has
role initials ``(s?(ua)+)?``: Keep 0; Rerole to user or assistant 2; Delete 3, and no other edit for blank and duplicate rows;
Insert an empty user or assistant text 2. A truncated row that is not deleted costs 1 more. Of the cheapest edit sequences
the one whose initials are least in ASCII order is taken.

Edits are arcs of a lattice over (row, last role). The auction keeps a price per node and one path from the origin: the path
is extended along an arc that costs exactly the difference of its prices, or its last node's price is raised to the best of
its arcs and the path contracts. At the end the prices solve the dual problem, so every arc of a cheapest path is tight;
tight arcs that lead to the end are followed in the order D, I, K, R. The lattice is cut into blocks of ``BLOCK`` rows; a block
is solved for the prices at its end, which the block behind it gave, and equal blocks are solved once per task.

A conversation may hold a third of all rows. Rows are laid out in range partitions over the whole order, so such a
conversation runs through many of them. For the runs at partition borders, at most two per partition, the cost between any
two states is found first; prices at their ends and states at their starts are chained over one row per run. Equal rows
are one row with a count, and the first row of each text is found by a minimum per text, so nothing is gathered by key.
A task holds the rows of one conversation within its partition.

Null role or text counts as one space; rows without conv_id form one conversation; of equal rows the first counts, the others
are duplicates (blank ones blank); conversations of one turn number, empty tables and empty texts need no special case.
Texts are never cut. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.session import cut_lineage

BLOCK = 16
FAR = 1 << 40
#: States: nothing yet, after system, after user, after assistant; the state that one more user or assistant leads to.
NEXT = (2, 2, 3, 2)
#: State after a kept row by its initial (other, s, u, a); -1 where it may not stand.
KEPT = ((-1, 1, 2, -1), (-1, -1, 2, -1), (-1, -1, -1, 3), (-1, -1, 2, -1))
#: Cost of the insertions that end a conversation in each state, and how many they are.
AT_END = (0, 4, 2, 0)
TAIL = ("", "II", "I", "")


def _arcs(codes: bytes) -> list[list[tuple[str, int, int]]]:
    """(edit, cost, node) by node, in ASCII order of the edit; a code is the initial (0-3) plus 4 for a truncated row."""
    arcs = []
    for i, code in enumerate(codes):
        cut, initial = divmod(code, 4)
        for state in range(4):
            out = [("D", 3, 4 * i + 4 + state), ("I", 2, 4 * i + NEXT[state])]
            if KEPT[state][initial] >= 0:
                out.append(("K", cut, 4 * i + 4 + KEPT[state][initial]))
            out.append(("R", 2 + cut, 4 * i + 4 + NEXT[state]))
            arcs.append(out)
    return arcs


def auction(codes: bytes, ends: tuple[int, ...]) -> tuple[list[int], list[list[tuple[str, int, int]]]]:
    """Prices of all nodes, given those behind the last row, once a path was found from each of the four start states."""
    arcs, size = _arcs(codes), 4 * len(codes)
    limit = 3 * len(codes) + 8 + max((e for e in ends if e < FAR), default=0)
    price = [0] * size + list(ends)
    for origin in range(4):
        path = [origin]
        while path[-1] < size:
            node = path[-1]
            best, after = FAR, -1
            for _, cost, target in arcs[node]:
                if cost + price[target] < best:
                    best, after = cost + price[target], target
            if best > limit:  # dearer than any way through the block: there is none
                best = FAR
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif best == FAR:
                break
            else:
                path.append(after)
    return price, arcs


@lru_cache(maxsize=1 << 15)
def solve(codes: bytes, ends: tuple[int, ...]) -> tuple[tuple[int, ...], tuple]:
    """Prices at the start of a block, and for each start state the edits of each row with the end state (None: no way)."""
    price, arcs = auction(codes, ends)
    size = 4 * len(codes)
    good = [False] * size + [e < FAR for e in ends]
    tight = lambda node, cost, target: price[node] < FAR and price[node] == cost + price[target]
    for level in range(size - 4, -1, -4):
        for _ in range(3):  # an insertion stays at its row: user and assistant may follow each other once
            for node in range(level, level + 4):
                good[node] = good[node] or any(good[t] and tight(node, c, t) for _, c, t in arcs[node])
    traces = []
    for origin in range(4):
        if not good[origin]:
            traces.append(None)
            continue
        node, edits, now = origin, [], ""
        while node < size:
            edit, node = next((e, t) for e, c, t in arcs[node] if good[t] and tight(node, c, t))
            now += edit
            if edit != "I":
                edits.append(now)
                now = ""
        traces.append((tuple(edits), node - size))
    return tuple(price[:4]), tuple(traces)


def _relative(ends: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    low = min(ends)
    return (0, ends) if low >= FAR else (low, tuple(min(e - low, FAR) if e < FAR else FAR for e in ends))


def _backward(codes: bytes, ends: tuple[int, ...]) -> tuple[tuple[int, ...], list]:
    """Prices at the start of a run of rows, and its blocks' traces."""
    traces = []
    for at in range((max(len(codes), 1) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        low, shape = _relative(ends)
        ends, found = solve(codes[at : at + BLOCK], shape)
        ends = tuple(e + low if e < FAR else FAR for e in ends)
        traces.append(found)
    return ends, traces[::-1]


def _forward(traces: list, state: int) -> tuple[list[str], int]:
    edits = []
    for found in traces:
        some, state = found[state]
        edits += some
    return edits, state


def between(codes: bytes) -> list[list[int]]:
    """Cheapest cost of a run from each state to each state."""
    columns = [_backward(codes, tuple(0 if q == end else FAR for q in range(4)))[0] for end in range(4)]
    return [[columns[end][start] for end in range(4)] for start in range(4)]


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the planned damage, by crc32(``conv_id:turn``) % 20; nulls read as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    rows = rows.filter("kind <> 0").withColumns(
        {
            "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        }
    )
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", "role", "text")


_KEYS = ["has_conv", "conv", "has_turn", "at"]
#: Enough of a role or text to tell most rows apart when ranges are sampled; sorting compares them whole.
_HEAD = 64


def laid_out(turns: DataFrame) -> DataFrame:
    """Distinct rows with their count, fault and code, in range partitions over (conversation, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        role.alias("role"), text.alias("text"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("said"),
    )
    # the keys hold no nulls, so the aggregate's partitions serve the join too
    one = rows.groupBy(*_KEYS, "said").agg(F.first(F.struct("role", "text")).alias("r"), F.count("*").alias("n"))
    first = rows.groupBy("has_conv", "conv", "said").agg(F.min(F.struct("has_turn", "at")).alias("f"))
    first = first.select("has_conv", "conv", "f.has_turn", "f.at", "said", F.lit(True).alias("is_first"))
    rows = one.join(first, [*_KEYS, "said"], "left").select(*_KEYS, "r.role", "r.text", "n", F.coalesce("is_first", F.lit(False)).alias("is_first"))
    seen = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
    fault = (
        F.when(seen == "", "blank").when(~F.col("is_first"), "duplicate").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    order = [*_KEYS, "role", "text"]
    short = F.when(F.length("role") <= _HEAD, F.substring("text", 1, _HEAD)).otherwise("")
    ranges = [*[F.col(k) for k in _KEYS], F.substring("role", 1, _HEAD), short]
    rows = rows.select(*order, "n", fault.alias("fault")).repartitionByRange(*ranges).sortWithinPartitions(*order)
    return cut_lineage(rows.withColumn("part", F.spark_partition_id()))


def _initial(role: str) -> int:
    return "sua".find(role[0]) + 1 if role else 0


def _code(role: str, fault: str | None) -> int:
    return _initial(role) + (4 if fault == "truncated" else 0)


def _runs(batches):
    """(part, conversation, rows) for each conversation's rows within the partition."""
    key, held, part = None, [], None
    names = ("part", "has_conv", "conv", "has_turn", "at", "role", "text", "n", "fault")
    for batch in batches:
        for part, has_conv, conv, *row in zip(*(batch.column(c).to_pylist() for c in names)):
            if (has_conv, conv) != key:
                if held:
                    yield *at, held
                key, held, at = (has_conv, conv), [], (part, (has_conv, conv))
            held.append(row)
    if held:
        yield *at, held


def _free(rows) -> bytes:
    return bytes(_code(r[2], r[5]) for r in rows if r[5] not in ("blank", "duplicate"))


def _chains(layout: DataFrame) -> tuple[dict, dict]:
    """Of each run at a partition border, by (part, conversation): prices behind it and if it is the last; state before it.

    The driver holds two conversation numbers and at most two runs' costs per partition, never rows.
    """
    key = F.struct("has_conv", "conv")
    edges = sorted((r["part"], tuple(r["a"]), tuple(r["b"])) for r in layout.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b")).collect())
    runs: dict[tuple, list[int]] = {}
    for (p, _, last), (q, first, _) in zip(edges, edges[1:]):
        if last == first:
            runs.setdefault(last, [p]).append(q)
    if not runs:
        return {}, {}
    spark = layout.sparkSession
    crossing = F.broadcast(spark.createDataFrame([(*k, ) for k in runs], "has_conv boolean, conv long"))
    rows = layout.join(crossing, ["has_conv", "conv"], "left_semi")

    def ask(answer, width):
        def run(batches):
            out = [(part, *conv, answer(part, conv, _free(held))) for part, conv, held in _runs(batches)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64())))],
                ["part", "has_conv", "conv", "found"],
            )

        schema = "part int, has_conv boolean, conv long, found array<long>"
        return {(r["part"], (r["has_conv"], r["conv"])): r["found"] for r in rows.mapInArrow(run, schema).collect()}

    costs = ask(lambda part, conv, codes: [c for row in between(codes) for c in row], 16)
    behind = {}
    for conv, parts in runs.items():
        ends = AT_END
        for part in reversed(parts):
            behind[part, conv] = ends, part == parts[-1]
            c = costs[part, conv]
            ends = tuple(min(min(c[4 * q + e] + ends[e], FAR) for e in range(4)) for q in range(4))
    table = spark.sparkContext.broadcast(behind)

    def leave(part, conv, codes):
        traces = _backward(codes, table.value[part, conv][0])[1]
        return [_forward(traces, q)[1] if _passes(traces, q) else -1 for q in range(4)]

    exits, before = ask(leave, 4), {}
    for conv, parts in runs.items():
        state = 0
        for part in parts:
            before[part, conv] = state
            state = exits[part, conv][state]
    return behind, before


def _passes(traces: list, state: int) -> bool:
    for found in traces:
        if found[state] is None:
            return False
        state = found[state][1]
    return True


EDITS = "conv_id long, part int, place long, edit string, copies long, turn long, was string, role string, text string, fault string, cost long"
_EDITS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("copies", pa.int64()), ("turn", pa.int64()),
    ("was", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("cost", pa.int64()),
])
_NAMES = {2: "user", 3: "assistant"}


def edits(turns: DataFrame) -> DataFrame:
    """One row per edit, in the order (conv_id, part, place).

    ``edit`` is K, R, D or I; ``was`` and ``turn`` are the row's own, ``role`` and ``text`` the repaired ones (null if deleted).
    Equal rows that are deleted after one another share a row with their number in ``copies``.
    """
    layout = laid_out(turns)
    behind, before = _chains(layout)
    shared = layout.sparkSession.sparkContext.broadcast((behind, before))

    def run(batches):
        behind, before = shared.value
        out = []
        for part, (has_conv, conv), rows in _runs(batches):
            ends, closes = behind.get((part, (has_conv, conv)), (AT_END, True))
            state, place, ident = before.get((part, (has_conv, conv)), 0), 0, conv if has_conv else None
            done = iter(_forward(_backward(_free(rows), ends)[1], state)[0])

            def emit(edit, copies, row, role, text, fault, cost):
                nonlocal place
                turn, was = (row[1] if row[0] else None, row[2]) if row else (None, None)
                out.append((ident, part, place, edit, copies, turn, was, role, text, fault, cost))  # noqa: B023
                place += 1

            for row in rows:
                _, _, role, text, n, fault = row
                if fault in ("blank", "duplicate"):
                    emit("D", n, row, None, None, fault, 3 * n)
                    continue
                for edit in next(done):
                    cut = int(fault == "truncated")
                    if edit == "D":
                        emit("D", 1, row, None, None, fault, 3)
                    elif edit == "K":
                        state = KEPT[state][_initial(role)]
                        emit("K", 1, row, role, text, fault, cut)
                    else:
                        state = NEXT[state]
                        emit(edit, 1, row if edit == "R" else None, _NAMES[state], text if edit == "R" else "", fault if edit == "R" else None, 2 + cut if edit == "R" else 2)
                if n > 1:
                    emit("D", n - 1, row, None, None, "duplicate", 3 * (n - 1))
            for edit in TAIL[state] if closes else "":
                state = NEXT[state]
                emit(edit, 1, None, _NAMES[state], "", None, 2)
            while len(out) >= 2000:
                yield _batch(out[:2000])
                out = out[2000:]
        if out:
            yield _batch(out)

    return layout.mapInArrow(run, EDITS)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDITS)], schema=_EDITS)


REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def report(turns: DataFrame, originals: DataFrame) -> DataFrame:
    """One row per conversation of ``originals`` (conv_id): faults and edits of ``turns``, and the digest of the repaired text.

    The digest is sequential by definition, so a conversation's edits stream through one task in order.
    """

    def read(batches):
        key, have, out = None, False, []
        names = [f.split()[0] for f in EDITS.split(", ")]
        for batch in batches:
            for conv, _, _, edit, copies, turn, was, role, text, fault, cost in zip(*(batch.column(n).to_pylist() for n in names)):
                if not have or conv != key:
                    if have:
                        out.append(state.row())
                    key, have, state = conv, True, _Report(conv)
                state.add(edit, copies, turn, was, role, text, fault, cost)
        if have:
            out.append(state.row())
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in REPORT.split(", ")]
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in REPORT.split(", ")])

    rows = edits(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(read, REPORT)
    every = originals.select(F.col("conv_id").cast("long").alias("id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(rows, every["id"].eqNullSafe(rows["conv_id"]), "left").select(
        F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


class _Report:
    """Counts and digests of one conversation from its edits in order."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost = conv, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.low = self.high = self.turn = self.initial = None
        self.turns, self.audit, self.digest, self.written = 0, [], hashlib.sha256(), False

    def add(self, edit, copies, turn, was, role, text, fault, cost):
        self.cost += cost
        self.audit.append(edit * copies)
        if fault:
            self.faults[fault] += copies
        if was is not None:
            pair = (self.initial or "") + was[:1]
            self.illegal += (self.initial is not None and pair not in ("su", "ua", "au")) + copies - 1
            self.initial = was[:1]
            if turn is not None and turn != self.turn:
                self.turns += 1
                self.low = turn if self.low is None else self.low
                self.high = self.turn = turn
        if role is not None:
            self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode())
            self.written = True

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())
