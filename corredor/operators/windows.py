"""Ordered operators that hold up when one key owns a large share of the rows.

A window over ``partitionBy(key)`` puts a whole key into one task. Here the rows are first counted by
cells of the hashed key: one aggregate over the key columns with a fixed number of groups. Where no cell
holds too large a share, the window runs as it is, over one scan of the input. Else the keys of the overfull
cells are cut into slots of the order column (a minute, a range of sequence numbers), the rows are stored
once with their slot, the window runs inside the slot, and what must cross a slot border travels through
a summary with one row per key and slot. The rows are shuffled once and the input plan appears once, in both cases.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corredor.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits
HOT_ROWS = 1_000_000  # a cell with fewer rows is never split
HOT_SHARE = 20_000  # a hot cell holds more than 1/20,000 of the rows, so there are fewer than that
KEY_CELLS = 1 << 16  # groups of the count, whatever the number of keys


def named_window(keys: Sequence[str], order: Sequence) -> WindowSpec:
    """One specification shared by several expressions."""
    return Window.partitionBy(*keys).orderBy(*order)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in the given order.

    ``row_number = 1`` lets Spark keep one row per key and map task before the shuffle, so a
    hot key never travels as a whole.
    """
    ranked = df.withColumn("_rn", F.row_number().over(named_window(keys, order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def later_duplicates(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str
) -> DataFrame:
    """The rows :func:`keep_first` drops; ``row_id`` identifies a row and ends the order.

    Keys are first reduced to the repeated ones with their first row, an aggregation with partial
    results. Joined with that short list, a hot key may be split by adaptive execution.
    """
    repeated = (
        df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by(row_id, F.struct(*order)).alias("_first"))
        .filter(F.col("_n") > 1)
    )
    same_key = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return (
        df.join(repeated, same_key)
        .filter(F.col(row_id) != F.col("_first"))
        .select(*df.columns)
    )


def key_cell(keys: Sequence[str]) -> Column:
    """One of ``KEY_CELLS`` cells by the hash of the key columns."""
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_CELLS))


def hot_cells(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Cells with at least ``hot_rows`` rows and more than ``1 / HOT_SHARE`` of all rows.

    A key above both bounds always lies in one of them; keys that share its cell are split with it, which
    changes no result. By the second bound there are fewer than ``HOT_SHARE`` cells, so they may stand in a plan.
    """
    counts = df.groupBy(key_cell(keys).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.withColumn("_total", F.sum("_n").over(Window.partitionBy(F.lit(0))))  # KEY_CELLS rows at most
    found = share.filter((F.col("_n") >= hot_rows) & (F.col("_n") * HOT_SHARE > F.col("_total")))
    return sorted(r["_cell"] for r in found.collect())


def ordered_context(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slot: Column,
    *,
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
    running_last: Mapping[str, Column] | None = None,
    running_max: Mapping[str, Column] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Neighbouring and running values per key (the engine of W04, W05 and W06).

    ``slot`` must not decrease along ``order`` and ``keys`` must not be NULL. Adds ``prev`` and
    ``next`` structs holding the named columns of the neighbouring row, and one column per
    running expression (last non-NULL value, or maximum, up to and including the row). The cells are
    counted when this is called; with a hot cell the rows are checkpointed with their slots then, too.
    """
    running_last, running_max = dict(running_last or {}), dict(running_max or {})
    hot = hot_cells(df, keys, hot_rows)
    inner = named_window([*keys, "_slot"] if hot else keys, order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.struct(*order)

    local: dict[str, Column] = {}
    summary: list[Column] = []
    across: dict[str, Column] = {}
    over_slots = named_window(keys, ["_slot"])
    before = over_slots.rowsBetween(Window.unboundedPreceding, -1)
    if previous:
        local["prev"] = F.lag(F.struct(*previous)).over(inner)
        summary.append(F.max_by(F.struct(*previous), position).alias("_tail"))
        across["_c_prev"] = F.lag("_tail").over(over_slots)
    if following:
        local["next"] = F.lead(F.struct(*following)).over(inner)
        summary.append(F.min_by(F.struct(*following), position).alias("_head"))
        across["_c_next"] = F.lead("_head").over(over_slots)
    for name, value in running_last.items():
        local[name] = F.last(value, ignorenulls=True).over(upto)
        known = F.when(value.isNotNull(), position)
        summary.append(F.max_by(value, known).alias(f"_t_{name}"))
        across[f"_c_{name}"] = F.last(f"_t_{name}", ignorenulls=True).over(before)
    for name, value in running_max.items():
        local[name] = F.max(value).over(upto)
        summary.append(F.max(value).alias(f"_t_{name}"))
        across[f"_c_{name}"] = F.max(f"_t_{name}").over(before)

    if not hot:
        return df.withColumns(local).select(*df.columns, *local)
    # only rows of hot cells get a slot; the NULL slot of other keys never meets the summary
    cell = f"_cell IN ({', '.join(map(str, hot))})"
    slotted = df.withColumn("_cell", key_cell(keys)).withColumn("_slot", F.when(F.expr(cell), slot)).drop("_cell")
    laid = cut_lineage(slotted)
    carry = (
        laid.filter(F.col("_slot").isNotNull())
        .groupBy(*keys, "_slot")
        .agg(*summary)
        .withColumns(across)
        .select(*keys, "_slot", *across)
    )
    joined = laid.withColumns(local).join(carry, [*keys, "_slot"], "left")
    merged = {
        name: F.greatest(name, f"_c_{name}")
        if name in running_max
        else F.coalesce(F.col(name), F.col(f"_c_{name}"))
        for name in local
    }
    return joined.withColumns(merged).select(*df.columns, *local)


def previous_event(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, cols: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Struct ``prev`` with the named columns of the row before, per key."""
    return ordered_context(df, keys, order, slot, previous=cols, hot_rows=hot_rows)


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slot: Column, cols: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Struct ``next`` with the named columns of the row after, per key."""
    return ordered_context(df, keys, order, slot, following=cols, hot_rows=hot_rows)


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slot: Column,
    name: str,
    value: Column,
    condition: Column,
) -> DataFrame:
    """Last value seen so far among the rows that meet the condition."""
    return ordered_context(
        df, keys, order, slot, running_last={name: F.when(condition, value)}
    )


def _ranged(df: DataFrame, order: Sequence) -> DataFrame:
    """Total order laid out in range partitions, with ``_part`` and ``_pos`` fixed per row."""
    laid_out = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    fixed = cut_lineage(laid_out)
    return fixed.withColumns(
        {
            "_part": F.shiftright("_mid", _ROW_BITS),
            "_pos": F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1),
        }
    ).drop("_mid")


def _part_offsets(ranged: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Totals of all earlier range partitions: as many rows as partitions, never data rows."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(*[c.alias(f"_o_{n}") for n, c in totals.items()])
    return sums.select(
        "_part", *[F.coalesce(F.sum(f"_o_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals]
    )


def number_rows(
    df: DataFrame, order: Sequence, name: str = "numero", prefix: str | None = None
) -> DataFrame:
    """Gap-free 1-based numbering over a total order, without a single-task sort."""
    ranged = _ranged(df, order)
    offsets = _part_offsets(ranged, {"n": F.count(F.lit(1))})
    number = F.col("_o_n") + F.col("_pos") + 1
    label = number if prefix is None else F.concat(F.lit(prefix), number.cast("string"))
    return (
        ranged.join(F.broadcast(offsets), "_part").withColumn(name, label).select(*df.columns, name)
    )


def prefix_sum(df: DataFrame, order: Sequence, cols: Mapping[str, str]) -> DataFrame:
    """Running totals of ``cols`` (source -> result) over a global total order."""
    ranged = _ranged(df, order)
    offsets = _part_offsets(ranged, {src: F.sum(src) for src in cols})
    upto = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    running = {out: F.sum(src).over(upto) + F.col(f"_o_{src}") for src, out in cols.items()}
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumns(running)
        .select(*df.columns, *cols.values())
    )


def cumulative_by_score(df: DataFrame, score: str, cols: Mapping[str, str]) -> DataFrame:
    """Totals of ``cols`` (source -> result) over rows scoring at least as much; ties move together."""
    per_score = df.groupBy(score).agg(*[F.sum(src).alias(src) for src in cols])
    return prefix_sum(per_score, [F.col(score).desc()], cols).select(score, *cols.values())


def rank_desc(df: DataFrame, col: str, name: str = "ranking") -> DataFrame:
    """Rank with ties, one plus the number of rows that are greater.

    Counts per distinct value are summed from the top and joined back; the rows themselves are
    never ordered in one place.
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    above = prefix_sum(counts, [F.col(col).desc_nulls_last()], {"_n": "_upto"})
    ranks = above.select(F.col(col).alias("_value"), (F.col("_upto") - F.col("_n") + 1).alias(name))
    return df.join(ranks, df[col].eqNullSafe(ranks["_value"])).drop("_value")


def share_of_total(
    df: DataFrame, col: str, part: Sequence[str] = (), name: str = "pct", digits: int = 2
) -> DataFrame:
    """Percentage of the total, overall or within ``part``; NULL over a zero total."""
    from corredor.operators.joins import with_scalar

    total = df.groupBy(*part).agg(F.sum(col).alias("_total"))
    joined = df.join(total, list(part), "left") if part else with_scalar(df, total)
    pct = F.col(col).cast("decimal(20,4)") * 100 / F.nullif(
        F.col("_total").cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)")
    )
    return joined.withColumn(name, F.round(pct, digits)).drop("_total")


def conditional_total(df: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """Conditional totals of the whole relation repeated on every row."""
    from corredor.operators.joins import with_scalar

    return with_scalar(df, df.agg(*[F.sum(c).alias(n) for n, c in totals.items()]))
