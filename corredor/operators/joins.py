"""Joins (J01-J14). No size hints: Spark broadcasts a side only below its checked threshold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, catalog: DataFrame, key: str, cols: Mapping[str, str]) -> DataFrame:
    """Left equi lookup of catalogue columns (catalogue name -> result name).

    The catalogue key must be unique (``unique`` checks it), as rows must not multiply.
    """
    side = catalog.select(key, *[F.col(c).alias(n) for c, n in cols.items()])
    return df.join(side, key, "left")


def star_join(fact: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """Inner join of a fact with dimensions, each on its surrogate key column."""
    return reduce(lambda acc, item: acc.join(item[1], item[0], "inner"), dims.items(), fact)


def join_on(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], cols: Mapping[str, str]
) -> DataFrame:
    """Inner composite-key join (left column -> right column) taking renamed right columns.

    Calling it twice with other keys and names plays two roles of the same catalogue.
    """
    side = right.select(
        *[F.col(r).alias(f"_k_{l}") for l, r in keys.items()],
        *[F.col(c).alias(n) for c, n in cols.items()],
    )
    on = reduce(lambda a, b: a & b, [left[l] == side[f"_k_{l}"] for l in keys])
    return left.join(side, on, "inner").drop(*[f"_k_{l}" for l in keys])


def universe_left(
    universe: DataFrame, facts: DataFrame, key: str, zero: Sequence[str]
) -> DataFrame:
    """Every member of the universe, measures filled with zero where there are no facts."""
    joined = universe.join(facts, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row relation on every row, as a scalar subquery.

    No cross join is planned, and Spark fails the job if the relation has more than one row.
    """
    packed = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    names = one_row.columns
    return (
        df.withColumn("_s", packed)
        .withColumns({n: F.col(f"_s.{n}") for n in names})
        .drop("_s")
    )


def exclude(df: DataFrame, other: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Anti join on a composite key (left column -> right column); never multiplies rows."""
    return exclude_where(df, other, keys)


def exclude_where(
    df: DataFrame, other: DataFrame, keys: Mapping[str, str], extra=None
) -> DataFrame:
    """Anti join with an extra condition ``extra(df, other)``."""
    on = [df[l] == other[r] for l, r in keys.items()]
    if extra is not None:
        on.append(extra(df, other))
    return df.join(other, reduce(lambda a, b: a & b, on), "left_anti")


def range_join(events: DataFrame, cuts: Column, condition) -> DataFrame:
    """Rows paired with every cut-off that satisfies ``condition(cut)``.

    The cut-offs are a short literal array (see ``cut_array``): each row filters and explodes
    it in place, so there is no join, no shuffle and no nested loop.
    """
    matching = events.withColumn("_cut", F.explode(F.filter(cuts, condition)))
    return matching.select("*", "_cut.*").drop("_cut")


def pit_join(
    pop: DataFrame, events: DataFrame, keys: Sequence[str], window_days: int,
    event_ts: str = "fecha_uso", known_ts: str = "disponible_desde", cut: str = "fecha_corte",
) -> DataFrame:
    """Events of each unit inside ``[cut - N days, cut)`` that were known before the cut."""
    joined = pop.join(events, list(keys), "inner")
    start = F.col(cut) - F.make_dt_interval(F.lit(window_days))
    return joined.filter(
        (F.col(event_ts) >= start) & (F.col(event_ts) < F.col(cut)) & (F.col(known_ts) < F.col(cut))
    )


def cross_operator_links(
    bridge: DataFrame, identity: str, operator: str, key: str, name: str = "otros_operadores"
) -> DataFrame:
    """Per (operator, key), the other operators that share its identity.

    A self join would emit every pair of keys of an identity. The set of operators per identity
    is bounded by the number of operators, so each key gets that set minus its own operator.
    """
    operators = bridge.groupBy(identity).agg(F.collect_set(operator).alias("_ops"))
    others = F.sort_array(F.array_remove(F.col("_ops"), F.col(operator)))
    return (
        bridge.join(operators, identity)
        .withColumn(name, others)
        .filter(F.size(name) > 0)
        .select(identity, operator, key, name)
    )


def reconcile(
    a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Keys missing on one side or with a differing column (NULL-safe), with both values.

    Keys must be unique on each side (see ``unique``); aggregate first where they are not.
    """
    left = a.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    right = b.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    differing = [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in cols]
    problem = reduce(lambda x, y: x | y, differing, F.col("_a").isNull() | F.col("_b").isNull())
    return left.join(right, list(keys), "full").filter(problem).drop("_a", "_b")


def join_using(a: DataFrame, b: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """``USING`` join with coalesced keys."""
    return a.join(b, list(cols), how)


def one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that break a one-to-one match: repeated or missing on either side."""
    counts = a.groupBy(key).agg(F.count(F.lit(1)).alias("filas_a")).join(
        b.groupBy(key).agg(F.count(F.lit(1)).alias("filas_b")), key, "full"
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("filas_a", "filas_b")}
    return counts.withColumns(zero).filter((F.col("filas_a") != 1) | (F.col("filas_b") != 1))


def count_flagged(
    base: DataFrame, flags: DataFrame, keys: Sequence[str], by: Sequence[str],
    total: str = "total", flagged: str = "marcados",
) -> DataFrame:
    """Members per group and how many of them carry a flag (flags unique per key)."""
    marks = flags.select(*keys, F.lit(1).alias("_flag"))
    return (
        base.join(marks, list(keys), "left")
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias(total), F.count("_flag").alias(flagged))
    )
