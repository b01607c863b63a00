"""Aggregations (A01-A18). All are distributive, so partial sums leave the map side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corredor.functions.scalars import ratio


def count_having(df: DataFrame, keys: Sequence[str], min_n: int, name: str = "n") -> DataFrame:
    """Group sizes of at least ``min_n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) >= min_n)


def distinct_counts(df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column]) -> DataFrame:
    """Exact distinct counts of expressions (result name -> expression)."""
    return df.groupBy(*keys).agg(*[F.countDistinct(c).alias(n) for n, c in cols.items()])


def conditional_counts(df: DataFrame, keys: Sequence[str], conds: Mapping[str, Column]) -> DataFrame:
    """Rows per group that meet each condition."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conds.items()])


def bounds(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``min_*`` and ``max_*`` per group."""
    parts = [f(c).alias(f"{p}_{c}") for c in cols for p, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(*keys).agg(*parts)


def money_sums(df: DataFrame, keys: Sequence[str], col: str, digits: int = 2) -> DataFrame:
    """Total and mean of a decimal column, both rounded half up."""
    amount = F.col(col)
    return df.groupBy(*keys).agg(
        F.round(F.sum(amount), digits).alias("total"),
        F.round(ratio(F.sum(amount), F.count(amount)), digits).alias("promedio"),
    )


def proportion(df: DataFrame, keys: Sequence[str], cond: Column, name: str = "proporcion") -> DataFrame:
    """Share of the rows of each group that meet the condition."""
    return df.groupBy(*keys).agg(ratio(F.count_if(cond), F.count(F.lit(1))).alias(name))


def any_true(cond: Column) -> Column:
    """A07."""
    return F.bool_or(cond)


def global_max(parts: Sequence[tuple[DataFrame, str]], name: str = "instante") -> DataFrame:
    """One row with the greatest value over several relations; each is reduced first."""
    tops = [df.agg(F.max(col).alias(name)) for df, col in parts]
    union = tops[0]
    for other in tops[1:]:
        union = union.unionByName(other)
    return union.agg(F.max(name).alias(name))


def mode_of(df: DataFrame, keys: Sequence[str], value: str, name: str = "moda") -> DataFrame:
    """Most frequent value per key, ties to the smallest; counted before it is chosen."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name)
    )


def conditional_sums(df: DataFrame, keys: Sequence[str], conds: Mapping[str, Column]) -> DataFrame:
    """A10: the counts of A03 recomputed as sums of ones, an independent path for audits."""
    return df.groupBy(*keys).agg(
        *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conds.items()]
    )


def set_per_key(df: DataFrame, keys: Sequence[str], col: str, name: str = "valores") -> DataFrame:
    """Sorted distinct values per key; for columns with a small fixed vocabulary."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(col)).alias(name))


def _row_hash(cols: Sequence[str], method: str) -> Column:
    if method == "xxhash64":
        return F.xxhash64(*cols).cast("decimal(38,0)")
    text = F.concat_ws(
        "\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in cols]
    )
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(
    df: DataFrame, exclude: Sequence[str] = (), keys: Sequence[str] = (), method: str = "xxhash64"
) -> DataFrame:
    """Row count and sum of row hashes, overall or per key.

    Independent of row order, sensitive to multiplicity, and a plain sum: no sort anywhere.
    Audit columns that change between runs are excluded.
    """
    cols = sorted(c for c in df.columns if c not in {*exclude, *keys})
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("filas"),
        F.coalesce(F.sum(_row_hash(cols, method)), F.lit(0)).cast("string").alias("huella"),
    )


def fingerprint_by(
    df: DataFrame, keys: Sequence[str], exclude: Sequence[str] = (), method: str = "xxhash64"
) -> DataFrame:
    """Fingerprint per group, such as per cut-off."""
    return fingerprint(df, exclude, keys, method)


def null_profile(df: DataFrame) -> DataFrame:
    """``(columna, nulos)`` from one pass over the relation."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.select(F.expr(f"stack({len(df.columns)}, {pairs}) AS (columna, nulos)"))


def profile(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Count, minimum, mean and maximum per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("filas"),
        F.min(col).alias("minimo"),
        F.avg(col).alias("media"),
        F.max(col).alias("maximo"),
    )


def medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact medians per group.

    The built-in median gathers the distinct values of a group in one task. Here the counts per
    value are laid out in total order, and the middle positions are read off running counts, so
    a group may be of any size.
    """
    from corredor.operators.windows import prefix_sum

    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols])
    )
    group = [*keys, "_col"]
    counts = (
        df.select(*keys, pairs.alias("_p"))
        .select(*keys, "_p._col", "_p._v")
        .filter(F.col("_v").isNotNull())
        .groupBy(*group, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    laid_out = prefix_sum(counts, [*group, "_v"], {"_n": "_upto"})
    sizes = laid_out.groupBy(*[F.col(k).alias(f"_g_{k}") for k in group]).agg(
        F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_size")
    )
    same_group = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in group]
    low = F.col("_start") + F.floor((F.col("_size") - 1) / 2)
    high = F.col("_start") + F.floor(F.col("_size") / 2)

    def covers(position):
        return (F.col("_upto") - F.col("_n") <= position) & (position < F.col("_upto"))

    weight = covers(low).cast("int") + covers(high).cast("int")
    middle = laid_out.join(sizes, same_group).withColumn("_w", weight).filter(F.col("_w") > 0)
    found = middle.groupBy(*group).agg((F.sum(F.col("_v") * F.col("_w")) / 2).alias("_m"))
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_col") == c, F.col("_m"))).alias(f"mediana_{c}") for c in cols]
    )


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A17."""
    return df.select(*cols).distinct()


def daily_coverage(
    df: DataFrame, keys: Sequence[str], ts: str, conds: Mapping[str, Column]
) -> DataFrame:
    """Number of distinct days with rows under each condition."""
    day = F.col(ts).cast("date")
    # one row per group and day first; what is left is at most the calendar
    per_day = df.groupBy(*keys, day.alias("_dia")).agg(
        *[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in conds.items()]
    )
    return per_day.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in conds])
