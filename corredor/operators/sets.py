"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(dfs: Sequence[DataFrame], schema: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Bag union; with a schema, every input is projected and cast to it first."""
    if schema:
        dfs = [df.select(*[F.col(n).cast(t).alias(n) for n, t in schema]) for df in dfs]
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_distinct(dfs: Sequence[DataFrame]) -> DataFrame:
    """Set union."""
    return union_all(dfs).distinct()


def symmetric_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity; ``lado`` tells which.

    One aggregation of signed counts instead of two ``EXCEPT ALL``: equal rows cancel on the
    map side, so identical relations shuffle almost nothing.
    """
    cols = a.columns
    signed = a.select(*cols, F.lit(1).alias("_n")).unionAll(b.select(*cols, F.lit(-1).alias("_n")))
    net = signed.groupBy(*cols).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)
    copies = F.explode(F.sequence(F.lit(1), F.abs("_n")))
    side = F.when(F.col("_n") > 0, F.lit("izquierda")).otherwise(F.lit("derecha"))
    return net.withColumns({"lado": side, "_copy": copies}).drop("_n", "_copy")
