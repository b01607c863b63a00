"""Connected components as DataFrame rounds (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corredor.llm.util import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round is two group minima beside the links, one shuffle each, written to the shared folder. Stars shrink
    to the smallest node in O(log^2) rounds; if ``rounds`` do not suffice it is an error, never a
    partial result. Self links name a node only. Nulls are left out.
    """
    links = links.select("a", "b").filter("a is not null and b is not null")
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = edges.filter("u <> v")
    state = _state(edges)
    for _ in range(rounds):
        if state[0] == 0:
            break
        edges = written(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges, nodes["node"] == edges["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least("u", F.min("v").over(Window.partitionBy("u")))
    return both.select("u", "v", least.alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each row names its far node or, where that is the least one, the node itself: as many rows as before."""
    least = edges.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
    return least.select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()
