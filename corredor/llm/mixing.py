"""Mixing sources to target weights by budget fitting over document lengths.

Sources, in code point order with null last, weigh ``weights`` in turn and share ``budget`` times all
words. A target stops at ``cap`` times its source's words; the excess goes to the others by weight. This
is one level ``min(weight * level, cap * words)``, found by prefix sums over the sources sorted by the
point at which they fill up.

Within a source every document is taken ``base = floor(target / words)`` times; what is left of the target
is a subset sum over documents, fitted on counts by exact length: each length gives its proportional
share, then a bounded-knapsack programme over the leftover counts (bit sets of reachable sums) fills the
rest as closely as the leftover can. Where the rest is wider than ``DP_WORDS``, documents in a scattered order
narrow it first; if the programme then misses the rest, it runs again over its whole width. Documents of a
length are chosen in the order of a seeded hash. Only counts by (source, length) reach a task; documents are
ranked inside 64 hash slots of their (source, length), so a length that a third of all rows share is never
ranked in one task.

Null text has size 0; sources whose words are 0 have target 0; a document of size 0 takes 0 words.
Repeated rows are documents of their own. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corredor.llm.util import steps, strings, words_of, written

SLOTS = 64
#: Width of the rest, in units of the lengths' common grain, above which documents narrow it first.
DP_WORDS = 65_536


def _count(batches):
    for batch in batches:
        text, sizes = strings(batch.column(2)), []
        for i, j in steps(text):
            sizes.append(words_of(text.slice(i, j - i)).per_text)
        size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64())], ["doc_id", "source", "size"])


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, h, slot), written once: the later passes read only this."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(
        _count, f"doc_id {kind}, source string, size long"
    )
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return written(out.select("*", h.alias("h"), F.pmod(h, F.lit(SLOTS)).cast("int").alias("slot")), "mixing-sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """(source, source_size, target): one row per source, windows over these rows only."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights)))))
    rows = rows.withColumn("most", cap * F.col("source_size"))
    full_at = F.col("most") / F.col("weight")
    upto = Window.orderBy(full_at, F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    spent = F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = (budget * F.sum("source_size").over(everything) - spent) / open_weight
    # rows below the level are full; of the rest the first has the true level, which is the largest
    rows = rows.withColumn("level", F.when(full_at >= level, level))
    return rows.select(
        "source", "source_size",
        F.least(F.col("most"), F.coalesce(F.col("weight") * F.max("level").over(everything), F.col("most"))).alias("target"),
    )


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``, or as near below it as can be.

    Each length first gives the floor of its proportional share; the sum is the best that the leftover documents allow.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    take = np.floor(counts * (budget / total)).astype(np.int64)
    spare = np.where(sizes > 0, counts - take, 0)
    open_sizes = sizes[spare > 0]
    rest = budget - int((sizes * take).sum())
    if rest <= 0 or not len(open_sizes):
        return take
    order = np.argsort(mix_order(sizes), kind="stable")
    grain = int(np.gcd.reduce(open_sizes))  # sums are multiples of it
    units, width = sizes // grain, rest // grain
    near = _narrow(units, spare, width, order)
    left = width - int((units * near).sum())
    fill = _subset(units, spare - near, left, order)
    if left == int((units * fill).sum()):
        return take + near + fill
    return take + _subset(units, spare, width, order)


def _narrow(units: np.ndarray, spare: np.ndarray, width: int, order: np.ndarray) -> np.ndarray:
    """One document of each length in turn, until ``DP_WORDS`` or less is left."""
    near = np.zeros_like(spare)
    moved = True
    while width > DP_WORDS and moved:
        moved = False
        for i in order:
            if near[i] < spare[i] and units[i] <= width and width > DP_WORDS:
                near[i], width, moved = near[i] + 1, width - int(units[i]), True
    return near


def _subset(units: np.ndarray, spare: np.ndarray, width: int, order: np.ndarray) -> np.ndarray:
    """Documents whose lengths have the greatest sum up to ``width``: bit ``s`` of a number says that ``s`` can be reached.

    Only every ``apart``-th bit set is kept on the way and those between are made again on the way back, so the memory is
    that of some ``2 * sqrt(layers)`` bit sets.
    """
    layers = []
    for i in order:
        left, chunk = int(min(spare[i], width // int(units[i]))) if units[i] > 0 else 0, 1
        while left > 0:  # counts as powers of two
            k = min(chunk, left)
            layers.append((int(i), k, k * int(units[i])))
            left, chunk = left - k, chunk * 2
    take, mask, reach = np.zeros_like(spare), (1 << (width + 1)) - 1, 1
    apart, kept, used = max(1, int(len(layers) ** 0.5)), [], 0
    for n, (_, _, words) in enumerate(layers):
        if reach >> width & 1:
            break
        if n % apart == 0:
            kept.append(reach)
        reach, used = reach | (reach << words) & mask, n + 1
    at = reach.bit_length() - 1
    for first in range((len(kept) - 1) * apart, -1, -apart):
        reach, part, before = kept[first // apart], layers[first : min(first + apart, used)], []
        for _, _, words in part:
            before.append(reach)
            reach |= (reach << words) & mask
        for (i, k, words), was in zip(reversed(part), reversed(before)):
            if not was >> at & 1:
                take[i] += k
                at -= words
    return take


def mix_order(sizes: np.ndarray) -> np.ndarray:
    return (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    rows["take"] = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), int(rows["residual"].iloc[0]))
    return rows[["source", "size", "take"]]


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = sized(docs, seed)
    goal = targets(sizes, weights, budget, cap)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = written(
        goal.select("*", base.alias("base")).withColumn(
            "residual", F.round(F.col("target") - F.col("base") * F.col("source_size")).cast("long")
        ),
        "mixing-targets",
    )
    counts = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    same_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = counts.join(goal, same_source(counts, goal)).select(counts["source"], "size", "n", "residual")
    plan = plan.groupBy("source").applyInPandas(_fit_source, "source string, size long, take long")
    slots = sizes.groupBy("source", "size", "slot").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    slots = slots.join(plan, same_source(slots, plan) & (slots["size"] == plan["size"])).select(
        slots["source"].alias("s"), slots["size"].alias("z"), slots["slot"].alias("k"),
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - F.col("before"))).alias("take"),
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "slot").orderBy("h", "doc_id"))
    ranked = sizes.withColumn("rank", rank)
    ranked = ranked.join(slots, ranked["source"].eqNullSafe(slots["s"]) & (ranked["size"] == slots["z"]) & (ranked["slot"] == slots["k"]))
    goal = goal.select(F.col("source").alias("g"), "source_size", "target", "base")
    copies = F.col("base") + (F.col("rank") <= F.col("take")).cast("long")
    return ranked.join(goal, ranked["source"].eqNullSafe(goal["g"])).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0, 1 or 2 times), all columns as they were, whatever their names.

    Rows that share both id and source are told apart by nothing else: all come as often as the most taken of them.
    """
    plan = mix(docs).filter("copies > 0").groupBy("doc_id", "source").agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = rows["row.doc_id"].eqNullSafe(plan["doc_id"]) & rows["row.source"].cast("string").eqNullSafe(plan["source"])
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return rows.join(plan, same).select("row", copies).select("row.*")
