"""Folds, exact AUC and threshold decisions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corredor.functions.scalars import ratio
from corredor.operators.quality import _any, unique
from corredor.operators.ranking import arg_max
from corredor.operators.sets import union_all
from corredor.operators.windows import number_rows, prefix_sum

# Gain of a retained card and cost of a contact, in quetzales.
GAIN, COST = 15, 5


def stratified_folds(df: DataFrame, label: str, k: int, seed: int, unit: str = "unidad_id") -> DataFrame:
    """Fold per unit; disjoint, complete, reproducible and balanced inside each class.

    Units are numbered over (class, seeded hash) in range partitions, then dealt round-robin.
    """
    order_hash = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(unit)))
    keyed = df.withColumn("_h", order_hash)
    numbered = number_rows(keyed, [label, "_h", unit], "_n")
    return numbered.withColumn("fold", ((F.col("_n") - 1) % k).cast("int")).drop("_h", "_n")


def baselines(df: DataFrame, k: int, label: str = "etiqueta", recency: str = "dias_desde_ultimo_uso") -> DataFrame:
    """Constant training rate of the other folds, and recency, as scores of each unit."""
    per_fold = df.groupBy("fold").agg(F.sum(label).alias("_pos"), F.count(label).alias("_n"))
    total = per_fold.agg(F.sum("_pos").alias("_tp"), F.sum("_n").alias("_tn"))
    from corredor.operators.joins import with_scalar

    rates = with_scalar(per_fold, total).select(
        "fold", ratio(F.col("_tp") - F.col("_pos"), F.col("_tn") - F.col("_n")).alias("puntaje_tasa")
    )
    return df.join(rates, "fold").withColumn("puntaje_recencia", F.col(recency))


def roc_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, ties counted half, for all groups in one pass.

    Counts per score are summed in ascending order: positives meet the negatives below them.
    """
    counts = df.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("long")).alias("_p"), F.count_if(F.col(label) == 0).alias("_q")
    )
    laid_out = prefix_sum(counts, [*keys, score], {"_q": "_below"})
    start = [F.col("_below") - F.col("_q"), F.col("_p"), F.col("_q")]
    if keys:
        sizes = laid_out.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(F.min(start[0]).alias("_start"))
        laid_out = laid_out.join(sizes, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
        beneath = start[0] - F.col("_start")
    else:
        beneath = start[0]
    pairs = F.col("_p").cast("decimal(19,0)") * (2 * beneath + F.col("_q")).cast("decimal(19,0)")
    out = laid_out.groupBy(*keys).agg(
        F.sum(pairs).cast("double").alias("_pairs"), F.sum("_p").alias("positivos"), F.sum("_q").alias("negativos")
    )
    area = F.col("_pairs") / F.nullif(2.0 * F.col("positivos") * F.col("negativos"), F.lit(0.0))
    return out.withColumn("auc", area).drop("_pairs")


def _decision_columns(tp, n, positives, negatives, gain, cost):
    fp = n - tp
    return {
        "contactadas": n,
        "tp": tp,
        "fp": fp,
        "tn": negatives - fp,
        "fn": positives - tp,
        "precision": F.when(n > 0, tp / n).otherwise(F.lit(0.0)),
        "recall": F.when(positives > 0, tp / positives).otherwise(F.lit(0.0)),
        "ganancia_gtq": gain * tp - cost * n,
    }


def checked_score(score: Column) -> Column:
    """The score, or an error for one that is missing, not a number or outside 0 to 1."""
    s = score.cast("double")
    wrong = F.raise_error(F.concat(F.lit("score outside 0 to 1: "), F.coalesce(s.cast("string"), F.lit("null")))).cast("double")
    return F.when(s.isNull() | F.isnan(s) | ~s.between(0, 1), wrong).otherwise(s)


def threshold_table(
    df: DataFrame, label: str = "etiqueta", score: str = "puntaje", gain: int = GAIN, cost: int = COST
) -> DataFrame:
    """Outcome of contacting every unit with ``score >= threshold``, for each reachable set.

    Thresholds are the observed scores plus 0, 1/3, 1 and one above 1 (contact nobody). Ties are
    grouped before the running totals, so a threshold never splits them.
    """
    from corredor.operators.joins import with_scalar

    df = df.withColumn(score, checked_score(F.col(score)))
    per_score = df.groupBy(F.col(score).cast("double").alias("umbral")).agg(
        F.sum(F.col(label).cast("long")).alias("_tp"), F.count(F.lit(1)).alias("_n")
    )
    extra = df.sparkSession.createDataFrame(
        [(t, 0, 0) for t in (0.0, 1 / 3, 1.0, math.nextafter(1.0, math.inf))], "umbral double, _tp bigint, _n bigint"
    )
    every = per_score.unionByName(extra).groupBy("umbral").agg(F.sum("_tp").alias("_tp"), F.sum("_n").alias("_n"))
    running = prefix_sum(every, [F.desc("umbral")], {"_tp": "_hits", "_n": "_contacts"})
    totals = df.agg(F.sum(F.col(label).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_all"))
    joined = with_scalar(running, totals)
    columns = _decision_columns(
        F.col("_hits"), F.col("_contacts"), F.col("_pos"), F.col("_all") - F.col("_pos"), gain, cost
    )
    return joined.withColumns(columns).select("umbral", *columns)


def select_threshold(table: DataFrame) -> DataFrame:
    """Greatest gain, then fewest contacts, then highest threshold."""
    return arg_max(table, [F.col("ganancia_gtq"), -F.col("contactadas"), F.col("umbral")])


def evaluate_threshold(
    df: DataFrame, threshold: float, label: str = "etiqueta", score: str = "puntaje", gain: int = GAIN, cost: int = COST
) -> DataFrame:
    """Confusion counts, precision, recall and gain of one threshold."""
    if not 0 <= threshold <= math.nextafter(1.0, math.inf):
        raise ValueError(f"threshold {threshold} is outside 0 to 1")
    contact = checked_score(F.col(score)) >= F.lit(threshold)
    totals = df.agg(
        F.count_if(contact & (F.col(label) == 1)).alias("_tp"),
        F.count_if(contact).alias("_n"),
        F.count_if(F.col(label) == 1).alias("_pos"),
        F.count_if(F.col(label) == 0).alias("_neg"),
    )
    columns = _decision_columns(F.col("_tp"), F.col("_n"), F.col("_pos"), F.col("_neg"), gain, cost)
    return totals.withColumns(columns).select(F.lit(threshold).alias("umbral"), *columns)


def validate_oof(df: DataFrame, k: int, seed: int, cut: str = "A", score: str = "probabilidad_abandono") -> DataFrame:
    """Out-of-fold rows that break the contract, one row per unit and problem."""
    s = F.col(score).cast("double")
    checks = {
        "nulo": _any([F.col(c).isNull() for c in ("unidad_id", "corte", "etiqueta", "fold", score)]),
        "id_vacio": F.trim("unidad_id") == "",
        "corte": F.col("corte") != cut,
        "etiqueta": ~F.col("etiqueta").isin(0, 1),
        "probabilidad": F.isnan(s) | (s < 0) | (s > 1),
    }
    problems = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in checks.items()])
    )
    rows = df.select("unidad_id", F.explode(problems).alias("problema"))
    repeated = unique(df, ["unidad_id"]).select("unidad_id", F.lit("repetida").alias("problema"))
    expected = stratified_folds(df.select("unidad_id", "etiqueta"), "etiqueta", k, seed)
    moved = (
        df.select("unidad_id", F.col("fold").alias("_fold"))
        .join(expected.select("unidad_id", "fold"), "unidad_id")
        .filter(~F.col("fold").eqNullSafe(F.col("_fold")))
        .select("unidad_id", F.lit("fold").alias("problema"))
    )
    return union_all([rows, repeated, moved])
