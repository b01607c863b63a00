"""Evidence tables (M37, M38): published figures recomputed along another path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators.aggregates import conditional_sums, daily_coverage, set_per_key
from corredor.operators.cdc import exclude_deleted
from corredor.operators.joins import range_join, reconcile
from corredor.operators.sets import union_all
from corredor.plans.pit import LABEL_DAYS, PRIOR_DAYS, UNIT, UNLABELLED, Cuts, _days, _future, _prior
from corredor.plans.silver import AM


def population_evidence(
    pop: DataFrame,
    uses: DataFrame,
    history: DataFrame,
    bridge: DataFrame,
    cuts: Cuts,
    prior_days: int = PRIOR_DAYS,
    label_days: int = LABEL_DAYS,
) -> DataFrame:
    """Per labelled cut-off and operator: population, positives, differences against an
    independent recount, recomputed cost, the first and last use and the days covered on both sides of the cut-off."""
    labelled = [(n, c) for n, c in cuts if n != UNLABELLED]
    cut = F.col("fecha_corte")

    def hull(k):
        c = k["fecha_corte"]
        return (
            (F.col("fecha_uso") >= c - _days(prior_days))
            & (F.col("fecha_uso") < c + _days(label_days))
            & (F.col("disponible_desde") < c + _days(label_days))
        )

    spread = range_join(uses, fx.cut_array(labelled), hull)
    recount = conditional_sums(
        spread,
        ["corte", "fecha_corte", *UNIT],
        {
            "previos": (F.col("fecha_uso") < cut) & (F.col("disponible_desde") < cut),
            "futuros": F.col("fecha_uso") >= cut,
        },
    ).filter(F.col("previos") >= 2)
    expected = exclude_deleted(recount, history).withColumn(
        "etiqueta", F.when(F.col("futuros") == 0, 1).otherwise(0)
    )
    published = pop.filter(F.col("corte") != UNLABELLED).withColumnsRenamed(
        {f"eventos_previos_{prior_days}d": "previos", f"eventos_futuros_{label_days}d": "futuros"}
    )
    group = ["corte", "operador"]
    differences = (
        reconcile(expected, published, ["corte", *UNIT], ["previos", "futuros", "etiqueta"])
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("diferencias"))
    )
    linkable = bridge.filter(
        (F.col("metodo_match") == "PATRON_NUMERICO_INFERIDO")
        & fx.has_prefix(F.col("usuario_canonico_id"), "USR-")
        & (F.col("sistema_origen") != AM)
    ).select(
        F.col("sistema_origen").alias("operador"), F.col("llave_origen").alias("llave_operacional"), "usuario_canonico_id"
    )
    later = spread.filter(F.col("fecha_uso") >= cut).select("corte", *UNIT).distinct().join(linkable, UNIT)
    operators = set_per_key(later, ["corte", "usuario_canonico_id"], "operador", "_ops")
    cost = (
        published.filter(F.col("etiqueta") == 1)
        .join(linkable, UNIT)
        .join(operators, ["corte", "usuario_canonico_id"])
        .groupBy(*group)
        .agg(F.count_if(F.size(F.array_remove("_ops", F.col("operador"))) > 0).alias("costo_recalculado"))
    )
    # the windows' uses are spread already; operators without any still get their row
    bounds = uses.groupBy("operador").agg(F.min("fecha_uso").alias("primer_uso"), F.max("fecha_uso").alias("ultimo_uso"))
    universe = bounds.withColumn("_cut", F.explode(fx.cut_array(labelled)))
    covered = daily_coverage(
        spread,
        group,
        "fecha_uso",
        {"dias_previos": _prior(cut, prior_days), "dias_futuros": _future(cut, label_days)},
    )
    days = universe.select("_cut.corte", "operador", "primer_uso", "ultimo_uso").join(covered, group, "left")
    counted = published.groupBy(*group).agg(
        F.count(F.lit(1)).alias("poblacion"), F.count_if(F.col("etiqueta") == 1).alias("positivos")
    )
    joined = counted.join(days, group, "full").join(differences, group, "full").join(cost, group, "left")
    measures = ["poblacion", "positivos", "diferencias", "costo_recalculado", "dias_previos", "dias_futuros"]
    return joined.select(*group, "primer_uso", "ultimo_uso", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in measures])


def layer_profile(
    silver: Mapping[str, DataFrame], features: DataFrame, users: DataFrame, transfers: DataFrame
) -> DataFrame:
    """``(relacion, metrica, valor)``: bounds per source, features, identities, transfers.

    Instants are given as ``yyyyMMddHHmmss`` numbers. One pass per relation.
    """

    def unpivot(df, relation, prefix=""):
        names = df.columns
        pairs = ", ".join(f"'{prefix}{n}', CAST(`{n}` AS DOUBLE)" for n in names)
        stacked = df.select(F.expr(f"stack({len(names)}, {pairs}) AS (metrica, valor)"))
        return stacked.select(F.lit(relation).alias("relacion"), "metrica", "valor")

    parts = []
    for operator, df in silver.items():
        moment = "fecha_hora_ingreso" if "fecha_hora_ingreso" in df.columns else "fecha_hora"
        parts.append(
            unpivot(
                df.agg(
                    F.count(F.lit(1)).alias("eventos"),
                    fx.ts_key(F.min(moment)).alias("minimo"),
                    fx.ts_key(F.max(moment)).alias("maximo"),
                ),
                operator,
            )
        )
    nulls = {f"nulos_{c}": F.count_if(F.col(c).isNull()) for c in features.columns}
    parts.append(
        unpivot(
            features.agg(
                F.count(F.lit(1)).alias("filas"),
                F.countDistinct("usuario_canonico_id").alias("usuarios_unicos"),
                F.count_if("es_multimodal").alias("usuarios_multimodales"),
                *[F.sum(c).alias(c) for c in ("total_eventos", "eventos_ultimos_7_dias", "eventos_ultimos_30_dias", "eventos_ultimos_90_dias")],
                F.count_if(F.col("ultimo_evento") > F.col("fecha_corte")).alias("posteriores_al_corte"),
                *[c.alias(n) for n, c in nulls.items()],
            ),
            "features",
        )
    )

    def frequency(df, relation, col):
        counts = df.groupBy(col).agg(F.count(F.lit(1)).cast("double").alias("valor"))
        metric = F.concat(F.lit(f"{col}="), F.col(col).cast("string")).alias("metrica")
        return counts.select(F.lit(relation).alias("relacion"), metric, "valor")

    parts += [
        frequency(features, "features", "modos_utilizados"),
        frequency(users, "usuarios", "modos_observados"),
        frequency(users, "usuarios", "metodo_identidad"),
        frequency(transfers, "transbordos", "combinacion_modos"),
    ]
    minutes = F.col("tiempo_transferencia_minutos")
    parts.append(
        unpivot(
            transfers.agg(
                F.count(F.lit(1)).alias("total"),
                F.min(minutes).alias("minimo_minutos"),
                F.max(minutes).alias("maximo_minutos"),
                fx.ratio(F.sum(minutes), F.count(minutes), 6).alias("promedio_minutos"),
                F.count_if("incluye_aerometro").alias("incluye_aerometro"),
            ),
            "transbordos",
        )
    )
    return union_all(parts)
