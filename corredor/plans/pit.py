"""Point-in-time population, labels, cost and features of cards.

Each use is expanded in place to the few cut-offs whose window it falls in, and counted per
(cut-off, operator, key). There is no event-level join, so a card with a large share of the
uses costs partial sums only. Windows are half-open ``[cut - N days, cut)`` and a use counts
only if it was known before the limit of its window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators.cdc import exclude_deleted
from corredor.operators.joins import range_join
from corredor.operators.ranking import head_sample
from corredor.plans.silver import AM

Cuts = Sequence[tuple[str, datetime]]
PRIOR_DAYS = 28
LABEL_DAYS = 30
FEATURE_WINDOWS = (28, 7, 14)
UNIT = ["operador", "llave_operacional"]
UNLABELLED = "C"


def _days(n: int):
    return F.make_dt_interval(F.lit(n))


def _span(uses: DataFrame, cuts: Cuts, before: int, after: int) -> DataFrame:
    """Uses inside the hull of all windows: a literal range that reaches the scan."""
    first, last = min(c for _, c in cuts), max(c for _, c in cuts)
    low = F.lit(str(first)).cast("timestamp_ntz") - _days(before)
    high = F.lit(str(last)).cast("timestamp_ntz") + _days(after)
    if "mes" in uses.columns:  # stored by month: other months are not read
        uses = uses.filter((F.col("mes") >= month_of(low)) & (F.col("mes") <= month_of(high)))
    return uses.filter((F.col("fecha_uso") >= low) & (F.col("fecha_uso") < high))


def month_of(moment):
    """Month of a timestamp as ``yyyyMM``."""
    return F.year(moment) * 100 + F.month(moment)


def _prior(cut, days):
    """Condition on a use: inside the prior window and known before the cut-off."""
    used, known = F.col("fecha_uso"), F.col("disponible_desde")
    return (used >= cut - _days(days)) & (used < cut) & (known < cut)


def _future(cut, days):
    used, known = F.col("fecha_uso"), F.col("disponible_desde")
    limit = cut + _days(days)
    return (used >= cut) & (used < limit) & (known < limit)


def card_population(
    uses: DataFrame,
    history: DataFrame,
    cuts: Cuts,
    prior_days: int = PRIOR_DAYS,
    label_days: int = LABEL_DAYS,
    min_uses: int = 2,
) -> DataFrame:
    """Card x cut-off with enough prior uses and no DELETE before the cut-off.

    The label is 1 when no use follows inside the label window; cut-off C has no label.
    """
    spread = range_join(
        _span(uses, cuts, prior_days, label_days),
        fx.cut_array(cuts),
        lambda c: _prior(c["fecha_corte"], prior_days)
        | (_future(c["fecha_corte"], label_days) & (c["corte"] != UNLABELLED)),
    )
    cut = F.col("fecha_corte")
    counted = spread.groupBy("corte", "fecha_corte", *UNIT).agg(
        F.count_if(_prior(cut, prior_days)).alias("previos"),
        F.count_if(_future(cut, label_days)).alias("futuros"),
    )
    kept = exclude_deleted(counted.filter(F.col("previos") >= min_uses), history)
    labelled = F.col("corte") != UNLABELLED
    return kept.select(
        fx.md5_key(*[F.col(c) for c in UNIT]).alias("unidad_id"),
        *UNIT,
        "corte",
        "fecha_corte",
        F.col("previos").alias(f"eventos_previos_{prior_days}d"),
        F.when(labelled, F.col("futuros")).alias(f"eventos_futuros_{label_days}d"),
        F.when(labelled, F.when(F.col("futuros") == 0, 1).otherwise(0)).alias("etiqueta"),
    )


def card_cost(
    pop: DataFrame, uses: DataFrame, bridge: DataFrame, cuts: Cuts, label_days: int = LABEL_DAYS
) -> DataFrame:
    """Per cut-off, positives whose inferred identity is active at another operator.

    Activity is kept as the set of operators per identity and cut-off, which is bounded by the
    number of operators; keys of one identity are never paired with each other.
    """
    labelled_cuts = [(n, c) for n, c in cuts if n != UNLABELLED]
    linkable = bridge.filter(
        (F.col("metodo_match") == "PATRON_NUMERICO_INFERIDO")
        & fx.has_prefix(F.col("usuario_canonico_id"), "USR-")
        & (F.col("sistema_origen") != AM)
    ).select(
        F.col("sistema_origen").alias("operador"),
        F.col("llave_origen").alias("llave_operacional"),
        "usuario_canonico_id",
    )
    active = (
        range_join(
            _span(uses, labelled_cuts, 0, label_days),
            fx.cut_array(labelled_cuts),
            lambda c: _future(c["fecha_corte"], label_days),
        )
        .select("corte", *UNIT)
        .distinct()
        .join(linkable, UNIT)
        .groupBy("corte", "usuario_canonico_id")
        .agg(F.collect_set("operador").alias("_activos"))
    )
    positive = F.col("etiqueta") == 1
    flagged = (
        pop.filter(F.col("corte") != UNLABELLED)
        .join(linkable, UNIT, "left")
        .join(active, ["corte", "usuario_canonico_id"], "left")
        .withColumn("_otra", positive & (F.size(F.array_remove("_activos", F.col("operador"))) > 0))
    )
    counted = flagged.groupBy("corte").agg(
        F.count("unidad_id").alias("poblacion"),
        F.count_if(positive).alias("positivos"),
        F.count_if(F.col("_otra")).alias("positivos_con_actividad_otro_operador"),
        F.count_if(positive & (F.col("operador") == AM)).alias("positivos_aerometro"),
    )
    base = fx.constant_relation(
        pop.sparkSession,
        [(n, c) for n, c in labelled_cuts],
        "corte string, fecha_corte timestamp_ntz",
    ).join(counted, "corte", "left")

    def n(name):
        return F.coalesce(F.col(name), F.lit(0))

    return base.select(
        "corte",
        "fecha_corte",
        n("poblacion").alias("poblacion"),
        n("positivos").alias("positivos"),
        fx.ratio(n("positivos"), n("poblacion"), 8).alias("tasa_positiva"),
        n("positivos_con_actividad_otro_operador").alias("positivos_con_actividad_otro_operador"),
        fx.ratio(n("positivos_con_actividad_otro_operador"), n("positivos"), 8).alias("proporcion_costo"),
        n("positivos_aerometro").alias("positivos_aerometro"),
    )


def card_features(
    pop: DataFrame, uses: DataFrame, cuts: Cuts, windows: Sequence[int] = FEATURE_WINDOWS
) -> DataFrame:
    """Ten features per card and cut-off; operators are never linked.

    Active days are bits of a few numbers, one for each 60 days of the window, which leaves a single
    distinct count: uses are reduced per (card, cut-off, point) and then per (card, cut-off).
    """
    longest, *shorter = windows
    cut, used = F.col("fecha_corte"), F.col("fecha_uso")
    spread = range_join(
        _span(uses, cuts, longest, 0), fx.cut_array(cuts), lambda c: _prior(c["fecha_corte"], longest)
    )
    day = F.datediff(cut, used)  # 0 to ``longest``
    masks = [
        F.bit_count(F.bit_or(F.when(F.floor(day / 60) == i, F.call_function("shiftleft", F.lit(1).cast("long"), day % 60)).otherwise(0)))
        for i in range(longest // 60 + 1)
    ]
    unit = spread.groupBy("corte", "fecha_corte", *UNIT).agg(
        F.count(F.lit(1)).alias(f"viajes_{longest}d"),
        *[F.count_if(used >= cut - _days(w)).alias(f"viajes_{w}d") for w in shorter],
        reduce(add, masks).cast("long").alias(f"dias_activos_{longest}d"),
        F.countDistinct("punto_origen").alias(f"puntos_origen_{longest}d"),
        F.max(used).alias("_ultimo"),
        F.sum("tarifa_quetzales").alias(f"gasto_{longest}d_gtq"),
        F.count("tarifa_quetzales").alias("_con_tarifa"),
        F.count_if(fx.is_peak(used)).alias("_pico"),
        F.count_if(fx.iso_dow(used) >= 6).alias("_finde"),
    )
    total = F.col(f"viajes_{longest}d")
    return (
        pop.select("unidad_id", "corte", "fecha_corte", *UNIT, "etiqueta")
        .join(unit, ["corte", "fecha_corte", *UNIT])
        .select(
            "unidad_id",
            "corte",
            "fecha_corte",
            "operador",
            *[f"viajes_{w}d" for w in windows],
            f"dias_activos_{longest}d",
            fx.elapsed(F.col("_ultimo"), cut, "days").alias("dias_desde_ultimo_uso"),
            f"gasto_{longest}d_gtq",
            fx.ratio(F.col(f"gasto_{longest}d_gtq"), F.col("_con_tarifa")).alias("tarifa_media_gtq"),
            f"puntos_origen_{longest}d",
            fx.ratio(F.col("_pico"), total).alias("proporcion_hora_pico"),
            fx.ratio(F.col("_finde"), total).alias("proporcion_fin_semana"),
            "etiqueta",
        )
    )




def future_rows(
    sources: Mapping[str, DataFrame], cut: datetime, days: int, sample: int | None = None
) -> dict[str, DataFrame]:
    """Later rows for the invariance audit, made from every row of each source (or the first ``sample``).

    The rows of an event source recur on each of the following days, the train also gets
    trips that were open at the cut-off and closed after it, and the cards of the history
    get a DELETE per day. None of them was known at the cut-off.
    """
    base = F.lit(str(cut)).cast("timestamp_ntz")
    day = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    noon = base + F.make_dt_interval(days=F.col("_day"), hours=F.lit(12))
    minute = F.make_dt_interval(mins=F.lit(1))

    def first_rows(df, order):
        return df if sample is None else head_sample(df, order, sample)

    def prefixed(name, *parts):
        return F.concat(F.lit(name), *parts, F.col("bronze_record_id"))

    new_id = prefixed("futuro:", F.col("_day").cast("string"), F.lit(":"))
    added: dict[str, DataFrame] = {}
    for name, df in sources.items():
        columns = set(df.columns)
        if "bronze_record_id" in columns:
            first = first_rows(df, ["bronze_record_id"])
            moved = {"bronze_record_id": new_id}
            if "fecha_hora_ingreso" in columns:
                moved.update({"fecha_hora_ingreso": noon, "fecha_hora_salida": noon + F.make_dt_interval(mins=F.lit(20))})
            else:
                moved["fecha_hora"] = noon
            added[name] = first.withColumn("_day", day).withColumns(moved).drop("_day")
            if "fecha_hora_ingreso" in columns:
                open_trip = first.withColumns(
                    {
                        "bronze_record_id": prefixed("cierre:"),
                        "fecha_hora_ingreso": base - minute,
                        "fecha_hora_salida": base + minute,
                    }
                )
                added[name] = added[name].unionByName(open_trip)
        elif "operacion" in columns:
            first = first_rows(df, ["tarjeta_id", "valid_from"])
            closed = {"operacion": F.lit("DELETE"), "valid_from": noon}
            added[name] = first.withColumn("_day", day).withColumns(closed).drop("_day")
        elif "id_registro_crudo" in columns:
            first = first_rows(df, ["fuente", "id_registro_crudo"])
            added[name] = first.withColumn("id_registro_crudo", F.concat(F.lit("futuro:"), "id_registro_crudo"))
    return added
