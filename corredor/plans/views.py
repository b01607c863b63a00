"""Published views and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators.aggregates import global_max
from corredor.operators.joins import star_join, with_scalar
from corredor.operators.windows import conditional_total
from corredor.plans.gold import _pct

# Labels of the peak band.
PEAK_BAND = {True: "Hora pico", False: "Fuera de pico"}


def _demand_view(demand: DataFrame, kind: str, zone: str, count: str) -> DataFrame:
    return demand.filter(F.col("tipo_evento") == kind).select(
        "fecha", "hora", "es_dia_habil", "es_hora_pico",
        fx.label(F.col("es_hora_pico"), PEAK_BAND).alias("franja"),
        "modo",
        F.col("zona").alias(zone),
        F.col("cantidad_eventos").alias(count),
        "tarifa_total_gtq",
    )


def view_demand_boardings(demand: DataFrame) -> DataFrame:
    """M29."""
    return _demand_view(demand, "abordaje", "zona", "cantidad_abordajes")


def view_demand_trips(demand: DataFrame) -> DataFrame:
    """M30."""
    return _demand_view(demand, "viaje", "zona_origen", "viajes_iniciados")


def view_coverage(coverage: DataFrame) -> DataFrame:
    """Boardings and trips kept apart, each ranked on its own."""
    boardings = F.col("eventos_transmetro") + F.col("eventos_transurbano") + F.col("eventos_aerometro")
    base = coverage.select(
        "nombre_zona", "tipo_area", "tiene_servicio", "modos_con_servicio", "puntos_transporte",
        "puntos_transmetro", "puntos_transurbano", "puntos_metroriel", "puntos_aerometro",
        boardings.alias("abordajes"),
        F.col("eventos_transmetro").alias("abordajes_transmetro"),
        F.col("eventos_transurbano").alias("abordajes_transurbano"),
        F.col("eventos_aerometro").alias("abordajes_aerometro"),
        F.col("eventos_metroriel").alias("viajes_mr_iniciados"),
        "eventos_por_punto_transmetro", "eventos_por_punto_transurbano",
        "eventos_por_punto_aerometro", "viajes_por_estacion_metroriel",
    )
    total = F.sum("abordajes").over(Window.partitionBy())
    return base.withColumns(
        {
            "pct_abordajes_red": _pct(F.col("abordajes"), total),
            "ranking_abordajes": F.rank().over(Window.orderBy(F.desc("abordajes"))),
            "ranking_viajes_mr_origen": F.rank().over(Window.orderBy(F.desc("viajes_mr_iniciados"))),
        }
    )


def view_train_zones(train_zones: DataFrame) -> DataFrame:
    """The mart without its surrogate key."""
    return train_zones.drop("zona_sk")


def view_multimodality(users: DataFrame) -> DataFrame:
    """Identities by observed modes and method, with network totals on every row."""
    groups = users.groupBy("modos_observados", "metodo_identidad").agg(
        F.count(F.lit(1)).alias("usuarios")
    )
    n, modes = F.col("usuarios"), F.col("modos_observados")
    totals = conditional_total(
        groups,
        {
            "total_usuarios_observados": n,
            "usuarios_multimodales_total": F.when(modes > 1, n).otherwise(0),
            "usuarios_unimodales_total": F.when(modes == 1, n).otherwise(0),
        },
    )
    pct = _pct(F.col("usuarios_multimodales_total"), F.col("total_usuarios_observados"))
    return totals.withColumn("pct_usuarios_multimodales", pct)


def view_transfers(transfers: DataFrame) -> DataFrame:
    """Transfers per date, hour, pair of modes and pair of zones."""
    minutes = F.col("tiempo_transferencia_minutos")
    return transfers.groupBy(
        F.col("fecha_transbordo").alias("fecha"),
        F.col("hora_transbordo").alias("hora"),
        "modo_origen", "modo_destino", "combinacion_modos",
        "zona_origen", "zona_destino", "incluye_aerometro",
    ).agg(
        F.count(F.lit(1)).alias("total_transbordos"),
        fx.ratio(F.sum(minutes), F.count(minutes), 2).alias("tiempo_promedio_transferencia_minutos"),
        F.round(F.sum("tarifa_acumulada_gtq"), 2).alias("tarifa_total_gtq"),
    )


def demand_from_fact(boardings: DataFrame, zones: DataFrame, modes: DataFrame) -> DataFrame:
    """M35 A: boardings by mode, zone and hour straight from the fact."""
    hour = F.floor(F.col("tiempo_sk") / 10_000) % 100
    keyed = boardings.groupBy("modo_sk", "zona_sk", hour.alias("hora")).agg(
        F.sum("cantidad_abordajes").alias("abordajes")
    )
    named = star_join(
        keyed,
        {
            "modo_sk": modes.select("modo_sk", F.col("nombre_modo").alias("modo")),
            "zona_sk": zones.select("zona_sk", F.col("nombre_zona").alias("zona")),
        },
    )
    return named.select("modo", "zona", "hora", "abordajes")


def demand_by_mode_zone_hour(source: DataFrame, measure: str) -> DataFrame:
    """M35 B/C: the same question on the mart or the view."""
    if "tipo_evento" in source.columns:
        source = source.filter(F.col("tipo_evento") == "abordaje")
    return source.groupBy("modo", "zona", "hora").agg(F.sum(measure).alias("abordajes"))


def events_last_month(boardings: DataFrame, trips: DataFrame) -> DataFrame:
    """Boardings and trips of the month of the last observed instant, kept apart."""
    keys = [(boardings, "tiempo_sk"), (trips, "tiempo_ingreso_sk"), (trips, "tiempo_salida_sk")]
    month = global_max(keys, "_k").select(
        fx.month_start(fx.ts_from_key(F.col("_k"))).alias("inicio_mes")
    )

    start, end = F.col("inicio_mes"), F.add_months("inicio_mes", 1).cast("timestamp_ntz")
    low, high = (month.select(fx.ts_key(t.cast("timestamp_ntz")).alias("k")).scalar() for t in (start, end))

    def in_month(facts, column, name):
        # a range of the stored key: files, row groups and months outside it are skipped
        inside = facts.filter((F.col(column) >= low) & (F.col(column) < high))
        if "mes" in facts.columns:
            inside = inside.filter((F.col("mes") >= F.floor(low / 100_000_000)) & (F.col("mes") <= F.floor(high / 100_000_000)))
        return inside.agg(F.count(F.lit(1)).alias(name))

    out = with_scalar(
        with_scalar(month, in_month(boardings, "tiempo_sk", "abordajes_mes_tm_tu_am")),
        in_month(trips, "tiempo_ingreso_sk", "viajes_metroriel_mes"),
    )
    both = F.col("abordajes_mes_tm_tu_am") + F.col("viajes_metroriel_mes")
    return out.select(
        F.col("inicio_mes").cast("date").alias("mes"),
        "abordajes_mes_tm_tu_am",
        "viajes_metroriel_mes",
        both.alias("eventos_movilidad_mes"),
    )
