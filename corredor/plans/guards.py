"""Guards of the published relations: each mart against the facts, each view against its mart (Q06-Q11).

Areas, modes and pairs of modes are vocabularies, so what is compared here is small after one aggregation of
the facts per guard. Facts of unknown areas are in no mart; the guards count the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators import quality
from corredor.operators.joins import reconcile, universe_left, with_scalar
from corredor.operators.quality import Violations
from corredor.operators.sets import union_all
from corredor.operators.windows import prefix_sum
from corredor.plans.silver import AM, MODE_SUFFIX, MR, TM, TU

# Columns that identify a person or a card.
RAW_IDENTIFIERS = (
    "usuario_sk", "usuario_canonico_id", "llave_origen", "tarjeta", "tarjeta_id", "id_tarjeta", "tarjeta_mr", "num_tarjeta",
    "card", "user_hash",
)


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(0))


def coverage_totals(coverage: DataFrame, demand: DataFrame) -> Violations:
    """Events of the coverage mart that are not those of the demand mart, in total or in a mode; or not their sum."""
    n, parts = F.col("cantidad_eventos"), {m: f"eventos_{s}" for m, s in MODE_SUFFIX.items()}
    totals = {c: (F.col(c), F.when(F.col("modo") == m, n)) for m, c in parts.items()}
    found = coverage.select(
        F.col("nombre_zona").alias("detalle"), "eventos_totales", *parts.values()
    )
    apart = quality.parts_sum(found, list(parts.values()), "eventos_totales").select("detalle")
    other = quality.totals_match(coverage, demand, {"eventos_totales": (F.col("eventos_totales"), n), **totals})
    return apart.unionByName(other.select(F.lit("total").alias("detalle")))


def train_zone_grain(mart: DataFrame, points: DataFrame, zones: DataFrame) -> Violations:
    """Areas with stations in the catalogue and rows of the mart that are not one to one, by key, name and stations."""
    stations = points.filter(F.col("modo") == MR).groupBy("zona_sk").agg(F.count(F.lit(1)).alias("estaciones_metroriel"))
    expected = stations.join(zones.select("zona_sk", "nombre_zona"), "zona_sk")
    given = mart.withColumn("estaciones_metroriel", F.col("estaciones_metroriel").cast("long"))
    repeated = quality.unique(mart, ["zona_sk"]).select("zona_sk")
    return repeated.unionByName(reconcile(expected, given, ["zona_sk"], ["nombre_zona", "estaciones_metroriel"]).select("zona_sk"))


def _area_use(boardings: DataFrame, trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Events of every area of the network by mode, from the facts."""
    used = boardings.select("zona_sk", F.col("fuente_evento").alias("modo"), F.col("cantidad_abordajes").alias("n")).unionAll(
        trips.select(F.col("zona_origen_sk").alias("zona_sk"), F.lit(MR).alias("modo"), F.col("cantidad_viajes").alias("n"))
    )
    per_mode = {m: f"abordajes_{MODE_SUFFIX[m]}" for m in (TM, TU, AM)} | {MR: "viajes_metroriel_iniciados"}
    sums = used.groupBy("zona_sk").agg(*[F.sum(F.when(F.col("modo") == m, F.col("n"))).alias(c) for m, c in per_mode.items()])
    network = universe_left(zones.select("zona_sk", "nombre_zona"), sums, "zona_sk", list(per_mode.values()))
    others = sum((_zero(F.col(per_mode[m])) for m in (TM, TU, AM)), F.lit(0))
    return network.withColumn("abordajes_otros_modos", others)


def train_zone_totals(mart: DataFrame, boardings: DataFrame, trips: DataFrame, zones: DataFrame) -> Violations:
    """Rows of the mart whose events are not those of the facts."""
    columns = [
        *[f"abordajes_{MODE_SUFFIX[m]}" for m in (TM, TU, AM)], "viajes_metroriel_iniciados", "abordajes_otros_modos",
    ]
    use = _area_use(boardings, trips, zones).select("zona_sk", *[_zero(F.col(c)).alias(f"_{c}") for c in columns])
    wrong = reduce(lambda a, b: a | b, [fx.differs(F.col(c).cast("long"), F.col(f"_{c}")) for c in columns])
    return mart.join(use, "zona_sk", "left").filter(wrong).select("nombre_zona")


def train_zone_ranking(mart: DataFrame, boardings: DataFrame, trips: DataFrame, zones: DataFrame) -> Violations:
    """Rows of the mart whose rank, share or network totals are not those of all areas.

    The rank is one plus the number of areas with more boardings, counted per distinct number of boardings.
    """
    use = _area_use(boardings, trips, zones).select("zona_sk", "abordajes_otros_modos")
    per_value = use.groupBy("abordajes_otros_modos").agg(F.count(F.lit(1)).alias("_n"))
    upto = prefix_sum(per_value, [F.col("abordajes_otros_modos").desc()], {"_n": "_upto"})
    ranks = use.join(upto, "abordajes_otros_modos").select(
        "zona_sk", F.col("abordajes_otros_modos").alias("_uso"), (F.col("_upto") - F.col("_n") + 1).alias("_rango")
    )
    network = use.agg(F.sum("abordajes_otros_modos").alias("_red"), F.count(F.lit(1)).alias("_areas"))
    joined = with_scalar(mart.join(ranks, "zona_sk", "left"), network)
    exact = F.col("_uso").cast("decimal(20,4)") * 100 / F.nullif(F.col("_red").cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)"))
    share = F.col("pct_abordajes_otros_modos_red").cast("decimal(20,2)")
    wrong = [
        fx.differs(F.col("ranking_demanda_otros_modos").cast("long"), F.col("_rango")),
        fx.differs(F.col("total_abordajes_otros_modos_red").cast("long"), F.col("_red")),
        fx.differs(F.col("areas_en_ranking_red").cast("long"), F.col("_areas")),
        fx.differs(share, F.coalesce(F.round(exact, 2), F.lit(0)).cast("decimal(20,2)")),
    ]
    return joined.filter(reduce(lambda a, b: a | b, wrong)).select("nombre_zona")


def view_totals(views: Mapping[str, DataFrame], boardings: DataFrame, trips: DataFrame, zones: DataFrame) -> Violations:
    """Published boardings and trips, by demand view and by coverage view, that are not those of the facts."""
    known = zones.select("zona_sk")
    boarded = boardings.join(known, "zona_sk", "left_semi")
    started = trips.join(known.withColumnRenamed("zona_sk", "zona_origen_sk"), "zona_origen_sk", "left_semi")
    n = {"abordajes": F.col("cantidad_abordajes"), "viajes": F.col("cantidad_viajes")}
    cases = [
        ("demanda_abordajes", boarded, n["abordajes"], views["gold.v_demanda_abordajes"], "cantidad_abordajes"),
        ("demanda_viajes", started, n["viajes"], views["gold.v_demanda_viajes_mr"], "viajes_iniciados"),
        ("cobertura_abordajes", boarded, n["abordajes"], views["gold.v_cobertura"], "abordajes"),
        ("cobertura_viajes", started, n["viajes"], views["gold.v_cobertura"], "viajes_mr_iniciados"),
    ]
    return union_all(
        [
            quality.totals_match(facts, view, {"n": (measure, F.col(column))}).select(
                F.lit(name).alias("vista"), F.col("n_a").cast("long").alias("esperado"), F.col("n_b").cast("long").alias("obtenido")
            )
            for name, facts, measure, view, column in cases
        ]
    )


def multimodality_totals(view: DataFrame, users: DataFrame) -> Violations:
    """Groups of the view that are not those of the identities, or rows that do not carry the network's totals."""
    keys, modes = ["modos_observados", "metodo_identidad"], F.col("modos_observados")
    counted = users.groupBy(*keys).agg(F.count(F.lit(1)).alias("usuarios"))
    groups = reconcile(counted, view.withColumn("usuarios", F.col("usuarios").cast("long")), keys, ["usuarios"]).select(*keys)
    network = users.agg(
        F.count(F.lit(1)).alias("_todos"), F.count_if(modes > 1).alias("_multi"), F.count_if(modes == 1).alias("_uni")
    )
    joined = with_scalar(view, network)
    share = F.col("_multi").cast("decimal(20,4)") * 100 / F.col("_todos").cast("decimal(20,4)")
    wrong = [
        fx.differs(F.col("total_usuarios_observados").cast("long"), F.col("_todos")),
        fx.differs(F.col("usuarios_multimodales_total").cast("long"), F.col("_multi")),
        fx.differs(F.col("usuarios_unimodales_total").cast("long"), F.col("_uni")),
        fx.differs(F.col("pct_usuarios_multimodales").cast("decimal(20,2)"), F.round(share, 2).cast("decimal(20,2)")),
        F.col("_multi") + F.col("_uni") != F.col("_todos"),
        ~F.coalesce(modes.between(1, len(MODE_SUFFIX)), F.lit(False)),
    ]
    return groups.unionByName(joined.filter(reduce(lambda a, b: a | b, wrong)).select(*keys))


def transfer_view_totals(view: DataFrame, moves: DataFrame) -> Violations:
    """Rows of the view whose transfers, fares or mean minutes do not follow from the mart.

    The mean is held against sum and count: it may be off by half of its last digit, as rounding allows.
    """
    keys = ["fecha", "hora", "modo_origen", "modo_destino", "combinacion_modos", "zona_origen", "zona_destino", "incluye_aerometro"]
    minutes = F.col("tiempo_transferencia_minutos").cast("decimal(20,4)")
    renamed = moves.withColumnsRenamed({"fecha_transbordo": "fecha", "hora_transbordo": "hora"})
    expected = renamed.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.count(F.lit(1)).alias("_n"), F.count(minutes).alias("_con_minutos"), F.sum(minutes).alias("_minutos"),
        F.round(F.sum("tarifa_acumulada_gtq"), 2).alias("_tarifa"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    joined = view.join(expected, same, "full")
    mean = F.col("tiempo_promedio_transferencia_minutos").cast("decimal(20,4)")
    off = F.abs(mean * F.col("_con_minutos") - F.col("_minutos")) > F.col("_con_minutos") * F.lit(0.005).cast("decimal(10,4)")
    wrong = [
        fx.differs(F.col("total_transbordos").cast("long"), F.col("_n")),
        fx.differs(F.col("tarifa_total_gtq"), F.col("_tarifa")),
        F.coalesce(off, mean.isNotNull() | (F.col("_con_minutos") > 0)),
    ]
    repeated = quality.unique(view, keys).select(*keys)
    return repeated.unionByName(
        joined.filter(reduce(lambda a, b: a | b, wrong)).select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys])
    )


def published(t: Mapping[str, DataFrame]) -> dict[str, Violations]:
    """All guards over the tables of a build, by name."""
    boardings, trips, zones = t["gold.fact_abordajes"], t["gold.fact_viajes_metroriel"], t["gold.dim_zona"]
    train, seen = t["gold.mart_metroriel_zonas"], t["gold.v_metroriel"]
    views = {
        n: t[n]
        for n in ("gold.v_demanda_abordajes", "gold.v_demanda_viajes_mr", "gold.v_cobertura", "gold.v_metroriel",
                  "gold.v_multimodalidad", "gold.v_transbordos")
    }
    return {
        "cobertura_reconciliada": coverage_totals(t["gold.mart_cobertura"], t["gold.mart_demanda_hora"]),
        "tren_grano": train_zone_grain(train, t["gold.dim_punto_transporte"], zones),
        "tren_reconciliado": train_zone_totals(train, boardings, trips, zones),
        "tren_ranking": train_zone_ranking(train, boardings, trips, zones),
        "vistas_totales": view_totals(views, boardings, trips, zones),
        "vista_metroriel": quality.same_rows(train.drop("zona_sk"), seen),
        "vista_multimodalidad": multimodality_totals(views["gold.v_multimodalidad"], t["gold.dim_usuario"]),
        "vista_transbordos": transfer_view_totals(views["gold.v_transbordos"], t["gold.mart_multimodalidad"]),
        "vistas_sin_identidad": quality.forbidden_columns(views, RAW_IDENTIFIERS),
    }
