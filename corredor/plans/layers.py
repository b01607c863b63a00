"""From staging to conformed and published tables, with the checks that guard them.

Every relation is written once and later models read the written table, so nothing is computed
twice and a lost executor costs a task, not a lineage of the whole warehouse. Facts are sorted
by time key inside their files: Parquet statistics then skip row groups outside a time range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corredor.operators import cdc as cdc_ops
from corredor.operators import quality
from corredor.plans import gold, guards, pit, silver, views
from corredor.plans.silver import AM, HORIZON, MR, TM, TU
from corredor.sources.bronze import read_or_empty

# Staging relations the build starts from.
STAGING = (
    "transmetro_validaciones", "transurbano_transacciones", "metroriel_viajes", "aerometro_boardings",
    "tm_estaciones", "tu_paradas", "mr_estaciones", "am_estaciones", "cdc_registro_ambiguo",
)


@dataclass(frozen=True)
class Settings:
    """Arguments of one run; nothing is taken from the clock or the environment."""

    key: str
    detected_at: str
    processed_on: str
    cuts: Sequence[tuple[str, datetime]]
    horizon: str = HORIZON
    label_days: int = pit.LABEL_DAYS
    max_gap_minutes: int = 90


@dataclass
class Tables:
    """Written tables by ``layer.name``."""

    spark: SparkSession
    base: str
    version: int = 1
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def store(self, layer: str, name: str, df: DataFrame, sort: Sequence[str] = (), month: Column | None = None) -> DataFrame:
        """Writes a relation of this version; ``month`` (yyyyMM) partitions it, so that time ranges skip files."""
        path = f"{self.base}/{layer}/{name}/version={self.version}"
        if month is not None:
            # rows of a month go to as many tasks as their size asks for
            df = df.withColumn("mes", month.cast("int")).hint("rebalance", "mes")
        rows = df.sortWithinPartitions(*(["mes"] if month is not None else []), *sort) if sort else df
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("mes") if month is not None else writer).parquet(path)
        self.tables[f"{layer}.{name}"] = written = self.spark.read.parquet(path)
        return written

    def publish(self, keep: int = 2) -> None:
        """Makes this version the one that ``open_tables`` reads; all but the newest ``keep`` versions are deleted."""
        stored = [n for n in self.tables if n.partition(".")[2] and not n.startswith("gold.v_")]
        self.spark.createDataFrame([(self.version, stored)], _LOG).coalesce(1).write.mode("append").parquet(f"{self.base}/_versions")
        context = self.spark.sparkContext
        old = [r["version"] for r in published(self.spark, self.base)[keep:]]
        for name in stored:
            for version in old:
                path = context._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name.replace('.', '/', 1)}/version={version}")
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def silver(self) -> dict[str, DataFrame]:
        return {op: self.tables[f"silver.{name}"] for op, name in OPERATOR_TABLES.items()}


_LOG = "version int, tablas array<string>"


def published(spark: SparkSession, base: str) -> list:
    """Published versions, newest first; one row per build."""
    return sorted(read_or_empty(spark, f"{base}/_versions", _LOG).collect(), key=lambda r: -r["version"])


def open_tables(spark: SparkSession, base: str) -> Tables:
    """The newest published version. A build that failed or still runs is not visible."""
    log = published(spark, base)
    if not log:
        raise FileNotFoundError(f"no published version under {base}")
    t = Tables(spark, base, log[0]["version"])
    for name in log[0]["tablas"]:
        t.tables[name] = spark.read.parquet(f"{base}/{name.replace('.', '/', 1)}/version={t.version}")
    return with_views(t)


OPERATOR_TABLES = {
    TM: "transmetro_validaciones", TU: "transurbano_transacciones", MR: "metroriel_viajes", AM: "aerometro_boardings",
}


def build_silver(staging: Mapping[str, DataFrame], base: str, s: Settings) -> Tables:
    """Conformed layer: events, quarantine, catalogues, identities, history and user features."""
    spark = next(iter(staging.values())).sparkSession
    t = Tables(spark, base, 1 + max((r["version"] for r in published(spark, base)), default=0))
    tm, tu, mr, am = (staging[n] for n in STAGING[:4])
    stations = [staging[n] for n in STAGING[4:8]]
    t.store("silver", "transmetro_validaciones", silver.tm_boardings(tm))
    t.store("silver", "transurbano_transacciones", silver.tu_transactions(tu, stations[1], s.horizon))
    t.store("silver", "metroriel_viajes", silver.mr_trips(mr))
    t.store("silver", "aerometro_boardings", silver.am_boardings(am, stations[3]))
    rejected = t.store("silver", "cuarentena", silver.quarantine(tm, tu, mr, s.detected_at, s.horizon))
    t.store("silver", "metricas_calidad", silver.quality_metrics(rejected))
    points = t.store("silver", "catalogo_puntos", silver.point_catalog(*stations))
    t.store("silver", "universo_zonas", silver.zone_universe(points))
    t.store("silver", "bridge_identidad_usuario", silver.identity_bridge(t.silver(), s.processed_on))
    changes = t.store("silver", "cdc_padron", cdc_ops.type_cdc(staging["cdc_registro_ambiguo"]))
    t.store("silver", "padron_transmetro_actual", cdc_ops.current_state(changes))
    t.store("silver", "padron_transmetro_scd2", silver.card_history(changes))
    t.store("silver", "features_usuario", silver.user_features(t.silver(), points))
    return t


def build_point_in_time(t: Tables, s: Settings) -> Tables:
    """Population, cost and features of cards at the cut-offs.

    Uses are written once: three models read them, and each reading would repeat the anti join.
    """
    uses = t.store(
        "silver", "p2_usos_tarjeta", silver.card_uses(t.silver(), t["silver.cuarentena"]), ["fecha_uso"], pit.month_of(F.col("fecha_uso"))
    )
    pop = t.store(
        "silver", "p2_poblacion_tarjeta",
        pit.card_population(uses, t["silver.padron_transmetro_scd2"], s.cuts, label_days=s.label_days),
    )
    t.store("silver", "p2_costo_tarjeta", pit.card_cost(pop, uses, t["silver.bridge_identidad_usuario"], s.cuts, s.label_days))
    t.store("silver", "p2_features_tarjeta", pit.card_features(pop, uses, s.cuts))
    return t


def build_gold(t: Tables, s: Settings) -> Tables:
    """Star schema, marts and views."""
    points = t["silver.catalogo_puntos"]
    modes = t.store("gold", "dim_modo", gold.dim_mode(points))
    zones = t.store("gold", "dim_zona", gold.dim_zone(t["silver.universo_zonas"]))
    dim_points = t.store("gold", "dim_punto_transporte", gold.dim_point(points))
    t.store("gold", "dim_servicio", gold.dim_service(t.silver()))
    t.store("gold", "dim_tiempo", gold.dim_time(t.silver()))
    t.store("gold", "dim_usuario", gold.dim_user(t["silver.bridge_identidad_usuario"], s.key))
    boardings = t.store(
        "gold", "fact_abordajes", gold.fact_boardings(t.silver(), points, s.key), ["tiempo_sk"], _month("tiempo_sk")
    )
    trips = t.store(
        "gold", "fact_viajes_metroriel", gold.fact_trips(t["silver.metroriel_viajes"], points, s.key), ["tiempo_ingreso_sk"],
        _month("tiempo_ingreso_sk"),
    )
    demand = t.store("gold", "mart_demanda_hora", gold.demand_hour(boardings, trips, zones, modes))
    t.store("gold", "mart_cobertura", gold.coverage(demand, zones))
    t.store("gold", "mart_metroriel_zonas", gold.train_zones(boardings, trips, dim_points, zones))
    events = gold.user_events(boardings, trips, zones)
    t.store("gold", "mart_multimodalidad", gold.transfers(events, s.max_gap_minutes))
    t = with_views(t)
    t.publish()
    return t


def _month(key: str) -> Column:
    return F.floor(F.col(key) / 100_000_000)


def with_views(t: Tables) -> Tables:
    """Adds the published views over the stored marts."""
    demand = t["gold.mart_demanda_hora"]
    t.tables.update(
        {
            "gold.v_demanda_abordajes": views.view_demand_boardings(demand),
            "gold.v_demanda_viajes_mr": views.view_demand_trips(demand),
            "gold.v_cobertura": views.view_coverage(t["gold.mart_cobertura"]),
            "gold.v_metroriel": views.view_train_zones(t["gold.mart_metroriel_zonas"]),
            "gold.v_multimodalidad": views.view_multimodality(t["gold.dim_usuario"]),
            "gold.v_transbordos": views.view_transfers(t["gold.mart_multimodalidad"]),
        }
    )
    return t


def run(staging: Mapping[str, DataFrame], base: str, s: Settings) -> Tables:
    missing = sorted(set(STAGING) - set(staging))
    if missing:
        raise ValueError(f"missing staging relations {missing}")
    return build_gold(build_point_in_time(build_silver(staging, base, s), s), s)


def checks(t: Tables, s: Settings) -> dict[str, DataFrame]:
    """Named assertions over the written tables; each is empty when it holds."""
    facts, trips = t["gold.fact_abordajes"], t["gold.fact_viajes_metroriel"]
    zones, points, demand = t["gold.dim_zona"], t["gold.dim_punto_transporte"], t["gold.mart_demanda_hora"]
    history, pop = t["silver.padron_transmetro_scd2"], t["silver.p2_poblacion_tarjeta"]
    moves = t["gold.mart_multimodalidad"]
    out = {
        "abordaje_unico": quality.unique(facts, ["abordaje_sk"]),
        "viaje_unico": quality.unique(trips, ["viaje_sk"]),
        "abordaje_usuario": quality.foreign_key(facts, "usuario_sk", t["gold.dim_usuario"], "usuario_sk"),
        "abordaje_tiempo": quality.foreign_key(facts, "tiempo_sk", t["gold.dim_tiempo"], "tiempo_sk"),
        "abordaje_punto": quality.foreign_key(facts, "punto_sk", points, "punto_sk"),
        "abordaje_servicio": quality.foreign_key(facts, "servicio_sk", t["gold.dim_servicio"], "servicio_sk"),
        "viaje_salida": quality.foreign_key(trips, "tiempo_salida_sk", t["gold.dim_tiempo"], "tiempo_sk"),
        "modo_aceptado": quality.accepted(facts, "fuente_evento", [TM, TU, AM]),
        "demanda_grano": quality.grain(demand, ["fecha", "hora", "modo", "zona"]),
        "cobertura_grano": quality.grain(t["gold.mart_cobertura"], ["nombre_zona"]),
        "partes_zona": quality.parts_sum(
            t["gold.mart_cobertura"], [f"puntos_{m}" for m in silver.MODE_SUFFIX.values()], "puntos_transporte"
        ),
        "transbordos_reglas": quality.transfer_rules(moves, s.max_gap_minutes),
        "transbordos_secuencia": quality.transfer_sequence(moves, gold.user_events(facts, trips, zones), s.max_gap_minutes),
        # the mart holds the boardings of known zones: none of them lost, none counted twice
        "demanda_totales": quality.totals_match(
            facts.join(zones.select("zona_sk"), "zona_sk", "left_semi"), demand.filter("tipo_evento = 'abordaje'"),
            {
                "eventos": (F.col("cantidad_abordajes"), F.col("cantidad_eventos")),
                "tarifa": (F.col("tarifa_quetzales"), F.col("tarifa_total_gtq")),
            },
        ),
        "cobertura_coherente": quality.coverage_consistent(t["gold.mart_cobertura"]),
        "ranking_cobertura": quality.rank_valid(t["gold.mart_cobertura"], "eventos_totales", "ranking_demanda"),
        "historia_intervalos": quality.history_intervals(history, t["silver.cdc_padron"]),
        "features_recalculadas": quality.user_features_recomputed(
            t["silver.features_usuario"], t.silver(), t["silver.bridge_identidad_usuario"], t["silver.catalogo_puntos"]
        ),
        "historia_estado": quality.history_matches_state(history, t["silver.padron_transmetro_actual"]),
        "features_usuario": quality.user_feature_rules(t["silver.features_usuario"]),
        "poblacion": quality.population_rules(pop, label_days=s.label_days),
        "features_tarjeta": quality.card_feature_rules(t["silver.p2_features_tarjeta"], pop),
        "identificadores": quality.forbidden_columns(
            {"dim_usuario": t["gold.dim_usuario"], "fact_abordajes": facts, "fact_viajes": trips},
            ["tarjeta_id", "tarjeta_mr", "id_tarjeta", "llave_origen", "user_hash", "usuario_canonico_id"],
        ),
    }
    from corredor.operators.sets import union_all

    counted = [t[f"silver.{n}"].select(F.lit(m).alias("modo")) for m, n in OPERATOR_TABLES.items()]
    kept = facts.select(F.col("fuente_evento").alias("modo")).unionAll(trips.select(F.col("fuente_evento").alias("modo")))
    out["conteo_por_modo"] = quality.counts_match(union_all(counted), kept, ["modo"])
    return out | guards.published(t)
