"""Star schema and marts.

Time keys are ``yyyyMMddHHmmss`` numbers, so marts read calendar attributes from the key itself
instead of joining the facts with one dimension row per second. Identities and pseudonyms are
functions of the key and are computed in place, so building a fact shuffles no events.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators.joins import join_on, star_join, universe_left
from corredor.operators.sets import union_all, union_distinct
from corredor.operators.windows import HOT_ROWS, previous_event
from corredor.plans.silver import AM, GENERAL_SERVICE, MODE_SUFFIX, MR, TM, TU, with_identity


def dim_mode(points: DataFrame) -> DataFrame:
    """M17."""
    return points.select(fx.md5_key(F.col("modo")).alias("modo_sk"), F.col("modo").alias("nombre_modo")).distinct()


def dim_zone(universe: DataFrame) -> DataFrame:
    """M18."""
    return universe.select(
        fx.md5_key(F.col("nombre_zona")).alias("zona_sk"), *[c for c in universe.columns]
    )


def dim_point(points: DataFrame) -> DataFrame:
    """M19."""
    return points.select(
        fx.md5_key(F.col("modo"), F.col("codigo_punto")).alias("punto_sk"),
        fx.md5_key(F.col("modo")).alias("modo_sk"),
        fx.md5_key(F.col("zona_conformada")).alias("zona_sk"),
        "codigo_punto",
        "nombre_punto",
        "modo",
        "zona_conformada",
        "servicio_codigo",
        "latitud",
        "longitud",
    )


# Column and kind of the service each operator runs.
_SERVICE = {TM: ("linea", "Línea"), TU: ("ruta", "Ruta"), AM: ("eje", "Eje")}


def dim_service(silver: Mapping[str, DataFrame]) -> DataFrame:
    """Lines, routes and axes seen in the events; the train has one general service."""
    seen = [
        silver[op].select(
            F.lit(op).alias("modo"),
            fx.blank_to(F.col(col), fx.SERVICE_FALLBACK).alias("codigo_servicio"),
            F.lit(kind).alias("tipo_servicio"),
        )
        for op, (col, kind) in _SERVICE.items()
    ]
    train = silver[MR].select(
        F.lit(MR).alias("modo"),
        F.lit(GENERAL_SERVICE).alias("codigo_servicio"),
        F.lit("Servicio").alias("tipo_servicio"),
    )
    return union_distinct([*seen, train]).select(
        fx.md5_key(F.col("modo"), F.col("codigo_servicio")).alias("servicio_sk"),
        fx.md5_key(F.col("modo")).alias("modo_sk"),
        "modo",
        "codigo_servicio",
        "tipo_servicio",
    )


def dim_time(silver: Mapping[str, DataFrame]) -> DataFrame:
    """One row per observed instant."""
    columns = [(TM, "fecha_hora"), (TU, "fecha_hora"), (AM, "fecha_hora"),
               (MR, "fecha_hora_ingreso"), (MR, "fecha_hora_salida")]
    instants = union_distinct([silver[op].select(F.col(c).alias("fecha_hora")) for op, c in columns])
    dated = fx.calendar(instants.filter(F.col("fecha_hora").isNotNull()), "fecha_hora")
    return dated.select(fx.ts_key(F.col("fecha_hora")).alias("tiempo_sk"), *dated.columns)


def dim_user(bridge: DataFrame, key: str) -> DataFrame:
    """Pseudonymous identities; the digest is taken after grouping, once per identity."""
    grouped = bridge.groupBy("usuario_canonico_id").agg(
        F.countDistinct("sistema_origen").cast("int").alias("modos_observados"),
        F.bool_or(F.col("metodo_match") == "HASH_AISLADO").alias("_isolated"),
    )
    method = F.when(F.col("_isolated"), "HASH_AISLADO").otherwise("PATRON_NUMERICO_INFERIDO")
    return grouped.select(
        fx.hmac_sha256(F.col("usuario_canonico_id"), key).alias("usuario_sk"),
        "modos_observados",
        method.alias("metodo_identidad"),
    )


# operator -> (key, point, service)
_BOARDING = {
    TM: ("tarjeta_id", "estacion_id", "linea"),
    TU: ("id_tarjeta", "cod_parada", "ruta"),
    AM: ("user_hash", "station_code", "eje"),
}


def fact_boardings(
    silver: Mapping[str, DataFrame], points: DataFrame, key: str, bridge: DataFrame | None = None
) -> DataFrame:
    """One row per accepted boarding with a known identity and point.

    Point and zone keys come from the (small) catalogue side, and the mode key is a constant of
    each branch; only the event's own keys are hashed per row.
    """
    events = union_all(
        [
            silver[op].select(
                F.lit(op).alias("fuente_evento"),
                fx.md5_key(F.lit(op)).alias("modo_sk"),
                F.col("bronze_record_id"),
                F.col(card).alias("llave_origen"),
                F.col(point).alias("codigo_punto"),
                fx.ts_key(F.col("fecha_hora")).alias("tiempo_sk"),
                fx.md5_key(F.lit(op), fx.blank_to(F.col(service), fx.SERVICE_FALLBACK)).alias("servicio_sk"),
                "tarifa_quetzales",
            )
            for op, (card, point, service) in _BOARDING.items()
        ]
    )
    placed = join_on(
        with_identity(events, "fuente_evento", "llave_origen", bridge),
        dim_point(points),
        {"fuente_evento": "modo", "codigo_punto": "codigo_punto"},
        {"zona_sk": "zona_sk", "punto_sk": "punto_sk"},
    )
    return placed.select(
        fx.md5_key(F.col("fuente_evento"), F.col("bronze_record_id")).alias("abordaje_sk"),
        fx.hmac_sha256(F.col("usuario_canonico_id"), key).alias("usuario_sk"),
        "tiempo_sk",
        "zona_sk",
        "punto_sk",
        "modo_sk",
        "servicio_sk",
        "fuente_evento",
        F.lit(1).alias("cantidad_abordajes"),
        "tarifa_quetzales",
        "bronze_record_id",
    )


def fact_trips(
    trips: DataFrame, points: DataFrame, key: str, bridge: DataFrame | None = None
) -> DataFrame:
    """One row per closed trip; the point catalogue plays the origin and destination roles."""
    stations = dim_point(points).filter(F.col("modo") == MR)
    mode = F.lit(MR)
    events = trips.withColumn("fuente_evento", mode)
    known = with_identity(events, "fuente_evento", "tarjeta_mr", bridge)
    origin = join_on(
        known, stations, {"origen_estacion_id": "codigo_punto"},
        {"zona_sk": "zona_origen_sk", "punto_sk": "punto_origen_sk"},
    )
    both = join_on(
        origin, stations, {"destino_estacion_id": "codigo_punto"},
        {"zona_sk": "zona_destino_sk", "punto_sk": "punto_destino_sk"},
    )
    return both.select(
        fx.md5_key(mode, F.col("bronze_record_id")).alias("viaje_sk"),
        fx.hmac_sha256(F.col("usuario_canonico_id"), key).alias("usuario_sk"),
        fx.ts_key(F.col("fecha_hora_ingreso")).alias("tiempo_ingreso_sk"),
        fx.ts_key(F.col("fecha_hora_salida")).alias("tiempo_salida_sk"),
        "zona_origen_sk",
        "zona_destino_sk",
        "punto_origen_sk",
        "punto_destino_sk",
        fx.md5_key(mode).alias("modo_sk"),
        fx.md5_key(mode, F.lit(GENERAL_SERVICE)).alias("servicio_sk"),
        "fuente_evento",
        F.lit(1).alias("cantidad_viajes"),
        "tarifa_quetzales",
        "duracion_minutos",
        "bronze_record_id",
    )


def demand_hour(
    boardings: DataFrame, trips: DataFrame, zones: DataFrame, modes: DataFrame
) -> DataFrame:
    """Date x hour x mode x zone. Totals are taken on keys before any dimension is joined."""
    events = union_all(
        [
            boardings.select(
                "tiempo_sk", "zona_sk", "modo_sk", F.lit("abordaje").alias("tipo_evento"),
                F.col("cantidad_abordajes").alias("n"), "tarifa_quetzales",
            ),
            trips.select(
                F.col("tiempo_ingreso_sk").alias("tiempo_sk"), F.col("zona_origen_sk").alias("zona_sk"),
                "modo_sk", F.lit("viaje").alias("tipo_evento"),
                F.col("cantidad_viajes").alias("n"), "tarifa_quetzales",
            ),
        ]
    )
    hour_key = F.floor(F.col("tiempo_sk") / 10_000).alias("_hora_sk")
    hourly = events.groupBy(hour_key, "zona_sk", "modo_sk", "tipo_evento").agg(
        F.sum("n").alias("cantidad_eventos"), F.sum("tarifa_quetzales").alias("tarifa_total_gtq")
    )
    labelled = star_join(
        hourly,
        {
            "zona_sk": zones.select("zona_sk", F.col("nombre_zona").alias("zona")),
            "modo_sk": modes.select("modo_sk", F.col("nombre_modo").alias("modo")),
        },
    )
    # the key yields date and hour directly, which keeps pushed-down filters short
    day = fx.date_from_key(F.floor(F.col("_hora_sk") / 100))
    hour = (F.col("_hora_sk") % 100).cast("int")
    dated = labelled.withColumns({"fecha": day, "hora": hour})
    business = fx.is_business_day(F.col("fecha"))
    return dated.select(
        "fecha",
        "hora",
        business.alias("es_dia_habil"),
        (business & F.col("hora").isin(*fx.PEAK_HOURS)).alias("es_hora_pico"),
        "modo",
        "zona",
        "tipo_evento",
        "cantidad_eventos",
        "tarifa_total_gtq",
    )


def _pct(num, den, digits=2):
    return F.round(
        num.cast("decimal(20,4)") * 100 / F.nullif(den.cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)")),
        digits,
    )


def coverage(demand: DataFrame, zones: DataFrame) -> DataFrame:
    """Supply and use per area; windows only see one row per area."""
    per_mode = {f"eventos_{s}": m for m, s in MODE_SUFFIX.items()}
    n = F.col("cantidad_eventos")
    use = demand.groupBy(F.col("zona").alias("nombre_zona")).agg(
        F.sum(n).alias("eventos_totales"),
        *[F.sum(F.when(F.col("modo") == m, n)).alias(c) for c, m in per_mode.items()],
    )
    base = universe_left(zones, use, "nombre_zona", ["eventos_totales", *per_mode])
    everything = Window.partitionBy()
    total = F.col("eventos_totales")
    per_point = {
        "eventos_por_punto": ("eventos_totales", "puntos_transporte"),
        "eventos_por_punto_transmetro": ("eventos_transmetro", "puntos_transmetro"),
        "eventos_por_punto_transurbano": ("eventos_transurbano", "puntos_transurbano"),
        "viajes_por_estacion_metroriel": ("eventos_metroriel", "puntos_metroriel"),
        "eventos_por_punto_aerometro": ("eventos_aerometro", "puntos_aerometro"),
    }
    served = F.col("tiene_servicio")
    return base.withColumns(
        {
            **{n: fx.ratio(F.col(a), F.col(b), 1) for n, (a, b) in per_point.items()},
            "pct_demanda_red": _pct(total, F.sum(total).over(everything)),
            "ranking_demanda": F.rank().over(Window.orderBy(total.desc())),
            "inconsistencia_cobertura": (served & (total == 0)) | (~served & (total > 0)),
        }
    )


def train_zones(
    boardings: DataFrame, trips: DataFrame, points: DataFrame, zones: DataFrame
) -> DataFrame:
    """Areas on the train line, ranked against the whole network before restricting."""
    stations = (
        points.filter(F.col("modo") == MR)
        .groupBy("zona_sk")
        .agg(F.count(F.lit(1)).cast("int").alias("estaciones_metroriel"))
    )
    parts = {f"abordajes_{MODE_SUFFIX[m]}": m for m in (TM, TU, AM)}
    n = F.col("cantidad_abordajes")
    others = (
        boardings.filter(F.col("fuente_evento").isin(*parts.values()))
        .groupBy("zona_sk")
        .agg(
            F.sum(n).alias("abordajes_otros_modos"),
            *[F.sum(F.when(F.col("fuente_evento") == m, n)).alias(c) for c, m in parts.items()],
        )
    )
    started = trips.groupBy(F.col("zona_origen_sk").alias("zona_sk")).agg(
        F.sum("cantidad_viajes").alias("viajes_metroriel_iniciados")
    )
    measures = ["abordajes_otros_modos", *parts]
    network = universe_left(zones.select("zona_sk", "nombre_zona"), others, "zona_sk", measures)
    network = universe_left(network, started, "zona_sk", ["viajes_metroriel_iniciados"])
    everything = Window.partitionBy()
    use = F.col("abordajes_otros_modos")
    ranked = network.withColumns(
        {
            "total_abordajes_otros_modos_red": F.sum(use).over(everything),
            "areas_en_ranking_red": F.count(F.lit(1)).over(everything).cast("int"),
            "ranking_demanda_otros_modos": F.rank().over(Window.orderBy(use.desc())),
        }
    )
    share = F.coalesce(_pct(use, F.col("total_abordajes_otros_modos_red")), F.lit(0))
    return ranked.join(stations, "zona_sk").select(
        "zona_sk",
        "nombre_zona",
        "estaciones_metroriel",
        *measures,
        "viajes_metroriel_iniciados",
        share.alias("pct_abordajes_otros_modos_red"),
        "ranking_demanda_otros_modos",
        "total_abordajes_otros_modos_red",
        "areas_en_ranking_red",
    )


def user_events(
    boardings: DataFrame, trips: DataFrame, zones: DataFrame
) -> DataFrame:
    """Events of both facts under one schema, dated from their time key."""
    events = union_all(
        [
            boardings.select(
                "usuario_sk", F.col("fuente_evento").alias("modo"), "zona_sk",
                fx.ts_from_key(F.col("tiempo_sk")).alias("fecha_hora"), "tarifa_quetzales", "bronze_record_id",
            ),
            trips.select(
                "usuario_sk", F.col("fuente_evento").alias("modo"), F.col("zona_origen_sk").alias("zona_sk"),
                fx.ts_from_key(F.col("tiempo_ingreso_sk")).alias("fecha_hora"), "tarifa_quetzales",
                "bronze_record_id",
            ),
        ]
    )
    names = zones.select("zona_sk", F.col("nombre_zona").alias("zona"))
    return star_join(events, {"zona_sk": names}).drop("zona_sk")


EVENT_ORDER = ["fecha_hora", "modo", "bronze_record_id"]


def transfers(events: DataFrame, max_gap_minutes: int = 90, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Consecutive events of an identity in different modes, ``0 < gap <= max``.

    Adjacency is decided over all events of the identity. An identity with a large share of the
    events is cut into minutes.
    """
    before = ["modo", "zona", "fecha_hora", "tarifa_quetzales", "bronze_record_id"]
    minute = F.floor(fx.ts_key(F.col("fecha_hora")) / 100)
    seq = previous_event(events, ["usuario_sk"], EVENT_ORDER, minute, before, hot_rows)
    prev, now = F.col("prev.fecha_hora"), F.col("fecha_hora")
    gap = F.make_dt_interval(mins=F.lit(max_gap_minutes))
    pairs = seq.filter(
        (F.col("modo") != F.col("prev.modo")) & (now > prev) & (now - prev <= gap)
    )
    return pairs.select(
        fx.md5_key(F.col("usuario_sk"), F.col("prev.bronze_record_id"), F.col("bronze_record_id")).alias("transbordo_sk"),
        "usuario_sk",
        F.col("prev.bronze_record_id").alias("bronze_record_id_origen"),
        F.col("bronze_record_id").alias("bronze_record_id_destino"),
        prev.cast("date").alias("fecha_transbordo"),
        F.hour(prev).alias("hora_transbordo"),
        prev.alias("momento_inicio_transbordo"),
        now.alias("momento_fin_transbordo"),
        F.col("prev.modo").alias("modo_origen"),
        F.col("modo").alias("modo_destino"),
        fx.pair_label(F.col("prev.modo"), F.col("modo")).alias("combinacion_modos"),
        F.col("prev.zona").alias("zona_origen"),
        F.col("zona").alias("zona_destino"),
        F.round(fx.elapsed(prev, now, "minutes"), 2).alias("tiempo_transferencia_minutos"),
        (F.col("prev.tarifa_quetzales") + F.col("tarifa_quetzales")).alias("tarifa_acumulada_gtq"),
        ((F.col("prev.modo") == AM) | (F.col("modo") == AM)).alias("incluye_aerometro"),
        F.lit(1).alias("cantidad_transbordos"),
    )
