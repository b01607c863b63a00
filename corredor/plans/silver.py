"""Conformed layer (M01-M13): typed, deduplicated and quarantined operator events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators.aggregates import global_max
from corredor.operators.cdc import scd2
from corredor.operators.joins import exclude, lookup, universe_left, with_scalar
from corredor.operators.sets import union_all, union_distinct
from corredor.operators.windows import keep_first, later_duplicates, number_rows

# Operator names, default horizon and default fares of the data contract.
TM, TU, MR, AM = "Transmetro", "Transurbano", "MetroRiel", "Aerometro"
HORIZON = "2026-10-01 00:00:00"
TM_DEFAULT_FARE = "1.00"
AM_DEFAULT_FARE = "3.00"
GENERAL_SERVICE = "SERVICIO_GENERAL"
TURNSTILE_KEY = ["tarjeta", "estacion_id", "fecha_hora"]
ARRIVAL = ["ingesta_timestamp", "bronze_record_id"]


def min_user_keys(tu: DataFrame, mr: DataFrame, am: DataFrame) -> DataFrame:
    """Distinct non-blank keys of the three operators without a registry."""
    named = {(TU, "num_tarjeta"): tu, (MR, "card"): mr, (AM, "user_hash"): am}
    parts = [
        df.select(F.col(key).cast("string").alias("llave_origen"), F.lit(op).alias("sistema_origen"))
        .filter(fx.not_blank(F.col("llave_origen")))
        for (op, key), df in named.items()
    ]
    return union_all(parts).distinct()


def tm_boardings(stg: DataFrame) -> DataFrame:
    """Turnstile boardings without repeated reads of the same card, station and second."""
    return keep_first(stg, TURNSTILE_KEY, ARRIVAL).select(
        "estacion_id",
        F.col("tarjeta").alias("tarjeta_id"),
        F.col("fecha_hora").cast("timestamp_ntz").alias("fecha_hora"),
        "linea",
        fx.money(F.col("tarifa"), TM_DEFAULT_FARE).alias("tarifa_quetzales"),
        "bronze_record_id",
        "ingesta_timestamp",
    )


def _tu_parsed(stg: DataFrame) -> DataFrame:
    day = fx.parse_date_any(F.col("fecha"))
    return stg.withColumns({"fecha_valida": day, "fecha_hora": fx.date_time(day, F.col("hora"))})


def _tu_accepted(horizon: str) -> list[Column]:
    return [
        fx.not_blank(F.col("cod_parada")),
        F.col("fecha_hora") <= F.lit(horizon).cast("timestamp_ntz"),
    ]


def tu_transactions(
    stg: DataFrame, stops: DataFrame, horizon: str = HORIZON, numbered: bool = True
) -> DataFrame:
    """Bus transactions inside the horizon, with a known stop code.

    ``TU-n`` counts every row with a readable date, so rows dropped afterwards leave gaps.
    Readers that do not show the number pass ``numbered=False`` and skip the global order.
    """
    dated = _tu_parsed(stg).filter(F.col("fecha_valida").isNotNull())
    if numbered:
        order = ["fecha_valida", "hora", "num_tarjeta", "bronze_record_id"]
        dated = number_rows(dated, order, "id_transaccion", "TU-")
    kept = fx.valid_only(dated, _tu_accepted(horizon))
    zoned = lookup(kept, stops, "cod_parada", {"sector": "zona_cruda"})
    return zoned.select(
        *(["id_transaccion"] if numbered else []),
        F.col("num_tarjeta").alias("id_tarjeta"),
        "fecha_hora",
        "cod_parada",
        "ruta",
        fx.normalize_zone(F.col("zona_cruda")).alias("zona_conformada"),
        fx.money(F.col("monto_centavos"), divisor=100).alias("tarifa_quetzales"),
        "bronze_record_id",
        "ingesta_timestamp",
    )


def mr_trips(stg: DataFrame) -> DataFrame:
    """Train trips with an exit."""
    closed = [F.col("exit_station").isNotNull(), F.col("exit_ts").isNotNull()]
    return fx.valid_only(stg, closed).select(
        F.col("trip_id").cast("string").alias("viaje_id"),
        F.col("card").alias("tarjeta_mr"),
        F.col("entry_station").cast("string").alias("origen_estacion_id"),
        F.col("exit_station").cast("string").alias("destino_estacion_id"),
        F.col("entry_ts").cast("timestamp_ntz").alias("fecha_hora_ingreso"),
        F.col("exit_ts").cast("timestamp_ntz").alias("fecha_hora_salida"),
        fx.money(F.col("fare_gtq")).alias("tarifa_quetzales"),
        fx.minutes_from_seconds(F.col("duration_s")).alias("duracion_minutos"),
        "bronze_record_id",
        "ingesta_timestamp",
    )


def am_boardings(stg: DataFrame, stations: DataFrame) -> DataFrame:
    """Cable-car boardings in local time."""
    zoned = lookup(stg, stations, "station_code", {"district": "zona_cruda"})
    return zoned.select(
        F.col("boarding_id").cast("string").alias("boarding_id"),
        "user_hash",
        "station_code",
        F.col("axis").alias("eje"),
        fx.to_local(F.col("timestamp_utc")).alias("fecha_hora"),
        "cabin_number",
        fx.normalize_zone(F.col("zona_cruda")).alias("zona_conformada"),
        fx.money(F.col("fare"), AM_DEFAULT_FARE).alias("tarifa_quetzales"),
        "bronze_record_id",
        "ingesta_timestamp",
    )


def apply_rules(
    df: DataFrame, source: str, rules: Sequence[tuple[str, Column, Sequence[Column]]]
) -> DataFrame:
    """One row per (record, violated rule) from a single scan.

    A rule is a name, a predicate that is true on violation, and the payload columns.
    """
    hits = F.array(
        *[
            F.when(
                F.coalesce(bad, F.lit(False)),
                F.struct(F.lit(name).alias("motivo"), fx.json_payload(*payload).alias("payload")),
            )
            for name, bad, payload in rules
        ]
    )
    exploded = df.select(
        F.lit(source).alias("fuente"),
        F.col("bronze_record_id").alias("id_registro_crudo"),
        F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_hit"),
    )
    return exploded.select(
        "fuente",
        "id_registro_crudo",
        F.col("_hit.motivo").alias("motivo_rechazo"),
        F.col("_hit.payload").alias("payload"),
    )


def quarantine(
    tm: DataFrame, tu: DataFrame, mr: DataFrame, detected_at: str, horizon: str = HORIZON
) -> DataFrame:
    """Rejected records, one row per violated rule; the detection time is an argument."""
    repeated = later_duplicates(
        tm.select(*TURNSTILE_KEY, *ARRIVAL), TURNSTILE_KEY, ARRIVAL, "bronze_record_id"
    )
    no_stop = ~fx.not_blank(F.coalesce(F.col("cod_parada"), F.lit("")))
    late = F.col("fecha_hora") > F.lit(horizon).cast("timestamp_ntz")
    bad_date = F.col("fecha_hora").isNull() | late
    open_trip = F.col("exit_station").isNull() | F.col("exit_ts").isNull()

    tm_rules = [("DUPLICADO_TORNIQUETE", F.lit(True), [F.col(c) for c in TURNSTILE_KEY])]
    tu_rules = [
        ("COD_PARADA_NULO", no_stop, [F.col(c) for c in ("num_tarjeta", "ruta", "fecha", "hora")]),
        ("FECHA_FUTURA", bad_date, [F.col(c) for c in ("num_tarjeta", "fecha", "hora")]),
    ]
    mr_rules = [
        (
            "VIAJE_SIN_EXIT",
            open_trip,
            [
                F.col("trip_id").alias("viaje_id"),
                F.col("card").alias("tarjeta_mr"),
                F.col("entry_station").alias("origen_estacion_id"),
            ],
        )
    ]
    return union_all(
        [
            apply_rules(repeated, TM, tm_rules),
            apply_rules(_tu_parsed(tu), TU, tu_rules),
            apply_rules(mr, MR, mr_rules),
        ]
    ).withColumn("fecha_deteccion", F.lit(detected_at).cast("timestamp_ntz"))


def quality_metrics(rejected: DataFrame) -> DataFrame:
    """Violations per rule, distinct records per source and the share inside the source."""
    # one row per source, rule and record first; both counts read that reduced relation
    per_record = rejected.groupBy("fuente", "motivo_rechazo", "id_registro_crudo").agg(
        F.count(F.lit(1)).alias("_n")
    )
    per_rule = per_record.groupBy("fuente", "motivo_rechazo").agg(
        F.sum("_n").alias("total_violaciones")
    )
    per_source = rejected.groupBy("fuente").agg(
        F.countDistinct("id_registro_crudo").alias("registros_unicos_fuente"),
        F.count(F.lit(1)).alias("_total"),
    )
    pct = F.round(
        F.col("total_violaciones").cast("decimal(20,4)") * 100 / F.col("_total").cast("decimal(20,4)"), 3
    )
    return (
        per_rule.join(per_source, "fuente")
        .withColumn("porcentaje_dentro_fuente", pct)
        .drop("_total")
    )


def point_catalog(tm: DataFrame, tu: DataFrame, mr: DataFrame, am: DataFrame) -> DataFrame:
    """Transport points of the four operators under one schema."""

    def points(df, mode, code, name, zone, service, lat=None, lon=None):
        def degrees(c):
            return fx.blank_to_null(F.col(c)).cast("decimal(12,6)") if c else F.lit(None).cast("decimal(12,6)")

        return df.select(
            F.lit(mode).alias("modo"),
            F.col(code).cast("string").alias("codigo_punto"),
            F.col(name).alias("nombre_punto"),
            fx.normalize_zone(F.col(zone)).alias("zona_conformada"),
            (F.lit(GENERAL_SERVICE) if service is None else F.col(service)).alias("servicio_codigo"),
            degrees(lat).alias("latitud"),
            degrees(lon).alias("longitud"),
        )

    return union_all(
        [
            points(tm, TM, "estacion_id", "nombre", "zona", "linea", "lat", "lon"),
            points(tu, TU, "cod_parada", "descripcion", "sector", "ruta"),
            points(mr, MR, "id_estacion", "nombre_estacion", "zona_nombre", None),
            points(am, AM, "station_code", "station_name", "district", "axis"),
        ]
    )


MODE_SUFFIX = {TM: "transmetro", TU: "transurbano", MR: "metroriel", AM: "aerometro"}


def zone_universe(points: DataFrame, areas: Sequence[tuple[str, str]] = fx.AREAS) -> DataFrame:
    """Every official area, served or not, with its points per operator."""
    per_mode = {f"puntos_{s}": F.count_if(F.col("modo") == m) for m, s in MODE_SUFFIX.items()}
    supply = points.groupBy(F.col("zona_conformada").alias("nombre_zona")).agg(
        F.countDistinct("modo").cast("int").alias("modos_con_servicio"),
        F.count(F.lit(1)).cast("int").alias("puntos_transporte"),
        *[c.cast("int").alias(n) for n, c in per_mode.items()],
    )
    universe = fx.constant_relation(points.sparkSession, areas, "nombre_zona string, tipo_area string")
    counts = ["modos_con_servicio", "puntos_transporte", *per_mode]
    return universe_left(universe, supply, "nombre_zona", counts).withColumn(
        "tiene_servicio", F.col("modos_con_servicio") > 0
    )


def silver_keys(silver: Mapping[str, DataFrame]) -> list[DataFrame]:
    column = {TM: "tarjeta_id", TU: "id_tarjeta", MR: "tarjeta_mr", AM: "user_hash"}
    return [
        silver[op].select(F.lit(op).alias("sistema_origen"), F.col(c).alias("llave_origen"))
        for op, c in column.items()
    ]


def identity_bridge(silver: Mapping[str, DataFrame], processed_on: str | None = None) -> DataFrame:
    """Inferred identity of each (operator, key); the process date is an argument."""
    keys = union_distinct(silver_keys(silver))
    isolated = F.col("sistema_origen") == AM
    out = keys.select(
        fx.canonical_id(F.col("sistema_origen"), F.col("llave_origen")).alias("usuario_canonico_id"),
        "sistema_origen",
        "llave_origen",
        F.when(isolated, "HASH_AISLADO").otherwise("PATRON_NUMERICO_INFERIDO").alias("metodo_match"),
        F.when(isolated, "ALTO_LOCAL").otherwise("INFERENCIA_ACADEMICA_MEDIA").alias("nivel_confianza"),
    )
    return out if processed_on is None else out.withColumn("fecha_proceso", F.lit(processed_on).cast("date"))


def card_history(cdc: DataFrame, **skew) -> DataFrame:
    """Type-2 history of the turnstile card registry."""
    return scd2(cdc, **skew)


# operator -> (key, event time, time of knowledge, point)
_EVENT_COLUMNS = {
    TM: ("tarjeta_id", "fecha_hora", "fecha_hora", "estacion_id"),
    TU: ("id_tarjeta", "fecha_hora", "fecha_hora", "cod_parada"),
    AM: ("user_hash", "fecha_hora", "fecha_hora", "station_code"),
    MR: ("tarjeta_mr", "fecha_hora_ingreso", "fecha_hora_salida", "origen_estacion_id"),
}


def operations(silver: Mapping[str, DataFrame]) -> DataFrame:
    """Events of the four operators under one schema; a train trip counts once, at its entry."""
    return union_all(
        [
            silver[op].select(
                F.lit(op).alias("operador"),
                F.col(key).alias("llave_operacional"),
                F.col("bronze_record_id").alias("evento_id"),
                F.col(used).alias("fecha_uso"),
                F.col(known).alias("disponible_desde"),
                "tarifa_quetzales",
                F.col(point).cast("string").alias("punto_origen"),
            )
            for op, (key, used, known, point) in _EVENT_COLUMNS.items()
        ]
    )


def last_instant(silver: Mapping[str, DataFrame]) -> DataFrame:
    """Greatest event time of all sources, train exits included."""
    parts = [(silver[op], c[1]) for op, c in _EVENT_COLUMNS.items()]
    return global_max([*parts, (silver[MR], "fecha_hora_salida")], "fecha_corte")


USER_WINDOWS = (7, 30, 90)

#: Days whose bits one number holds.
DAY_BITS = 64


def with_identity(events: DataFrame, operator: str, key: str, bridge: DataFrame | None) -> DataFrame:
    """Identity columns of each event.

    The bridge is a pure function of (operator, key), so by default the identity is computed
    in place and the events are not shuffled for it. A curated bridge is joined instead.
    """
    if bridge is None:
        isolated = F.col(operator) == AM
        return events.filter(F.col(key).isNotNull()).withColumns(
            {
                "usuario_canonico_id": fx.canonical_id(F.col(operator), F.col(key)),
                "metodo_match": F.when(isolated, "HASH_AISLADO").otherwise("PATRON_NUMERICO_INFERIDO"),
                "nivel_confianza": F.when(isolated, "ALTO_LOCAL").otherwise("INFERENCIA_ACADEMICA_MEDIA"),
            }
        )
    who = bridge.select(
        F.col("sistema_origen").alias(operator),
        F.col("llave_origen").alias(key),
        "usuario_canonico_id",
        "metodo_match",
        "nivel_confianza",
    )
    return events.join(who, [operator, key], "inner")


def user_features(
    silver: Mapping[str, DataFrame],
    points: DataFrame,
    cut: str | None = None,
    bridge: DataFrame | None = None,
) -> DataFrame:
    """One row per identity at the cut-off; windows are ``(cut - N days, cut]``.

    One pass over the events groups them by (identity, zone) and by (identity, block of 64 days), the days of
    a block being bits of one number; both kinds of rows then meet per identity. An identity with very many
    events meets only its zones and blocks in one task, and no list of days is ever gathered.
    """
    ops = operations(silver)
    if cut is None:
        events = with_scalar(ops, last_instant(silver))
    else:
        events = ops.withColumn("fecha_corte", F.lit(cut).cast("timestamp_ntz"))
    events = events.filter(
        (F.col("fecha_uso") <= F.col("fecha_corte"))
        & (F.col("disponible_desde") <= F.col("fecha_corte"))
    )
    where = points.select(
        F.col("modo").alias("operador"),
        F.col("codigo_punto").alias("punto_origen"),
        F.col("zona_conformada").alias("_zona"),
    )
    used = F.col("fecha_uso")
    located = (
        with_identity(events, "operador", "llave_operacional", bridge)
        .join(where, ["operador", "punto_origen"], "left")
        .withColumn("zona", F.coalesce("_zona", F.lit(fx.ZONE_FALLBACK)))
    )
    window_counts = [
        F.count_if(used > F.col("fecha_corte") - F.make_dt_interval(F.lit(n))).alias(f"n_{n}")
        for n in USER_WINDOWS
    ]
    mode_counts = {m: f"eventos_{s}" for m, s in MODE_SUFFIX.items()}
    measures = [
        F.min("metodo_match").alias("metodo_match"),
        F.min("nivel_confianza").alias("nivel_confianza"),
        F.count(F.lit(1)).alias("n"),
        F.min(used).alias("primero"),
        F.max(used).alias("ultimo"),
        *window_counts,
        F.count_if(fx.is_peak(used)).alias("pico"),
        F.sum("tarifa_quetzales").alias("gasto"),
        F.count("tarifa_quetzales").alias("con_tarifa"),
        *[F.count_if(F.col("operador") == m).alias(c) for m, c in mode_counts.items()],
        F.bit_or("_bit").alias("_dias"),
    ]
    sums = ["n", *[f"n_{n}" for n in USER_WINDOWS], "pico", "gasto", "con_tarifa", *mode_counts.values()]
    day = F.unix_date(used.cast("date"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(day, F.lit(DAY_BITS)))
    dated = located.withColumns({"_bloque": F.floor(day / DAY_BITS), "_bit": bit})
    user = ["usuario_canonico_id", "fecha_corte"]
    parts = dated.groupingSets([[*user, "zona"], [*user, "_bloque"]], *user, "zona", "_bloque").agg(*measures)
    by_zone = F.col("zona").isNotNull()  # the other rows are blocks of days
    per_user = parts.groupBy(*user).agg(
        F.min("metodo_match").alias("metodo_match"),
        F.min("nivel_confianza").alias("nivel_confianza"),
        F.min("primero").alias("primero"),
        F.max("ultimo").alias("ultimo"),
        *[F.sum(F.when(by_zone, F.col(c))).alias(c) for c in sums],
        F.sum(F.when(~by_zone, F.bit_count("_dias"))).cast("long").alias("dias_activos"),
        F.min_by("zona", F.when(by_zone, F.struct(-F.col("n"), F.col("zona")))).alias("zona_origen_frecuente"),
    )
    ranked_modes = F.array_sort(
        F.array(*[F.struct((-F.col(c)).alias("n"), F.lit(m).alias("modo")) for m, c in mode_counts.items()])
    )
    modes_used = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in mode_counts.values()), F.lit(0))
    return per_user.select(
        "usuario_canonico_id",
        "metodo_match",
        "nivel_confianza",
        "fecha_corte",
        F.col("n").alias("total_eventos"),
        modes_used.alias("modos_utilizados"),
        (modes_used > 1).alias("es_multimodal"),
        "dias_activos",
        F.col("primero").alias("primer_evento"),
        F.col("ultimo").alias("ultimo_evento"),
        fx.elapsed(F.col("primero"), F.col("ultimo"), "whole_days").alias("span_dias_uso"),
        *[F.col(f"n_{n}").alias(f"eventos_ultimos_{n}_dias") for n in USER_WINDOWS],
        ranked_modes[0]["modo"].alias("modo_mas_usado"),
        fx.elapsed(F.col("ultimo"), F.col("fecha_corte"), "whole_days").alias("dias_desde_ultimo_evento"),
        fx.ratio(F.col("pico"), F.col("n")).alias("proporcion_eventos_hora_pico"),
        "zona_origen_frecuente",
        F.round("gasto", 2).alias("gasto_total_gtq"),
        fx.ratio(F.col("gasto"), F.col("con_tarifa"), 2).alias("tarifa_promedio_gtq"),
        *mode_counts.values(),
        (F.col(mode_counts[AM]) > 0).alias("usa_aerometro"),
    )


def card_uses(silver: Mapping[str, DataFrame], rejected: DataFrame) -> DataFrame:
    """Non-quarantined uses of identified cards, with event and knowledge time."""
    ops = operations(silver).filter(
        fx.not_blank(F.col("llave_operacional"))
        & F.col("fecha_uso").isNotNull()
        & F.col("disponible_desde").isNotNull()
    )
    return exclude(ops, rejected, {"operador": "fuente", "evento_id": "id_registro_crudo"})
