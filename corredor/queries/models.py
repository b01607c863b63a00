"""Warehouse models, views, evidence and assertions on the bound sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators import quality
from corredor.plans import evidence, gold, pit, silver, views
from corredor.plans.silver import AM, MR, TM, TU
from corredor.queries.bindings import CUTS, DETECTED, HORIZON, KEY, LABEL_DAYS, Warehouse
from corredor.queries.oracle import _half_up, _hmac, _key, peak, ts
from corredor.queries.registry import query

c = F.col
DAY = "strftime({0}, '%Y-%m-%d')"
MODES = ["transmetro", "transurbano", "metroriel", "aerometro"]


def _money(col: str, name: str) -> str:
    return f"CAST({col} AS DOUBLE) AS {name}"


# ---- silver ----------------------------------------------------------------------------------


@query(
    "M01_min_user_keys",
    """SELECT DISTINCT num_tarjeta AS llave_origen, 'Transurbano' AS sistema_origen FROM tu_raw
       UNION ALL SELECT DISTINCT card, 'MetroRiel' FROM mr_raw UNION ALL SELECT DISTINCT user_hash, 'Aerometro' FROM am_raw""",
)
def m01(w: Warehouse):
    return silver.min_user_keys(w.tu_transactions_raw, w.mr_trips_raw, w.am_boardings_raw)


@query(
    "M02_tm_boardings",
    f"SELECT estacion_id, tarjeta_id, {ts('fecha_hora')}, linea, {_money('tarifa', 'tarifa_quetzales')}, bronze_record_id, ingesta_timestamp FROM tm",
)
def m02(w: Warehouse):
    return w.silver[TM]


@query(
    "M03_tu_transactions",
    f"SELECT id_transaccion, id_tarjeta, {ts('fecha_hora')}, cod_parada, ruta, zona AS zona_conformada, {_money('tarifa', 'tarifa_quetzales')}, bronze_record_id, ingesta_timestamp FROM tu",
)
def m03(w: Warehouse):
    return silver.tu_transactions(w.tu_transactions_raw, w.tu_stops, HORIZON)


@query(
    "M04_mr_trips",
    f"""SELECT CAST(trip_id AS VARCHAR) AS viaje_id, tarjeta_mr, origen AS origen_estacion_id, destino AS destino_estacion_id,
        {ts('ingreso', 'fecha_hora_ingreso')}, {ts('salida', 'fecha_hora_salida')}, {_money('tarifa', 'tarifa_quetzales')},
        minutos AS duracion_minutos, bronze_record_id, ingesta_timestamp FROM mr""",
)
def m04(w: Warehouse):
    return w.silver[MR]


@query(
    "M05_am_boardings",
    f"""SELECT CAST(boarding_id AS VARCHAR) AS boarding_id, user_hash, station_code, eje, {ts('fecha_hora')},
        CAST(cabin_number AS BIGINT) AS cabin_number, zona AS zona_conformada, {_money('tarifa', 'tarifa_quetzales')},
        bronze_record_id, ingesta_timestamp FROM am""",
)
def m05(w: Warehouse):
    return w.silver[AM]


@query(
    "M06_quarantine",
    f"""SELECT fuente, id AS id_registro_crudo, motivo AS motivo_rechazo, payload, '{DETECTED}' AS fecha_deteccion FROM quarantine""",
)
def m06(w: Warehouse):
    return w.quarantine


@query(
    "M07_quality_metrics",
    """SELECT r.fuente, motivo AS motivo_rechazo, n AS total_violaciones, u AS registros_unicos_fuente,
       round(100.0 * n / sum(n) OVER (PARTITION BY r.fuente), 3) AS porcentaje_dentro_fuente
       FROM (SELECT fuente, motivo, count(*) AS n FROM quarantine GROUP BY 1, 2) r
       JOIN (SELECT fuente, count(DISTINCT id) AS u FROM quarantine GROUP BY 1) q ON q.fuente = r.fuente""",
)
def m07(w: Warehouse):
    return silver.quality_metrics(w.quarantine)


@query(
    "M08_point_catalog",
    "SELECT modo, codigo_punto, nombre_punto, zona_conformada, servicio_codigo, CAST(latitud AS DOUBLE) AS latitud, CAST(longitud AS DOUBLE) AS longitud FROM points",
)
def m08(w: Warehouse):
    return w.points


@query("M09_zone_universe", "SELECT * FROM universe")
def m09(w: Warehouse):
    return w.universe


@query(
    "M10_identity_bridge",
    f"SELECT uid AS usuario_canonico_id, op AS sistema_origen, llave AS llave_origen, metodo AS metodo_match, nivel AS nivel_confianza, '2024-03-01' AS fecha_proceso FROM bridge",
)
def m10(w: Warehouse):
    return silver.identity_bridge(w.silver, "2024-03-01")


@query(
    "M11_card_history",
    f"""SELECT tarjeta || ':' || seq AS version_id, tarjeta AS tarjeta_id, seq AS valid_from_seq, seq2 AS valid_to_seq,
        {ts('commit_ts', 'valid_from')}, {ts('ts2', 'valid_to')}, seq2 IS NULL AS vigente, op AS operacion,
        CASE op WHEN 'DELETE' THEN 'INACTIVA' ELSE 'ACTIVA' END AS estado_tarjeta, perfil AS perfil_usuario,
        zona AS zona_residencia FROM scd""",
)
def m11(w: Warehouse):
    return silver.card_history(w.cdc)


def _features_sql(cut: str, tail: str) -> str:
    """User features recomputed with windows over the events."""
    return f"""WITH uf_ev AS (
      SELECT b.uid, b.metodo, b.nivel, o.*, {cut} AS corte, coalesce(p.zona_conformada, 'ZONA_DESCONOCIDA') AS zona
      FROM ops o JOIN bridge b ON b.op = o.op AND b.llave = o.llave
      LEFT JOIN points p ON p.modo = o.op AND p.codigo_punto = o.punto
      WHERE uso <= {cut} AND sabido <= {cut}),
    uf_m AS (SELECT uid, op, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, op) AS r FROM uf_ev GROUP BY 1, 2),
    uf_z AS (SELECT uid, zona, row_number() OVER (PARTITION BY uid ORDER BY count(*) DESC, zona) AS r FROM uf_ev GROUP BY 1, 2),
    uf AS (SELECT uid AS usuario_canonico_id, min(metodo) AS metodo_match, min(nivel) AS nivel_confianza, corte,
      count(*) AS total_eventos, count(DISTINCT op) AS modos_utilizados, count(DISTINCT CAST(uso AS DATE)) AS dias_activos,
      min(uso) AS primero, max(uso) AS ultimo,
      {', '.join(f"count(CASE WHEN uso > corte - INTERVAL {n} DAY THEN 1 END) AS eventos_ultimos_{n}_dias" for n in (7, 30, 90))},
      {', '.join(f"count(CASE WHEN lower(op) = '{m}' THEN 1 END) AS eventos_{m}" for m in MODES)},
      round(count(CASE WHEN {peak('uso')} THEN 1 END) / count(*), 6) AS pico,
      round(CAST(sum(tarifa) AS DOUBLE), 2) AS gasto, {_half_up('sum(tarifa)', 10000, 'count(*)')} AS media
      FROM uf_ev GROUP BY uid, corte)
    {tail}"""


_LAST = "(SELECT max(x) FROM (SELECT max(uso) AS x FROM ops UNION ALL SELECT max(sabido) FROM ops))"


@query(
    "M12_user_features",
    _features_sql(
        _LAST,
        f"""SELECT usuario_canonico_id, metodo_match, nivel_confianza, {ts('corte', 'fecha_corte')}, total_eventos, modos_utilizados,
        modos_utilizados > 1 AS es_multimodal, dias_activos, {ts('primero', 'primer_evento')}, {ts('ultimo', 'ultimo_evento')},
        CAST(floor(epoch(ultimo - primero) / 86400) AS BIGINT) AS span_dias_uso,
        eventos_ultimos_7_dias, eventos_ultimos_30_dias, eventos_ultimos_90_dias, uf_m.op AS modo_mas_usado,
        CAST(floor(epoch(corte - ultimo) / 86400) AS BIGINT) AS dias_desde_ultimo_evento, pico AS proporcion_eventos_hora_pico,
        uf_z.zona AS zona_origen_frecuente, gasto AS gasto_total_gtq, media AS tarifa_promedio_gtq,
        eventos_transmetro, eventos_transurbano, eventos_metroriel, eventos_aerometro, eventos_aerometro > 0 AS usa_aerometro
        FROM uf JOIN uf_m ON uf_m.uid = usuario_canonico_id AND uf_m.r = 1
        JOIN uf_z ON uf_z.uid = usuario_canonico_id AND uf_z.r = 1""",
    ),
)
def m12(w: Warehouse):
    return w.user_features


@query(
    "M13_card_uses",
    f"""SELECT op AS operador, llave AS llave_operacional, id AS evento_id, {ts('uso', 'fecha_uso')},
        {ts('sabido', 'disponible_desde')}, {_money('tarifa', 'tarifa_quetzales')}, punto AS punto_origen FROM uses""",
)
def m13(w: Warehouse):
    return w.uses


# ---- point in time ---------------------------------------------------------------------------


@query(
    "M14_card_population",
    f"""SELECT unidad_id, op AS operador, llave AS llave_operacional, corte, {ts('fc', 'fecha_corte')},
        previos AS eventos_previos_28d, futuros AS eventos_futuros_{LABEL_DAYS}d, CAST(etiqueta AS BIGINT) AS etiqueta FROM pop""",
)
def m14(w: Warehouse):
    return w.population


@query(
    "M15_card_cost",
    f"""WITH act AS (SELECT DISTINCT corte, op, llave FROM cuts, uses WHERE uso >= fc AND uso < fc + INTERVAL {LABEL_DAYS} DAY
          AND sabido < fc + INTERVAL {LABEL_DAYS} DAY AND corte <> 'C'),
      otra AS (SELECT DISTINCT p.corte, p.unidad_id FROM pop p JOIN bridge a ON a.op = p.op AND a.llave = p.llave
          JOIN bridge b ON b.uid = a.uid AND b.op <> a.op JOIN act ON act.corte = p.corte AND act.op = b.op AND act.llave = b.llave
          WHERE p.etiqueta = 1 AND a.uid LIKE 'USR-%' AND a.op <> 'Aerometro' AND b.op <> 'Aerometro')
      SELECT c.corte, {ts('c.fc', 'fecha_corte')}, count(p.unidad_id) AS poblacion, count(CASE WHEN etiqueta = 1 THEN 1 END) AS positivos,
        round(count(CASE WHEN etiqueta = 1 THEN 1 END) / nullif(count(p.unidad_id), 0), 6) AS tasa_positiva,
        count(o.unidad_id) AS positivos_con_actividad_otro_operador,
        round(count(o.unidad_id) / nullif(count(CASE WHEN etiqueta = 1 THEN 1 END), 0), 6) AS proporcion_costo,
        count(CASE WHEN etiqueta = 1 AND p.op = 'Aerometro' THEN 1 END) AS positivos_aerometro
      FROM cuts c LEFT JOIN pop p ON p.corte = c.corte LEFT JOIN otra o ON o.corte = p.corte AND o.unidad_id = p.unidad_id
      WHERE c.corte <> 'C' GROUP BY c.corte, c.fc""",
)
def m15(w: Warehouse):
    return w.cost


@query(
    "M16_card_features",
    f"""SELECT unidad_id, corte, {ts('fc', 'fecha_corte')}, op AS operador, viajes_28d, CAST(viajes_7d AS BIGINT) AS viajes_7d,
        CAST(viajes_14d AS BIGINT) AS viajes_14d, dias_activos_28d, round(dias_desde_ultimo_uso, 6) AS dias_desde_ultimo_uso,
        gasto_28d_gtq, round(tarifa_media_gtq, 6) AS tarifa_media_gtq, puntos_origen_28d,
        round(proporcion_hora_pico, 6) AS proporcion_hora_pico, round(proporcion_fin_semana, 6) AS proporcion_fin_semana,
        CAST(etiqueta AS BIGINT) AS etiqueta FROM feat""",
)
def m16(w: Warehouse):
    return w.features


# ---- gold ------------------------------------------------------------------------------------


@query("M17_dim_mode", "SELECT DISTINCT md5(modo) AS modo_sk, modo AS nombre_modo FROM points")
def m17(w: Warehouse):
    return w.modes


@query("M18_dim_zone", "SELECT md5(nombre_zona) AS zona_sk, * FROM universe")
def m18(w: Warehouse):
    return w.zones


@query(
    "M19_dim_point",
    """SELECT md5(modo || ':' || codigo_punto) AS punto_sk, md5(modo) AS modo_sk, md5(zona_conformada) AS zona_sk, codigo_punto,
       nombre_punto, modo, zona_conformada, servicio_codigo, CAST(latitud AS DOUBLE) AS latitud, CAST(longitud AS DOUBLE) AS longitud FROM points""",
)
def m19(w: Warehouse):
    return w.dim_points


@query(
    "M20_dim_service",
    """SELECT DISTINCT md5(modo || ':' || s) AS servicio_sk, md5(modo) AS modo_sk, modo, s AS codigo_servicio, t AS tipo_servicio FROM (
       SELECT op AS modo, CASE WHEN op = 'MetroRiel' THEN 'SERVICIO_GENERAL' ELSE coalesce(nullif(servicio, ''), 'SIN_SERVICIO') END AS s,
       CASE op WHEN 'Transmetro' THEN 'Línea' WHEN 'Transurbano' THEN 'Ruta' WHEN 'Aerometro' THEN 'Eje' ELSE 'Servicio' END AS t FROM ops)""",
)
def m20(w: Warehouse):
    return gold.dim_service(w.silver)


@query(
    "M21_dim_time",
    f"""SELECT {_key('x')} AS tiempo_sk, {ts('x', 'fecha_hora')}, {DAY.format('x')} AS fecha, year(x) AS anio, month(x) AS mes,
        day(x) AS dia, isodow(x) AS dia_semana_iso, hour(x) AS hora, minute(x) AS minuto, second(x) AS segundo,
        isodow(x) < 6 AS es_dia_habil, {peak('x')} AS es_hora_pico FROM (SELECT uso AS x FROM ops UNION SELECT sabido FROM ops)""",
)
def m21(w: Warehouse):
    return gold.dim_time(w.silver)


@query(
    "M22_dim_user",
    f"""SELECT {_hmac('uid')} AS usuario_sk, count(DISTINCT op) AS modos_observados, CASE WHEN bool_or(metodo = 'HASH_AISLADO')
        THEN 'HASH_AISLADO' ELSE 'PATRON_NUMERICO_INFERIDO' END AS metodo_identidad FROM bridge GROUP BY uid""",
)
def m22(w: Warehouse):
    return w.users


@query(
    "M23_fact_boardings",
    f"""SELECT md5(modo || ':' || id) AS abordaje_sk, usuario_sk, {_key('uso')} AS tiempo_sk, md5(zona) AS zona_sk,
        md5(modo || ':' || punto) AS punto_sk, md5(modo) AS modo_sk, md5(modo || ':' || servicio) AS servicio_sk,
        modo AS fuente_evento, CAST(1 AS BIGINT) AS cantidad_abordajes, {_money('tarifa', 'tarifa_quetzales')}, id AS bronze_record_id FROM facts""",
)
def m23(w: Warehouse):
    return w.boardings


@query(
    "M24_fact_trips",
    f"""SELECT md5('MetroRiel:' || id) AS viaje_sk, usuario_sk, {_key('ingreso')} AS tiempo_ingreso_sk, {_key('salida')} AS tiempo_salida_sk,
        md5(zona_o) AS zona_origen_sk, md5(zona_d) AS zona_destino_sk, md5('MetroRiel:' || origen) AS punto_origen_sk,
        md5('MetroRiel:' || destino) AS punto_destino_sk, md5('MetroRiel') AS modo_sk, md5('MetroRiel:SERVICIO_GENERAL') AS servicio_sk,
        'MetroRiel' AS fuente_evento, CAST(1 AS BIGINT) AS cantidad_viajes, {_money('tarifa', 'tarifa_quetzales')},
        minutos AS duracion_minutos, id AS bronze_record_id FROM ftrips""",
)
def m24(w: Warehouse):
    return w.trips


@query(
    "M25_demand_hour",
    f"SELECT {DAY.format('dia')} AS fecha, hora, es_dia_habil, es_hora_pico, modo, zona, tipo_evento, n AS cantidad_eventos, tarifa AS tarifa_total_gtq FROM demand",
)
def m25(w: Warehouse):
    return w.demand


_PER_POINT = {
    "eventos_por_punto": ("eventos_totales", "puntos_transporte"),
    "eventos_por_punto_transmetro": ("eventos_transmetro", "puntos_transmetro"),
    "eventos_por_punto_transurbano": ("eventos_transurbano", "puntos_transurbano"),
    "viajes_por_estacion_metroriel": ("eventos_metroriel", "puntos_metroriel"),
    "eventos_por_punto_aerometro": ("eventos_aerometro", "puntos_aerometro"),
}
_PER_POINT_SQL = {
    n: f"CAST(round(CAST({a} AS DECIMAL(18,4)) / nullif({b}, 0), 1) AS DOUBLE) AS {n}" for n, (a, b) in _PER_POINT.items()
}


@query(
    "M26_coverage",
    f"""SELECT md5(nombre_zona) AS zona_sk, *, {', '.join(_PER_POINT_SQL.values())},
        CAST(round(100.0 * eventos_totales / nullif(sum(eventos_totales) OVER (), 0), 2) AS DOUBLE) AS pct_demanda_red,
        rank() OVER (ORDER BY eventos_totales DESC) AS ranking_demanda,
        tiene_servicio <> (eventos_totales > 0) AS inconsistencia_cobertura FROM coverage""",
)
def m26(w: Warehouse):
    return w.coverage


_TRAIN_SQL = """SELECT nombre_zona, estaciones_metroriel, tm + tu + am AS abordajes_otros_modos,
       tm AS abordajes_transmetro, tu AS abordajes_transurbano, am AS abordajes_aerometro, mr AS viajes_metroriel_iniciados,
       pct AS pct_abordajes_otros_modos_red, r AS ranking_demanda_otros_modos, total AS total_abordajes_otros_modos_red,
       areas AS areas_en_ranking_red FROM (
         SELECT nombre_zona, puntos_metroriel AS estaciones_metroriel, eventos_transmetro AS tm, eventos_transurbano AS tu,
         eventos_aerometro AS am, eventos_metroriel AS mr, count(*) OVER () AS areas,
         CAST(sum(eventos_totales - eventos_metroriel) OVER () AS BIGINT) AS total,
         CAST(round(100.0 * (eventos_totales - eventos_metroriel) / sum(eventos_totales - eventos_metroriel) OVER (), 2) AS DOUBLE) AS pct,
         rank() OVER (ORDER BY eventos_totales - eventos_metroriel DESC) AS r FROM coverage) WHERE estaciones_metroriel > 0"""


@query("M27_train_zones", f"SELECT md5(nombre_zona) AS zona_sk, * FROM ({_TRAIN_SQL})")
def m27(w: Warehouse):
    return w.train_zones


_TRANSFER_SQL = f"""SELECT md5(usuario_sk || ':' || id0 || ':' || id) AS transbordo_sk, usuario_sk, id0 AS bronze_record_id_origen,
        id AS bronze_record_id_destino, {DAY.format('uso0')} AS fecha_transbordo, hour(uso0) AS hora_transbordo,
        {ts('uso0', 'momento_inicio_transbordo')}, {ts('uso', 'momento_fin_transbordo')}, modo0 AS modo_origen, modo AS modo_destino,
        modo0 || ' -> ' || modo AS combinacion_modos, zona0 AS zona_origen, zona AS zona_destino,
        CAST(round(CAST(minutos AS DECIMAL(18,6)), 2) AS DOUBLE) AS tiempo_transferencia_minutos,
        CAST(tarifa0 + tarifa AS DOUBLE) AS tarifa_acumulada_gtq, modo0 = 'Aerometro' OR modo = 'Aerometro' AS incluye_aerometro,
        CAST(1 AS BIGINT) AS cantidad_transbordos FROM transfer"""


@query("M28_transfers", _TRANSFER_SQL)
def m28(w: Warehouse):
    return w.transfers


# ---- views and report queries ----------------------------------------------------------------

_BAND = "CASE WHEN es_hora_pico THEN 'Hora pico' ELSE 'Fuera de pico' END AS franja"


@query(
    "M29_view_demand_boardings",
    f"SELECT {DAY.format('dia')} AS fecha, hora, es_dia_habil, es_hora_pico, {_BAND}, modo, zona, n AS cantidad_abordajes, tarifa AS tarifa_total_gtq FROM demand WHERE tipo_evento = 'abordaje'",
)
def m29(w: Warehouse):
    return views.view_demand_boardings(w.demand)


@query(
    "M30_view_demand_trips",
    f"SELECT {DAY.format('dia')} AS fecha, hora, es_dia_habil, es_hora_pico, {_BAND}, modo, zona AS zona_origen, n AS viajes_iniciados, tarifa AS tarifa_total_gtq FROM demand WHERE tipo_evento = 'viaje'",
)
def m30(w: Warehouse):
    return views.view_demand_trips(w.demand)


@query(
    "M31_view_coverage",
    f"""SELECT nombre_zona, tipo_area, tiene_servicio, modos_con_servicio, puntos_transporte, puntos_transmetro, puntos_transurbano,
        puntos_metroriel, puntos_aerometro, eventos_totales - eventos_metroriel AS abordajes, eventos_transmetro AS abordajes_transmetro,
        eventos_transurbano AS abordajes_transurbano, eventos_aerometro AS abordajes_aerometro, eventos_metroriel AS viajes_mr_iniciados,
        {', '.join(_PER_POINT_SQL[n] for n in list(_PER_POINT_SQL)[1:])},
        CAST(round(100.0 * (eventos_totales - eventos_metroriel) / sum(eventos_totales - eventos_metroriel) OVER (), 2) AS DOUBLE) AS pct_abordajes_red,
        rank() OVER (ORDER BY eventos_totales - eventos_metroriel DESC) AS ranking_abordajes,
        rank() OVER (ORDER BY eventos_metroriel DESC) AS ranking_viajes_mr_origen FROM coverage""",
)
def m31(w: Warehouse):
    return views.view_coverage(w.coverage)


@query("M32_view_train_zones", _TRAIN_SQL)
def m32(w: Warehouse):
    return views.view_train_zones(w.train_zones)


@query(
    "M33_view_multimodality",
    """WITH g AS (SELECT m AS modos_observados, t AS metodo_identidad, count(*) AS usuarios FROM
         (SELECT uid, count(DISTINCT op) AS m, min(metodo) AS t FROM bridge GROUP BY uid) GROUP BY 1, 2)
       SELECT *, (SELECT CAST(sum(usuarios) AS BIGINT) FROM g) AS total_usuarios_observados,
         (SELECT CAST(sum(usuarios) AS BIGINT) FROM g WHERE modos_observados > 1) AS usuarios_multimodales_total,
         (SELECT CAST(sum(usuarios) AS BIGINT) FROM g WHERE modos_observados = 1) AS usuarios_unimodales_total,
         (SELECT round(100.0 * sum(CASE WHEN modos_observados > 1 THEN usuarios END) / sum(usuarios), 2) FROM g) AS pct_usuarios_multimodales FROM g""",
)
def m33(w: Warehouse):
    return views.view_multimodality(w.users)


@query(
    "M34_view_transfers",
    f"""SELECT fecha_transbordo AS fecha, hora_transbordo AS hora, modo_origen, modo_destino, combinacion_modos, zona_origen, zona_destino,
        incluye_aerometro, count(*) AS total_transbordos,
        {_half_up('sum(CAST(tiempo_transferencia_minutos AS DECIMAL(18,2)))', 100, 'count(*)')} AS tiempo_promedio_transferencia_minutos,
        CAST(round(sum(CAST(tarifa_acumulada_gtq AS DECIMAL(18,4))), 2) AS DOUBLE) AS tarifa_total_gtq
        FROM ({_TRANSFER_SQL}) GROUP BY ALL""",
)
def m34(w: Warehouse):
    return w.view_transfers


_ABC = "SELECT modo, zona, hour(uso) AS hora, count(*) AS abordajes FROM gev WHERE tipo = 'abordaje' GROUP BY ALL"


@query("M35_a_from_fact", _ABC)
def m35a(w: Warehouse):
    return views.demand_from_fact(w.boardings, w.zones, w.modes)


@query("M35_b_from_mart", _ABC)
def m35b(w: Warehouse):
    return views.demand_by_mode_zone_hour(w.demand, "cantidad_eventos")


@query("M35_c_from_view", _ABC)
def m35c(w: Warehouse):
    return views.demand_by_mode_zone_hour(views.view_demand_boardings(w.demand), "cantidad_abordajes")


@query(
    "M36_events_last_month",
    """WITH m AS (SELECT date_trunc('month', max(x)) AS m FROM (SELECT max(uso) AS x FROM facts UNION ALL SELECT max(salida) FROM ftrips))
       SELECT strftime(m, '%Y-%m-%d') AS mes, a AS abordajes_mes_tm_tu_am, v AS viajes_metroriel_mes, a + v AS eventos_movilidad_mes FROM
       (SELECT (SELECT m FROM m) AS m, (SELECT count(*) FROM facts WHERE date_trunc('month', uso) = (SELECT m FROM m)) AS a,
               (SELECT count(*) FROM ftrips WHERE date_trunc('month', ingreso) = (SELECT m FROM m)) AS v)""",
)
def m36(w: Warehouse):
    return views.events_last_month(w.boardings, w.trips)


@query(
    "M37_population_evidence",
    f"""SELECT d.corte, d.op AS operador, coalesce(n, 0) AS poblacion, coalesce(pos, 0) AS positivos, CAST(0 AS BIGINT) AS diferencias,
        coalesce(otra, 0) AS costo_recalculado, dias_previos, dias_futuros, {ts('primer_uso')}, {ts('ultimo_uso')} FROM
        (SELECT corte, op, min(uso) AS primer_uso, max(uso) AS ultimo_uso, count(DISTINCT CASE WHEN uso >= fc - INTERVAL 28 DAY AND uso < fc AND sabido < fc THEN CAST(uso AS DATE) END) AS dias_previos,
           count(DISTINCT CASE WHEN uso >= fc AND uso < fc + INTERVAL {LABEL_DAYS} DAY AND sabido < fc + INTERVAL {LABEL_DAYS} DAY
                 THEN CAST(uso AS DATE) END) AS dias_futuros FROM cuts, uses WHERE corte <> 'C' GROUP BY corte, op) d
        LEFT JOIN (SELECT corte, op, count(*) AS n, count(CASE WHEN etiqueta = 1 THEN 1 END) AS pos FROM pop GROUP BY 1, 2) p
          ON p.corte = d.corte AND p.op = d.op
        LEFT JOIN (SELECT p.corte, p.op, count(DISTINCT p.unidad_id) AS otra FROM pop p JOIN bridge a ON a.op = p.op AND a.llave = p.llave
          JOIN bridge b ON b.uid = a.uid AND b.op <> a.op AND a.uid LIKE 'USR-%' JOIN uses u ON u.op = b.op AND u.llave = b.llave
          AND uso >= p.fc AND uso < p.fc + INTERVAL {LABEL_DAYS} DAY AND sabido < p.fc + INTERVAL {LABEL_DAYS} DAY
          WHERE p.etiqueta = 1 GROUP BY 1, 2) o ON o.corte = d.corte AND o.op = d.op""",
)
def m37(w: Warehouse):
    return evidence.population_evidence(w.population, w.uses, w.history, w.bridge, w.cuts, label_days=LABEL_DAYS)


_NULL_COLUMNS = [
    "usuario_canonico_id", "metodo_match", "nivel_confianza", "fecha_corte", "total_eventos", "modos_utilizados", "es_multimodal",
    "dias_activos", "primer_evento", "ultimo_evento", "span_dias_uso", "eventos_ultimos_7_dias", "eventos_ultimos_30_dias",
    "eventos_ultimos_90_dias", "modo_mas_usado", "dias_desde_ultimo_evento", "proporcion_eventos_hora_pico", "zona_origen_frecuente",
    "gasto_total_gtq", "tarifa_promedio_gtq", "eventos_transmetro", "eventos_transurbano", "eventos_metroriel", "eventos_aerometro",
    "usa_aerometro",
]


@query(
    "M38_layer_profile",
    _features_sql(
        _LAST,
        f""", t AS ({_TRANSFER_SQL}), u AS (SELECT uid, count(DISTINCT op) AS m, min(metodo) AS t FROM bridge GROUP BY uid)
    SELECT relacion, metrica, CAST(valor AS DOUBLE) AS valor FROM (
      SELECT op AS relacion, 'eventos' AS metrica, CAST(count(*) AS DOUBLE) AS valor FROM ops GROUP BY op
      UNION ALL SELECT op, 'minimo', {_key('min(uso)')} FROM ops GROUP BY op
      UNION ALL SELECT op, 'maximo', {_key('max(uso)')} FROM ops GROUP BY op
      UNION ALL SELECT 'features', 'filas', count(*) FROM uf
      UNION ALL SELECT 'features', 'usuarios_unicos', count(*) FROM uf
      UNION ALL SELECT 'features', 'usuarios_multimodales', count(*) FROM uf WHERE modos_utilizados > 1
      UNION ALL SELECT 'features', 'total_eventos', sum(total_eventos) FROM uf
      UNION ALL SELECT 'features', 'eventos_ultimos_7_dias', sum(eventos_ultimos_7_dias) FROM uf
      UNION ALL SELECT 'features', 'eventos_ultimos_30_dias', sum(eventos_ultimos_30_dias) FROM uf
      UNION ALL SELECT 'features', 'eventos_ultimos_90_dias', sum(eventos_ultimos_90_dias) FROM uf
      UNION ALL SELECT 'features', 'posteriores_al_corte', count(*) FROM uf WHERE ultimo > corte
      UNION ALL SELECT 'features', 'nulos_' || n, 0 FROM (VALUES {', '.join(f"('{n}')" for n in _NULL_COLUMNS)}) x(n)
      UNION ALL SELECT 'features', 'modos_utilizados=' || modos_utilizados, count(*) FROM uf GROUP BY modos_utilizados
      UNION ALL SELECT 'usuarios', 'modos_observados=' || m, count(*) FROM u GROUP BY m
      UNION ALL SELECT 'usuarios', 'metodo_identidad=' || t, count(*) FROM u GROUP BY t
      UNION ALL SELECT 'transbordos', 'combinacion_modos=' || combinacion_modos, count(*) FROM t GROUP BY combinacion_modos
      UNION ALL SELECT 'transbordos', 'total', count(*) FROM t
      UNION ALL SELECT 'transbordos', 'minimo_minutos', min(tiempo_transferencia_minutos) FROM t
      UNION ALL SELECT 'transbordos', 'maximo_minutos', max(tiempo_transferencia_minutos) FROM t
      UNION ALL SELECT 'transbordos', 'promedio_minutos', round(CAST(sum(CAST(tiempo_transferencia_minutos AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) FROM t
      UNION ALL SELECT 'transbordos', 'incluye_aerometro', count(CASE WHEN incluye_aerometro THEN 1 END) FROM t)""",
    ),
)
def m38(w: Warehouse):
    w = w.stored
    return evidence.layer_profile(w.silver, w.user_features, w.users, w.transfers)
