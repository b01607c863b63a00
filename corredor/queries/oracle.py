"""Oracle SQL: the bindings and models restated as common table expressions.

``sql("SELECT … FROM x")`` prefixes the named expressions the statement needs.
"""

from __future__ import annotations

import re

from corredor.functions import scalars as fx
from corredor.queries.bindings import CUTS, HORIZON, KEY, LABEL_DAYS

_AREA_LIST = "[" + ", ".join(f"'{a}'" for a, _ in fx.AREAS) + "]"
_AREA_ROWS = ", ".join(f"('{a}', '{t}')" for a, t in fx.AREAS)
_PEAK = "(isodow({0}) BETWEEN 1 AND 5 AND hour({0}) IN (6, 7, 8, 17, 18, 19))"


def _zone(c: str) -> str:
    words = f"list_transform(string_split(lower(trim({c})), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2))"
    return (
        f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'Desconocida' "
        f"WHEN regexp_matches(lower(trim({c})), '^(z|zona ?|district ?)[0-9]+$') "
        f"THEN 'Zona ' || regexp_extract({c}, '[0-9]+') ELSE array_to_string({words}, ' ') END"
    )


def _hmac(value: str) -> str:
    block = KEY.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ m for b in block).hex() for m in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


def _key(ts: str) -> str:
    return f"CAST(strftime({ts}, '%Y%m%d%H%M%S') AS BIGINT)"


def _half_up(total: str, unit: int, n: str) -> str:
    """Mean rounded half up to cents in whole numbers; ``unit`` is the scale factor of the total."""
    scaled = f"CAST(({total}) * {unit} AS BIGINT)"
    return f"((200 * {scaled} + {unit} * {n}) // (2 * {unit} * {n})) / 100.0"


def area(index: str) -> str:
    return f"({_AREA_LIST})[CAST({index} % 14 + 1 AS BIGINT)]"


def ts(col: str, name: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS {name or col.split('.')[-1]}"


def peak(col: str) -> str:
    return _PEAK.format(col)


CTES: dict[str, str] = {}

# ---- sources ---------------------------------------------------------------------------------
CTES["ev"] = """
SELECT event_id, user_id, event_type, date_trunc('second', ts) AS t,
       CAST(CAST(value AS VARCHAR) AS DECIMAL(18,2)) AS v,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
FROM events"""
CTES["tm_raw"] = """
SELECT event_id AS validacion_id,
       CASE WHEN k = 50 THEN 'SIN-TARJETA' ELSE 'TC-' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS tarjeta,
       'TM-' || k AS estacion_id, CASE WHEN k % 7 = 0 THEN '' ELSE 'L' || (k % 7) END AS linea,
       strftime(t, '%Y-%m-%d %H:%M:%S') AS fecha_hora,
       CASE WHEN v < 1 THEN NULL ELSE CAST(v AS VARCHAR) END AS tarifa, event_type AS tipo,
       'tm:' || event_id || CASE WHEN r = 1 THEN ':r' ELSE '' END AS bronze_record_id,
       CASE WHEN r = 1 THEN '2024-02-01T00:05:00' ELSE '2024-02-01T00:00:00' END AS ingesta_timestamp
FROM ev, (VALUES (0), (1)) reads(r)
WHERE event_type IN ('click', 'signup') AND (r = 0 OR v > 150)"""
CTES["tu_raw"] = """
SELECT CASE WHEN k = 77 THEN 'sin fecha'
            WHEN v > 200 THEN strftime(t + INTERVAL 400 DAY, '%d/%m/%Y')
            WHEN k % 2 = 0 THEN strftime(t, '%d/%m/%Y') ELSE strftime(t, '%Y-%m-%d') END AS fecha,
       strftime(t, '%H:%M:%S') AS hora, lpad(CAST(user_id AS VARCHAR), 10, '0') AS num_tarjeta,
       CASE WHEN k = 13 THEN '' WHEN k = 14 THEN NULL ELSE 'P' || k END AS cod_parada,
       CASE WHEN k % 11 = 0 THEN '' ELSE 'R' || (k % 11) END AS ruta,
       CAST(v * 100 AS BIGINT) AS monto_centavos, 'tu:' || event_id AS bronze_record_id,
       '2024-02-01T00:00:00' AS ingesta_timestamp
FROM ev WHERE event_type = 'view'"""
CTES["mr_raw"] = """
SELECT event_id AS trip_id, 'MR' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS card,
       CAST(k AS BIGINT) AS entry_station, t AS entry_ts,
       CASE WHEN v >= 2 THEN CAST((k * 7 + 3) % 100 AS BIGINT) END AS exit_station,
       CASE WHEN v >= 2 THEN t + to_seconds(CAST(floor(v * 20) AS BIGINT)) END AS exit_ts,
       v AS fare_gtq, CASE WHEN v >= 2 THEN CAST(floor(v * 20) AS BIGINT) END AS duration_s,
       'mr:' || event_id AS bronze_record_id, '2024-02-01T00:00:00' AS ingesta_timestamp
FROM ev WHERE event_type = 'purchase'"""
CTES["am_raw"] = """
SELECT event_id AS boarding_id, substr(md5(CAST(user_id AS VARCHAR)), 1, 12) AS user_hash,
       'A' || k AS station_code, 'E' || (k % 3) AS axis, t + INTERVAL 6 HOUR AS utc, k AS cabin_number,
       CASE WHEN v < 1 THEN NULL ELSE v END AS fare, 'am:' || event_id AS bronze_record_id,
       '2024-02-01T00:00:00' AS ingesta_timestamp
FROM ev WHERE event_type = 'error'"""
CTES["points"] = f"""
SELECT 'Transmetro' AS modo, 'TM-' || c_custkey AS codigo_punto, c_name AS nombre_punto,
       {area('c_nationkey')} AS zona_conformada, 'L' || (c_custkey % 7) AS servicio_codigo,
       CASE WHEN c_nationkey <> 3 THEN CAST('14.' || c_nationkey AS DECIMAL(12,6)) END AS latitud,
       CASE WHEN c_nationkey <> 3 THEN CAST('-90.' || c_nationkey AS DECIMAL(12,6)) END AS longitud
FROM customer
UNION ALL SELECT 'Transurbano', 'P' || c_custkey, c_name,
       CASE WHEN c_nationkey = 24 THEN 'Desconocida' ELSE {area('c_nationkey')} END,
       'R' || (c_custkey % 11), NULL, NULL FROM customer
UNION ALL SELECT 'MetroRiel', CAST(p_partkey AS VARCHAR), p_name, {area('p_size')}, 'SERVICIO_GENERAL', NULL, NULL
FROM part
UNION ALL SELECT 'Aerometro', 'A' || c_custkey, c_name, {area('(c_nationkey + 3)')}, 'E' || (c_custkey % 3), NULL, NULL
FROM customer"""
CTES["cdc"] = """
SELECT event_id + 1 AS seq, t AS commit_ts, op,
       CASE WHEN k < 80 THEN 'TC-' || lpad(CAST(user_id AS VARCHAR), 8, '0')
            WHEN k < 90 THEN lpad(CAST(user_id AS VARCHAR), 10, '0')
            WHEN k < 98 THEN 'MR' || lpad(CAST(user_id AS VARCHAR), 7, '0')
            WHEN k = 98 THEN 'SIN-TARJETA' ELSE 'X-' || user_id END AS tarjeta,
       CASE WHEN k < 80 THEN 'TRANSMETRO' WHEN k < 90 THEN 'TRANSURBANO' WHEN k < 98 THEN 'METRORIEL'
            WHEN k = 98 THEN 'SIN_TARJETA' ELSE 'OTRO' END AS tipo_llave,
       CASE WHEN op = 'DELETE' OR v < 10 THEN NULL WHEN v < 40 THEN 'estudiante'
            WHEN v < 80 THEN 'general' ELSE 'tercera_edad' END AS perfil,
       CASE WHEN op = 'DELETE' OR k % 4 = 0 THEN NULL ELSE 'Zona ' || (k % 20 + 1) END AS zona_residencia
FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 'INSERT'
                     WHEN event_type = 'error' AND k < 5 THEN 'DELETE' ELSE 'UPDATE' END AS op FROM ev)"""

# ---- silver ----------------------------------------------------------------------------------
CTES["tm_ranked"] = """
SELECT *, count(*) OVER (PARTITION BY tarjeta, estacion_id, fecha_hora
                         ORDER BY ingesta_timestamp, bronze_record_id ROWS UNBOUNDED PRECEDING) AS nth
FROM tm_raw"""
CTES["tm"] = """
SELECT estacion_id, tarjeta AS tarjeta_id, CAST(fecha_hora AS TIMESTAMP) AS fecha_hora, linea,
       CAST(coalesce(tarifa, '1.00') AS DECIMAL(18,4)) AS tarifa, bronze_record_id, ingesta_timestamp
FROM tm_ranked WHERE nth = 1"""
CTES["tu_dated"] = """
SELECT *, CAST(strftime(d, '%Y-%m-%d') || ' ' || hora AS TIMESTAMP) AS fecha_hora
FROM (SELECT *, coalesce(try_strptime(fecha, '%d/%m/%Y'), try_strptime(fecha, '%Y-%m-%d')) AS d FROM tu_raw)"""
CTES["tu"] = f"""
SELECT 'TU-' || n AS id_transaccion, num_tarjeta AS id_tarjeta, fecha_hora, cod_parada, ruta,
       coalesce(zona_conformada, 'Desconocida') AS zona, CAST(monto_centavos AS DECIMAL(18,4)) / 100 AS tarifa_d,
       CAST(CAST(monto_centavos AS DECIMAL(18,4)) * 0.01 AS DECIMAL(18,4)) AS tarifa, bronze_record_id, ingesta_timestamp
FROM (SELECT *, row_number() OVER (ORDER BY d, hora, num_tarjeta, bronze_record_id) AS n
      FROM tu_dated WHERE d IS NOT NULL) x
LEFT JOIN points p ON p.modo = 'Transurbano' AND p.codigo_punto = x.cod_parada
WHERE trim(coalesce(cod_parada, '')) <> '' AND fecha_hora <= TIMESTAMP '{HORIZON}'"""
CTES["mr"] = """
SELECT trip_id, card AS tarjeta_mr, CAST(entry_station AS VARCHAR) AS origen, CAST(exit_station AS VARCHAR) AS destino,
       entry_ts AS ingreso, exit_ts AS salida, CAST(fare_gtq AS DECIMAL(18,4)) AS tarifa,
       round(CAST(duration_s AS DOUBLE) / 60, 2) AS minutos, bronze_record_id, ingesta_timestamp
FROM mr_raw WHERE exit_station IS NOT NULL AND exit_ts IS NOT NULL"""
CTES["am"] = """
SELECT boarding_id, user_hash, station_code, axis AS eje, utc - INTERVAL 6 HOUR AS fecha_hora, cabin_number,
       coalesce(zona_conformada, 'Desconocida') AS zona, CAST(coalesce(fare, 3) AS DECIMAL(18,4)) AS tarifa,
       bronze_record_id, ingesta_timestamp
FROM am_raw LEFT JOIN points p ON p.modo = 'Aerometro' AND p.codigo_punto = station_code"""
CTES["quarantine"] = f"""
SELECT 'Transmetro' AS fuente, bronze_record_id AS id, 'DUPLICADO_TORNIQUETE' AS motivo,
       CAST(to_json({{'tarjeta': tarjeta, 'estacion_id': estacion_id, 'fecha_hora': fecha_hora}}) AS VARCHAR) AS payload
FROM tm_ranked WHERE nth > 1
UNION ALL SELECT 'Transurbano', bronze_record_id, 'COD_PARADA_NULO',
       CAST(to_json({{'num_tarjeta': num_tarjeta, 'ruta': ruta, 'fecha': fecha, 'hora': hora}}) AS VARCHAR)
FROM tu_dated WHERE trim(coalesce(cod_parada, '')) = ''
UNION ALL SELECT 'Transurbano', bronze_record_id, 'FECHA_FUTURA',
       CAST(to_json({{'num_tarjeta': num_tarjeta, 'fecha': fecha, 'hora': hora}}) AS VARCHAR)
FROM tu_dated WHERE d IS NULL OR fecha_hora > TIMESTAMP '{HORIZON}'
UNION ALL SELECT 'MetroRiel', bronze_record_id, 'VIAJE_SIN_EXIT',
       CAST(to_json({{'viaje_id': trip_id, 'tarjeta_mr': card, 'origen_estacion_id': entry_station}}) AS VARCHAR)
FROM mr_raw WHERE exit_ts IS NULL"""
CTES["universe"] = f"""
SELECT a.nombre_zona, a.tipo_area, count(DISTINCT modo) AS modos_con_servicio, count(modo) AS puntos_transporte,
       count(CASE WHEN modo = 'Transmetro' THEN 1 END) AS puntos_transmetro,
       count(CASE WHEN modo = 'Transurbano' THEN 1 END) AS puntos_transurbano,
       count(CASE WHEN modo = 'MetroRiel' THEN 1 END) AS puntos_metroriel,
       count(CASE WHEN modo = 'Aerometro' THEN 1 END) AS puntos_aerometro,
       count(modo) > 0 AS tiene_servicio
FROM (VALUES {_AREA_ROWS}) a(nombre_zona, tipo_area) LEFT JOIN points p ON p.zona_conformada = a.nombre_zona
GROUP BY ALL"""
CTES["ops"] = """
SELECT 'Transmetro' AS op, tarjeta_id AS llave, bronze_record_id AS id, fecha_hora AS uso, fecha_hora AS sabido,
       tarifa, estacion_id AS punto, linea AS servicio FROM tm
UNION ALL SELECT 'Transurbano', id_tarjeta, bronze_record_id, fecha_hora, fecha_hora, tarifa, cod_parada, ruta FROM tu
UNION ALL SELECT 'Aerometro', user_hash, bronze_record_id, fecha_hora, fecha_hora, tarifa, station_code, eje FROM am
UNION ALL SELECT 'MetroRiel', tarjeta_mr, bronze_record_id, ingreso, salida, tarifa, origen, NULL FROM mr"""
CTES["bridge"] = """
SELECT CASE WHEN op = 'Aerometro' THEN 'AM-' || llave
            WHEN (op = 'Transmetro' AND llave LIKE 'TC-%') OR op IN ('Transurbano', 'MetroRiel')
            THEN 'USR-' || lpad(CAST(CAST(regexp_replace(llave, '[^0-9]', '', 'g') AS BIGINT) AS VARCHAR), 8, '0')
            ELSE 'SIN-TARJETA-' || md5(llave) END AS uid,
       op, llave, CASE op WHEN 'Aerometro' THEN 'HASH_AISLADO' ELSE 'PATRON_NUMERICO_INFERIDO' END AS metodo,
       CASE op WHEN 'Aerometro' THEN 'ALTO_LOCAL' ELSE 'INFERENCIA_ACADEMICA_MEDIA' END AS nivel
FROM (SELECT DISTINCT op, llave FROM ops)"""
CTES["scd"] = """
SELECT tarjeta, seq, lead(seq) OVER w AS seq2, commit_ts, lead(commit_ts) OVER w AS ts2, op,
       last_value(CASE WHEN op <> 'DELETE' THEN perfil END IGNORE NULLS) OVER r AS perfil,
       last_value(CASE WHEN op <> 'DELETE' THEN zona_residencia END IGNORE NULLS) OVER r AS zona
FROM cdc WHERE tipo_llave = 'TRANSMETRO'
WINDOW w AS (PARTITION BY tarjeta ORDER BY seq),
       r AS (PARTITION BY tarjeta ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CTES["state"] = """
SELECT tarjeta, perfil, zona AS zona_residencia, CASE op WHEN 'DELETE' THEN 'INACTIVA' ELSE 'ACTIVA' END AS estado,
       seq AS ultima_seq, commit_ts AS ultimo_commit_ts, op AS ultima_operacion
FROM scd WHERE seq2 IS NULL"""
CTES["uses"] = """
SELECT * FROM ops WHERE trim(coalesce(llave, '')) <> ''
AND (op, id) NOT IN (SELECT (fuente, id) FROM quarantine)"""
_CUT_ROWS = ", ".join(f"('{n}', TIMESTAMP '{d} 00:00:00')" for n, d in CUTS.items())
CTES["cuts"] = f"SELECT * FROM (VALUES {_CUT_ROWS}) c(corte, fc)"
CTES["pop"] = f"""
SELECT md5(p.op || ':' || p.llave) AS unidad_id, p.op, p.llave, p.corte, p.fc, CAST(p.n AS BIGINT) AS previos,
       CASE WHEN p.corte <> 'C' THEN CAST(p.m AS BIGINT) END AS futuros,
       CASE WHEN p.corte <> 'C' THEN CASE WHEN p.m = 0 THEN 1 ELSE 0 END END AS etiqueta
FROM (SELECT corte, fc, op, llave,
             sum(CASE WHEN uso >= fc - INTERVAL 28 DAY AND uso < fc AND sabido < fc THEN 1 ELSE 0 END) AS n,
             sum(CASE WHEN uso >= fc AND uso < fc + INTERVAL {LABEL_DAYS} DAY
                       AND sabido < fc + INTERVAL {LABEL_DAYS} DAY THEN 1 ELSE 0 END) AS m
      FROM cuts, uses GROUP BY ALL) p
WHERE p.n >= 2 AND NOT (p.op = 'Transmetro' AND EXISTS (
      SELECT 1 FROM scd d WHERE d.tarjeta = p.llave AND d.op = 'DELETE' AND d.commit_ts < p.fc))"""
CTES["feat"] = f"""
SELECT p.unidad_id, p.corte, p.fc, p.op, p.llave, p.etiqueta, count(*) AS viajes_28d,
       sum(CASE WHEN uso >= p.fc - INTERVAL 7 DAY THEN 1 ELSE 0 END) AS viajes_7d,
       sum(CASE WHEN uso >= p.fc - INTERVAL 14 DAY THEN 1 ELSE 0 END) AS viajes_14d,
       count(DISTINCT CAST(uso AS DATE)) AS dias_activos_28d,
       epoch(p.fc - max(uso)) / 86400.0 AS dias_desde_ultimo_uso,
       CAST(sum(tarifa) AS DOUBLE) AS gasto_28d_gtq, CAST(sum(tarifa) AS DOUBLE) / count(*) AS tarifa_media_gtq,
       count(DISTINCT punto) AS puntos_origen_28d,
       sum(CASE WHEN {peak('uso')} THEN 1 ELSE 0 END) / count(*) AS proporcion_hora_pico,
       sum(CASE WHEN isodow(uso) > 5 THEN 1 ELSE 0 END) / count(*) AS proporcion_fin_semana
FROM pop p JOIN uses u ON u.op = p.op AND u.llave = p.llave
     AND uso >= p.fc - INTERVAL 28 DAY AND uso < p.fc AND sabido < p.fc
GROUP BY p.unidad_id, p.corte, p.fc, p.op, p.llave, p.etiqueta"""

# ---- gold ------------------------------------------------------------------------------------
CTES["facts"] = f"""
SELECT o.op AS modo, o.id, {_hmac('b.uid')} AS usuario_sk, o.uso, o.tarifa, o.punto,
       p.zona_conformada AS zona, coalesce(nullif(o.servicio, ''), 'SIN_SERVICIO') AS servicio
FROM ops o JOIN bridge b ON b.op = o.op AND b.llave = o.llave
JOIN points p ON p.modo = o.op AND p.codigo_punto = o.punto WHERE o.op <> 'MetroRiel'"""
CTES["ftrips"] = f"""
SELECT m.bronze_record_id AS id, {_hmac('b.uid')} AS usuario_sk, m.*, a.zona_conformada AS zona_o,
       z.zona_conformada AS zona_d
FROM mr m JOIN bridge b ON b.op = 'MetroRiel' AND b.llave = m.tarjeta_mr
JOIN points a ON a.modo = 'MetroRiel' AND a.codigo_punto = m.origen
JOIN points z ON z.modo = 'MetroRiel' AND z.codigo_punto = m.destino"""
CTES["gev"] = """
SELECT modo, id, usuario_sk, uso, tarifa, zona, 'abordaje' AS tipo FROM facts
WHERE zona IN (SELECT nombre_zona FROM universe)
UNION ALL SELECT 'MetroRiel', id, usuario_sk, ingreso, tarifa, zona_o, 'viaje' FROM ftrips
WHERE zona_o IN (SELECT nombre_zona FROM universe)"""
CTES["demand"] = f"""
SELECT CAST(uso AS DATE) AS dia, hour(uso) AS hora, isodow(uso) < 6 AS es_dia_habil, {peak('uso')} AS es_hora_pico,
       modo, zona, tipo AS tipo_evento, count(*) AS n, CAST(sum(tarifa) AS DOUBLE) AS tarifa
FROM gev GROUP BY ALL"""
CTES["coverage"] = """
SELECT u.*, coalesce(t.n, 0) AS eventos_totales, coalesce(t.tm, 0) AS eventos_transmetro,
       coalesce(t.tu, 0) AS eventos_transurbano, coalesce(t.mr, 0) AS eventos_metroriel,
       coalesce(t.am, 0) AS eventos_aerometro
FROM universe u LEFT JOIN (
  SELECT zona, count(*) AS n, count(CASE WHEN modo = 'Transmetro' THEN 1 END) AS tm,
         count(CASE WHEN modo = 'Transurbano' THEN 1 END) AS tu, count(CASE WHEN modo = 'MetroRiel' THEN 1 END) AS mr,
         count(CASE WHEN modo = 'Aerometro' THEN 1 END) AS am
  FROM gev GROUP BY zona) t ON t.zona = u.nombre_zona"""
CTES["transfer"] = """
SELECT *, date_diff('microsecond', uso0, uso) / 60000000.0 AS minutos FROM (
  SELECT *, lag(modo) OVER w AS modo0, lag(zona) OVER w AS zona0, lag(uso) OVER w AS uso0,
         lag(tarifa) OVER w AS tarifa0, lag(id) OVER w AS id0
  FROM gev WINDOW w AS (PARTITION BY usuario_sk ORDER BY uso, modo, id))
WHERE modo0 <> modo AND uso > uso0 AND uso <= uso0 + INTERVAL 90 MINUTE"""


def _needed(text: str) -> list[str]:
    """Named expressions mentioned in the text, dependencies first."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name, inner in CTES.items():
            if name not in order and re.search(rf"\b(FROM|JOIN|,)\s*\(?\s*{name}\b", body):
                visit(inner)
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def sql(text: str) -> str:
    names = _needed(text)
    if not names:
        return text.strip()
    body = text.strip()
    ctes = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in names)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
