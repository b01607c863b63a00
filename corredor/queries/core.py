"""Scalars, joins, aggregates, windows, ranking, sets and change log on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corredor.functions import scalars as fx
from corredor.operators import aggregates, cdc, joins, ranking, sets, windows
from corredor.plans import silver
from corredor.plans.silver import MR, TM, TU
from corredor.queries.bindings import CUTS, HORIZON, KEY, Warehouse
from corredor.queries.oracle import _half_up, _hmac, _key, peak, ts
from corredor.queries.registry import query

c = F.col
DAY = "strftime({0}, '%Y-%m-%d')"

# ---- scalars ---------------------------------------------------------------------------------


@query("P01_to_local", f"SELECT boarding_id, {ts('utc - INTERVAL 6 HOUR', 'fecha_hora')} FROM am_raw")
def p01(w: Warehouse):
    return w.am_boardings_raw.select("boarding_id", fx.to_local(c("timestamp_utc")).alias("fecha_hora"))


@query(
    "P02_parse_date_any",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS fecha FROM orders",
)
def p02(w: Warehouse):
    day = F.substring(c("o_orderdate").cast("string"), 1, 10)
    text = (
        F.when(c("o_orderstatus") == "F", F.regexp_replace(day, r"(\d+)-(\d+)-(\d+)", "$3/$2/$1"))
        .when(c("o_orderstatus") == "O", day)
        .otherwise(F.concat(F.lit("dia "), day))
    )
    return w.table("orders").select("o_orderkey", fx.parse_date_any(text).alias("fecha"))


@query(
    "P03_date_time",
    """SELECT o_orderkey, CASE WHEN o_custkey % 30 < 24
       THEN strftime(o_orderdate, '%Y-%m-%d') || ' ' || lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') || ':15:07' END
       AS fecha_hora FROM orders""",
)
def p03(w: Warehouse):
    clock = F.concat(F.lpad((c("o_custkey") % 30).cast("string"), 2, "0"), F.lit(":15:07"))
    return w.table("orders").select(
        "o_orderkey", fx.date_time(c("o_orderdate").cast("date"), clock).alias("fecha_hora")
    )


@query(
    "P04_normalize_zone",
    """SELECT codigo_punto AS codigo, zona_conformada AS zona FROM points WHERE modo IN ('Transurbano', 'Aerometro')
       UNION ALL SELECT n_name, 'Nation_' || substr(n_name, 8) FROM nation
       UNION ALL SELECT r_name, CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle East'
                 ELSE substr(r_name, 1, 1) || lower(substr(r_name, 2)) END FROM region""",
)
def p04(w: Warehouse):
    texts = [
        w.tu_stops.select(c("cod_parada").alias("codigo"), c("sector").alias("t")),
        w.am_stations.select(c("station_code").alias("codigo"), c("district").alias("t")),
        w.table("nation").select(c("n_name").alias("codigo"), c("n_name").alias("t")),
        w.table("region").select(c("r_name").alias("codigo"), c("r_name").alias("t")),
    ]
    return sets.union_all(texts).select("codigo", fx.normalize_zone(c("t")).alias("zona"))


@query(
    "P05_money",
    """SELECT bronze_record_id, CAST(coalesce(tarifa, '1.00') AS DOUBLE) AS monto, CAST(NULL AS DOUBLE) AS minutos FROM tm_raw
       UNION ALL SELECT bronze_record_id, monto_centavos / 100.0, NULL FROM tu_raw
       UNION ALL SELECT bronze_record_id, CAST(fare_gtq AS DOUBLE), round(CAST(duration_s AS DOUBLE) / 60, 2) FROM mr_raw""",
)
def p05(w: Warehouse):
    none = F.lit(None).cast("decimal(18,2)").alias("minutos")
    return sets.union_all(
        [
            w.tm_validations.select("bronze_record_id", fx.money(c("tarifa"), "1.00").alias("monto"), none),
            w.tu_transactions_raw.select(
                "bronze_record_id", fx.money(c("monto_centavos"), divisor=100).alias("monto"), none
            ),
            w.mr_trips_raw.select(
                "bronze_record_id",
                fx.money(c("fare_gtq")).alias("monto"),
                fx.minutes_from_seconds(c("duration_s")).alias("minutos"),
            ),
        ]
    )


@query("P06_canonical_id", "SELECT DISTINCT op AS operador, llave, uid AS identidad FROM bridge")
def p06(w: Warehouse):
    keys = sets.union_distinct(silver.silver_keys(w.silver))
    return keys.select(
        c("sistema_origen").alias("operador"),
        c("llave_origen").alias("llave"),
        fx.canonical_id(c("sistema_origen"), c("llave_origen")).alias("identidad"),
    )


@query("P07_hmac_sha256", f"SELECT c_custkey, {_hmac('c_name')} AS seudonimo FROM customer")
def p07(w: Warehouse):
    return w.table("customer").select("c_custkey", fx.hmac_sha256(c("c_name"), KEY).alias("seudonimo"))


@query(
    "P08_md5_key",
    "SELECT p_partkey, md5(p_brand || ':' || p_type || ':' || p_partkey) AS sk, md5(p_name || ':' || nullif(p_brand, 'Brand#1')) AS sk_nulo FROM part",
)
def p08(w: Warehouse):
    return w.table("part").select(
        "p_partkey",
        fx.md5_key(c("p_brand"), c("p_type"), c("p_partkey").cast("string")).alias("sk"),
        fx.md5_key(c("p_name"), F.nullif(c("p_brand"), F.lit("Brand#1"))).alias("sk_nulo"),
    )


@query("P09_ts_key", f"SELECT event_id, {_key('t')} AS tiempo_sk, {ts('t', 'vuelta')} FROM ev")
def p09(w: Warehouse):
    key = fx.ts_key(c("t"))
    return w.events.select("event_id", key.alias("tiempo_sk"), fx.ts_from_key(key).alias("vuelta"))


@query(
    "P10_calendar",
    f"""SELECT event_id, {DAY.format('t')} AS fecha, year(t) AS anio, month(t) AS mes, day(t) AS dia,
        isodow(t) AS dia_semana_iso, hour(t) AS hora, minute(t) AS minuto, second(t) AS segundo,
        isodow(t) < 6 AS es_dia_habil, {peak('t')} AS es_hora_pico FROM ev""",
)
def p10(w: Warehouse):
    return fx.calendar(w.events.select("event_id", "t"), "t").drop("t")


@query(
    "P11_not_blank",
    """SELECT 'parada' AS campo, count(*) AS total, count(CASE WHEN trim(cod_parada) <> '' THEN 1 END) AS llenos FROM tu_raw
       UNION ALL SELECT 'texto', count(*), count(CASE WHEN trim(text) <> '' THEN 1 END) FROM documents""",
)
def p11(w: Warehouse):
    texts = {"parada": (w.tu_transactions_raw, "cod_parada"), "texto": (w.table("documents"), "text")}
    return sets.union_all(
        [
            df.agg(
                F.lit(name).alias("campo"),
                F.count(F.lit(1)).alias("total"),
                F.count_if(fx.not_blank(c(col))).alias("llenos"),
            )
            for name, (df, col) in texts.items()
        ]
    )


@query(
    "P12_json_payload",
    "SELECT c_custkey, CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'segmento': nullif(c_mktsegment, 'BUILDING')}) AS VARCHAR) AS payload FROM customer",
)
def p12(w: Warehouse):
    segment = F.nullif(c("c_mktsegment"), F.lit("BUILDING")).alias("segmento")
    return w.table("customer").select(
        "c_custkey", fx.json_payload(c("c_custkey"), c("c_name"), segment).alias("payload")
    )


@query(
    "P13_label",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'cerrado' WHEN 'O' THEN 'abierto' ELSE 'otro' END AS estado FROM orders",
)
def p13(w: Warehouse):
    return w.table("orders").select(
        "o_orderkey", fx.label(c("o_orderstatus"), {"F": "cerrado", "O": "abierto"}, "otro").alias("estado")
    )


@query(
    "P14_month_window",
    """SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT date_trunc('month', max(o_orderdate) - INTERVAL 40 DAY) FROM orders)
       AND o_orderdate < (SELECT date_trunc('month', max(o_orderdate) - INTERVAL 40 DAY) + INTERVAL 1 MONTH FROM orders)""",
)
def p14(w: Warehouse):
    orders = w.table("orders").select("o_orderkey", "o_orderdate")
    month = orders.agg(fx.month_start(F.max("o_orderdate") - F.expr("INTERVAL 40 DAYS")).alias("inicio"))
    return (
        joins.with_scalar(orders, month)
        .filter(fx.month_window(c("o_orderdate"), c("inicio")))
        .select("o_orderkey")
    )


@query(
    "P15_elapsed",
    """SELECT trip_id, date_diff('microsecond', ingreso, salida) / 60000000.0 AS minutos,
       round(date_diff('microsecond', ingreso, TIMESTAMP '2024-02-01') / 86400000000.0, 6) AS dias,
       CAST(floor(date_diff('microsecond', ingreso, TIMESTAMP '2024-02-01') / 86400000000.0) AS BIGINT) AS dias_enteros FROM
       (SELECT *, trip_id AS x FROM mr)""",
)
def p15(w: Warehouse):
    start, end = c("fecha_hora_ingreso"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return w.silver[MR].select(
        c("viaje_id").cast("long").alias("trip_id"),
        F.round(fx.elapsed(start, c("fecha_hora_salida"), "minutes"), 12).alias("minutos"),
        fx.elapsed(start, end, "days").alias("dias"),
        fx.elapsed(start, end, "whole_days").alias("dias_enteros"),
    )


@query(
    "P16_constant_relation",
    "SELECT nombre_zona, tipo_area, puntos_transporte AS puntos FROM universe",
)
def p16(w: Warehouse):
    areas = fx.constant_relation(w.spark, fx.AREAS, "nombre_zona string, tipo_area string")
    per_zone = w.points.groupBy(c("zona_conformada").alias("nombre_zona")).agg(F.count(F.lit(1)).alias("puntos"))
    return joins.universe_left(areas, per_zone, "nombre_zona", ["puntos"])


@query(
    "P17_cutoffs",
    """SELECT corte, strftime(fc, '%Y-%m-%d %H:%M:%S') AS fecha_corte, count(*) AS previos
       FROM cuts, ev WHERE t < fc GROUP BY ALL""",
)
def p17(w: Warehouse):
    cuts = fx.cut_array(fx.cutoffs(CUTS, include_unlabelled=True))
    return (
        joins.range_join(w.events, cuts, lambda k: c("t") < k["fecha_corte"])
        .groupBy("corte", "fecha_corte")
        .agg(F.count(F.lit(1)).alias("previos"))
    )


@query(
    "P18_as_of",
    "SELECT CAST(trip_id AS VARCHAR) AS viaje_id FROM mr WHERE ingreso < TIMESTAMP '2024-01-15' AND salida < TIMESTAMP '2024-01-15'",
)
def p18(w: Warehouse):
    return fx.as_of(w.silver[MR], ["fecha_hora_ingreso", "fecha_hora_salida"], "2024-01-15").select("viaje_id")


@query("P19_differs", "SELECT p_partkey FROM part WHERE nullif(p_size % 10, 0) IS DISTINCT FROM nullif(p_partkey % 10, 0)")
def p19(w: Warehouse):
    zero = F.lit(0)
    a, b = F.nullif(c("p_size") % 10, zero), F.nullif(c("p_partkey") % 10, zero)
    return w.table("part").filter(fx.differs(a, b)).select("p_partkey")


@query(
    "P20_blank_to",
    "SELECT coalesce(nullif(linea, ''), 'SIN_SERVICIO') AS servicio, count(*) AS n FROM tm_raw GROUP BY 1",
)
def p20(w: Warehouse):
    service = fx.blank_to(c("linea"), fx.SERVICE_FALLBACK).alias("servicio")
    return w.tm_validations.groupBy(service).agg(F.count(F.lit(1)).alias("n"))


@query("P21_valid_only", "SELECT bronze_record_id FROM tu UNION ALL SELECT bronze_record_id FROM mr")
def p21(w: Warehouse):
    closed = [c("exit_station").isNotNull(), c("exit_ts").isNotNull()]
    dated = w.tu_transactions_raw.withColumn("x", fx.date_time(fx.parse_date_any(c("fecha")), c("hora")))
    inside = [fx.not_blank(c("cod_parada")), c("x") <= F.lit(HORIZON).cast("timestamp_ntz")]
    return sets.union_all(
        [
            fx.valid_only(dated, inside).select("bronze_record_id"),
            fx.valid_only(w.mr_trips_raw, closed).select("bronze_record_id"),
        ]
    )


@query(
    "P22_prefix_and_pair",
    "SELECT p_brand || ' -> ' || p_type AS par, count(*) AS n FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY 1",
)
def p22(w: Warehouse):
    return (
        w.table("part")
        .filter(fx.has_prefix(c("p_brand"), "Brand#1"))
        .groupBy(fx.pair_label(c("p_brand"), c("p_type")).alias("par"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- joins -----------------------------------------------------------------------------------


@query(
    "J01_lookup",
    """SELECT bronze_record_id, CASE WHEN zona_conformada LIKE 'Zona %' THEN 'Z' || substr(zona_conformada, 6)
              WHEN zona_conformada <> 'Desconocida' THEN upper(zona_conformada) END AS sector
       FROM tu_raw LEFT JOIN points ON modo = 'Transurbano' AND codigo_punto = cod_parada""",
)
def j01(w: Warehouse):
    return joins.lookup(w.tu_transactions_raw, w.tu_stops, "cod_parada", {"sector": "sector"}).select(
        "bronze_record_id", "sector"
    )


@query(
    "J02_star_join",
    """SELECT modo, zona, hour(uso) AS hora, count(*) AS n FROM gev WHERE tipo = 'abordaje' GROUP BY ALL""",
)
def j02(w: Warehouse):
    dims = {
        "tiempo_sk": dim_time(w).select("tiempo_sk", "hora"),
        "zona_sk": w.zones.select("zona_sk", c("nombre_zona").alias("zona")),
        "modo_sk": w.modes.select("modo_sk", c("nombre_modo").alias("modo")),
    }
    return joins.star_join(w.boardings, dims).groupBy("modo", "zona", "hora").agg(F.count(F.lit(1)).alias("n"))


def dim_time(w: Warehouse):
    from corredor.plans.gold import dim_time as build

    return build(w.silver)


@query(
    "J03_join_on",
    """SELECT a.n_name AS origen, b.n_name AS destino, count(*) AS lineas, round(sum(l_quantity), 2) AS cantidad
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey
       JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY ALL""",
)
def j03(w: Warehouse):
    lines = w.table("lineitem").select("l_orderkey", "l_suppkey", c("l_quantity").cast("decimal(18,2)").alias("q"))
    out = joins.join_on(lines, w.table("orders"), {"l_orderkey": "o_orderkey"}, {"o_custkey": "cust"})
    out = joins.join_on(out, w.table("customer"), {"cust": "c_custkey"}, {"c_nationkey": "destino_k"})
    out = joins.join_on(out, w.table("supplier"), {"l_suppkey": "s_suppkey"}, {"s_nationkey": "origen_k"})
    # nation plays two roles
    by_key = out.groupBy("origen_k", "destino_k").agg(
        F.count(F.lit(1)).alias("lineas"), F.sum("q").alias("cantidad")
    )
    named = joins.join_on(by_key, w.table("nation"), {"origen_k": "n_nationkey"}, {"n_name": "origen"})
    named = joins.join_on(named, w.table("nation"), {"destino_k": "n_nationkey"}, {"n_name": "destino"})
    return named.select("origen", "destino", "lineas", "cantidad")


@query(
    "J04_universe_left",
    """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, count(s_suppkey) AS proveedores FROM nation
       LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""",
)
def j04(w: Warehouse):
    per_nation = w.table("supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("proveedores")
    )
    universe = w.table("nation").select("n_nationkey", "n_name")
    return joins.universe_left(universe, per_nation, "n_nationkey", ["proveedores"])


@query(
    "J05_with_scalar",
    """SELECT o_orderkey, strftime((SELECT max(o_orderdate) FROM orders), '%Y-%m-%d %H:%M:%S') AS ultimo,
       CAST(date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS BIGINT) AS dias FROM orders""",
)
def j05(w: Warehouse):
    orders = w.table("orders").select("o_orderkey", "o_orderdate")
    return joins.with_scalar(orders, orders.agg(F.max("o_orderdate").alias("ultimo"))).select(
        "o_orderkey", "ultimo", F.datediff("ultimo", "o_orderdate").alias("dias")
    )


@query("J06_exclude", "SELECT bronze_record_id, tarjeta_id AS tarjeta FROM tm")
def j06(w: Warehouse):
    reads = w.tm_validations.withColumn("fuente", F.lit(TM))
    keys = {"fuente": "fuente", "bronze_record_id": "id_registro_crudo"}
    return joins.exclude(reads, w.quarantine, keys).select("bronze_record_id", "tarjeta")


@query(
    "J07_exclude_where",
    """SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
       AND l_returnflag = 'R' AND l_shipdate < o_orderdate)""",
)
def j07(w: Warehouse):
    returned = w.table("lineitem").filter(c("l_returnflag") == "R").select("l_orderkey", "l_shipdate")
    return joins.exclude_where(
        w.table("orders"), returned, {"o_orderkey": "l_orderkey"}, lambda o, r: r["l_shipdate"] < o["o_orderdate"]
    ).select("o_orderkey")


@query(
    "J08_range_join",
    """SELECT corte, op AS operador, count(*) AS usos FROM cuts, uses
       WHERE uso >= fc - INTERVAL 7 DAY AND uso < fc AND sabido < fc GROUP BY ALL""",
)
def j08(w: Warehouse):
    def inside(k):
        cut = k["fecha_corte"]
        start = cut - F.expr("INTERVAL 7 DAYS")
        return (c("fecha_uso") >= start) & (c("fecha_uso") < cut) & (c("disponible_desde") < cut)

    spread = joins.range_join(w.uses, fx.cut_array(w.cuts), inside)
    return spread.groupBy("corte", "operador").agg(F.count(F.lit(1)).alias("usos"))


@query(
    "J09_pit_join",
    """SELECT p.corte, p.unidad_id, count(*) AS usos FROM pop p JOIN uses u ON u.op = p.op AND u.llave = p.llave
       AND uso >= fc - INTERVAL 5 DAY AND uso < fc AND sabido < fc GROUP BY ALL""",
)
def j09(w: Warehouse):
    pop = w.population.select("corte", "fecha_corte", "unidad_id", "operador", "llave_operacional")
    found = joins.pit_join(pop, w.uses, ["operador", "llave_operacional"], 5)
    return found.groupBy("corte", "unidad_id").agg(F.count(F.lit(1)).alias("usos"))


@query(
    "J10_cross_operator_links",
    """SELECT uid AS identidad, op AS operador, llave, array_to_string(list_sort(otros), ',') AS otros FROM (
       SELECT a.uid, a.op, a.llave, list(DISTINCT b.op) AS otros FROM bridge a JOIN bridge b
       ON a.uid = b.uid AND a.op <> b.op GROUP BY ALL)""",
)
def j10(w: Warehouse):
    linked = joins.cross_operator_links(w.bridge, "usuario_canonico_id", "sistema_origen", "llave_origen")
    return linked.select(
        c("usuario_canonico_id").alias("identidad"),
        c("sistema_origen").alias("operador"),
        c("llave_origen").alias("llave"),
        F.array_join("otros_operadores", ",").alias("otros"),
    )


@query(
    "J11_reconcile",
    """SELECT coalesce(a.k, b.k) AS o_custkey, a.n AS n_a, b.n AS n_b FROM
       (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL JOIN
       (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.k = b.k
       WHERE a.n IS DISTINCT FROM b.n""",
)
def j11(w: Warehouse):
    def by_status(status):
        rows = w.table("orders").filter(c("o_orderstatus") == status)
        return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    return joins.reconcile(by_status("O"), by_status("F"), ["o_custkey"], ["n"])


@query(
    "J12_join_using",
    """SELECT CAST(nk AS BIGINT) AS n_nationkey, clientes, proveedores FROM
       (SELECT c_nationkey AS nk, count(*) AS clientes FROM customer GROUP BY 1) JOIN
       (SELECT s_nationkey AS nk, count(*) AS proveedores FROM supplier GROUP BY 1) USING (nk)""",
)
def j12(w: Warehouse):
    def per(table, key, name):
        return w.table(table).groupBy(c(key).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(name))

    return joins.join_using(
        per("customer", "c_nationkey", "clientes"), per("supplier", "s_nationkey", "proveedores"), ["n_nationkey"]
    )


@query(
    "J13_one_to_one",
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0) AS filas_a, coalesce(b.n, 0) AS filas_b FROM
       (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) a FULL JOIN
       (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) b ON a.doc_id = b.doc_id
       WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1""",
)
def j13(w: Warehouse):
    return joins.one_to_one(w.table("documents"), w.table("labels"), "doc_id")


@query(
    "J14_count_flagged",
    """SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS total, count(CASE WHEN c_custkey IN
       (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN 1 END) AS marcados FROM customer GROUP BY 1""",
)
def j14(w: Warehouse):
    big = w.table("orders").filter(c("o_totalprice") > 450000).select(c("o_custkey").alias("c_custkey")).distinct()
    return joins.count_flagged(w.table("customer"), big, ["c_custkey"], ["c_nationkey"])


# ---- aggregates ------------------------------------------------------------------------------


@query(
    "A01_count_having",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3",
)
def a01(w: Warehouse):
    return aggregates.count_having(w.table("lineitem"), ["l_orderkey", "l_linenumber"], 3)


@query(
    "A02_distinct_counts",
    "SELECT event_type, count(DISTINCT user_id) AS usuarios, count(DISTINCT CAST(ts AS DATE)) AS dias FROM events GROUP BY 1",
)
def a02(w: Warehouse):
    return aggregates.distinct_counts(
        w.table("events"), ["event_type"], {"usuarios": c("user_id"), "dias": c("ts").cast("date")}
    )


@query(
    "A03_conditional_counts",
    """SELECT l_returnflag, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS rebajadas,
       count(CASE WHEN l_quantity >= 25 THEN 1 END) AS grandes FROM lineitem GROUP BY 1""",
)
def a03(w: Warehouse):
    return aggregates.conditional_counts(
        w.table("lineitem"), ["l_returnflag"], {"rebajadas": c("l_discount") > 0.05, "grandes": c("l_quantity") >= 25}
    )


@query(
    "A04_bounds",
    f"""SELECT o_orderpriority, {ts('min(o_orderdate)', 'min_o_orderdate')}, {ts('max(o_orderdate)', 'max_o_orderdate')},
        min(o_orderstatus) AS min_o_orderstatus, max(o_orderstatus) AS max_o_orderstatus FROM orders GROUP BY 1""",
)
def a04(w: Warehouse):
    return aggregates.bounds(w.table("orders"), ["o_orderpriority"], ["o_orderdate", "o_orderstatus"])


@query(
    "A05_money_sums",
    f"""SELECT l_suppkey, CAST(sum(x) AS DOUBLE) AS total, {_half_up('sum(x)', 100, 'count(x)')} AS promedio FROM
       (SELECT l_suppkey, CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(18,2)) AS x FROM lineitem) GROUP BY 1""",
)
def a05(w: Warehouse):
    money = w.table("lineitem").select("l_suppkey", c("l_extendedprice").cast("decimal(18,2)").alias("x"))
    return aggregates.money_sums(money, ["l_suppkey"], "x")


@query(
    "A06_proportion",
    "SELECT l_shipmode_flag AS l_linestatus, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6) AS proporcion FROM (SELECT l_linestatus AS l_shipmode_flag, l_returnflag FROM lineitem) GROUP BY 1",
)
def a06(w: Warehouse):
    return aggregates.proportion(w.table("lineitem"), ["l_linestatus"], c("l_returnflag") == "R")


@query(
    "A07_any_true",
    "SELECT o_custkey, bool_or(o_totalprice > 400000) AS alguno FROM orders GROUP BY 1",
)
def a07(w: Warehouse):
    return w.table("orders").groupBy("o_custkey").agg(aggregates.any_true(c("o_totalprice") > 400000).alias("alguno"))


@query(
    "A08_global_max",
    f"""SELECT {ts('max(x)', 'instante')} FROM (SELECT max(o_orderdate) AS x FROM orders UNION ALL SELECT max(l_shipdate) FROM lineitem
        UNION ALL SELECT max(ts) FROM events)""",
)
def a08(w: Warehouse):
    return aggregates.global_max(
        [(w.table("orders"), "o_orderdate"), (w.table("lineitem"), "l_shipdate"), (w.table("events"), "ts")]
    )


@query(
    "A09_mode_of",
    """SELECT user_id, event_type AS moda FROM (SELECT user_id, event_type,
       row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""",
)
def a09(w: Warehouse):
    return aggregates.mode_of(w.table("events"), ["user_id"], "event_type")


@query(
    "A10_conditional_sums",
    """SELECT l_returnflag, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS rebajadas,
       count(CASE WHEN l_quantity >= 25 THEN 1 END) AS grandes FROM lineitem GROUP BY 1""",
)
def a10(w: Warehouse):
    return aggregates.conditional_sums(
        w.table("lineitem"), ["l_returnflag"], {"rebajadas": c("l_discount") > 0.05, "grandes": c("l_quantity") >= 25}
    )


@query(
    "A11_set_per_key",
    """SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tipos,
       len(list(DISTINCT event_type)) - CAST(bool_or(event_type = 'view') AS BIGINT) AS sin_view FROM events GROUP BY 1""",
)
def a11(w: Warehouse):
    found = aggregates.set_per_key(w.table("events"), ["user_id"], "event_type", "tipos")
    return found.select(
        "user_id",
        F.array_join("tipos", ",").alias("tipos"),
        F.size(F.array_remove("tipos", F.lit("view"))).alias("sin_view"),
    )


_HASH = "CAST(('0x' || substr(md5({0}), 1, 15)) AS UBIGINT)"


@query(
    "A12_fingerprint",
    f"""SELECT count(*) AS filas, CAST(sum({_HASH.format("concat_ws(chr(31), event_id, event_type, k, user_id, v)")}) AS VARCHAR) AS huella
        FROM ev""",
)
def a12(w: Warehouse):
    return aggregates.fingerprint(w.events, exclude=["t"], method="md5")


@query(
    "A13_fingerprint_by",
    f"""SELECT event_type, count(*) AS filas,
        CAST(sum({_HASH.format("concat_ws(chr(31), event_id, k, user_id, v)")}) AS VARCHAR) AS huella FROM ev GROUP BY 1""",
)
def a13(w: Warehouse):
    return aggregates.fingerprint_by(w.events, ["event_type"], exclude=["t"], method="md5")


@query(
    "A14_null_profile",
    """SELECT 'cod_parada' AS columna, count(*) - count(cod_parada) AS nulos FROM tu_raw
       UNION ALL SELECT 'ruta', count(*) - count(ruta) FROM tu_raw
       UNION ALL SELECT 'num_tarjeta', count(*) - count(num_tarjeta) FROM tu_raw""",
)
def a14(w: Warehouse):
    return aggregates.null_profile(w.tu_transactions_raw.select("cod_parada", "ruta", "num_tarjeta"))


@query(
    "A15_profile",
    """SELECT lang, source, count(*) AS filas, min(n_chars) AS minimo, round(avg(n_chars), 6) AS media, max(n_chars) AS maximo
       FROM documents GROUP BY ALL""",
)
def a15(w: Warehouse):
    return aggregates.profile(w.table("documents"), ["lang", "source"], "n_chars")


@query(
    "A16_medians",
    """SELECT event_type, median(value) AS mediana_value, median(CAST(user_id AS DOUBLE)) AS mediana_user_id
       FROM events GROUP BY 1""",
)
def a16(w: Warehouse):
    return aggregates.medians(w.table("events"), ["event_type"], ["value", "user_id"])


@query("A17_distinct_keys", "SELECT DISTINCT p_brand, p_type FROM part")
def a17(w: Warehouse):
    return aggregates.distinct_keys(w.table("part"), ["p_brand", "p_type"])


@query(
    "A18_daily_coverage",
    """SELECT op AS operador, count(DISTINCT CASE WHEN uso < TIMESTAMP '2024-01-15' THEN CAST(uso AS DATE) END) AS dias_previos,
       count(DISTINCT CASE WHEN uso >= TIMESTAMP '2024-01-15' THEN CAST(uso AS DATE) END) AS dias_futuros FROM uses GROUP BY 1""",
)
def a18(w: Warehouse):
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    conds = {"dias_previos": c("fecha_uso") < cut, "dias_futuros": c("fecha_uso") >= cut}
    return aggregates.daily_coverage(w.uses, ["operador"], "fecha_uso", conds)


# ---- windows ---------------------------------------------------------------------------------

_LINE_REST = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(
    "W01_keep_first",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {ts('l_shipdate')}, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE_REST)}) AS r FROM lineitem)
        WHERE r = 1""",
)
def w01(w: Warehouse):
    keys = ["l_orderkey", "l_linenumber"]
    return windows.keep_first(w.table("lineitem").select(*keys, *_LINE_REST), keys, _LINE_REST)


@query("W02_later_duplicates", "SELECT bronze_record_id, tarjeta, estacion_id, fecha_hora FROM tm_ranked WHERE nth > 1")
def w02(w: Warehouse):
    later = windows.later_duplicates(
        w.tm_validations, silver.TURNSTILE_KEY, silver.ARRIVAL, "bronze_record_id"
    )
    return later.select("bronze_record_id", *silver.TURNSTILE_KEY)


@query(
    "W03_number_rows",
    "SELECT o_orderkey, 'N-' || row_number() OVER (ORDER BY o_orderdate, o_custkey, o_orderkey) AS numero FROM orders",
)
def w03(w: Warehouse):
    rows = w.table("orders").select("o_orderdate", "o_custkey", "o_orderkey")
    return windows.number_rows(rows, ["o_orderdate", "o_custkey", "o_orderkey"], prefix="N-").select(
        "o_orderkey", "numero"
    )


def _day_slot():
    return c("t").cast("date")


@query(
    "W04_previous_event",
    f"""SELECT event_id, p_tipo, {ts('p_t')}, p_v FROM (SELECT event_id, lag(event_type) OVER w AS p_tipo, lag(t) OVER w AS p_t,
        CAST(lag(v) OVER w AS DOUBLE) AS p_v FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))""",
)
def w04(w: Warehouse):
    seq = windows.previous_event(w.events, ["user_id"], ["t", "event_id"], _day_slot(), ["event_type", "t", "v"], 65)
    return seq.select(
        "event_id", c("prev.event_type").alias("p_tipo"), c("prev.t").alias("p_t"), c("prev.v").alias("p_v")
    )


@query(
    "W05_next_value",
    f"""SELECT event_id, {ts('n_t')}, n_id FROM (SELECT event_id, lead(t) OVER w AS n_t, lead(event_id) OVER w AS n_id FROM ev
        WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))""",
)
def w05(w: Warehouse):
    seq = windows.next_value(w.events, ["user_id"], ["t", "event_id"], _day_slot(), ["t", "event_id"], 65)
    return seq.select("event_id", c("next.t").alias("n_t"), c("next.event_id").alias("n_id"))


@query(
    "W06_running_last",
    """SELECT event_id, CAST(last_value(CASE WHEN event_type = 'purchase' THEN v END IGNORE NULLS) OVER w AS DOUBLE) AS ultima,
       CAST(max(CASE WHEN event_type = 'purchase' THEN v END) OVER w AS DOUBLE) AS mayor FROM ev
       WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def w06(w: Warehouse):
    bought = F.when(c("event_type") == "purchase", c("v"))
    out = windows.ordered_context(
        w.events, ["user_id"], ["t", "event_id"], _day_slot(),
        running_last={"ultima": bought}, running_max={"mayor": bought}, hot_rows=65,
    )
    return out.select("event_id", "ultima", "mayor")


@query(
    "W07_rank_desc",
    """SELECT o_custkey, n, rank() OVER (ORDER BY n DESC) AS ranking FROM
       (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""",
)
def w07(w: Warehouse):
    return windows.rank_desc(w.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "n")


@query(
    "W08_share_of_total",
    """SELECT o_orderstatus, o_orderpriority, n, round(100.0 * n / sum(n) OVER (), 2) AS pct_total,
       round(100.0 * n / sum(n) OVER (PARTITION BY o_orderstatus), 2) AS pct_estado FROM
       (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)""",
)
def w08(w: Warehouse):
    groups = w.table("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    overall = windows.share_of_total(groups, "n", name="pct_total")
    return windows.share_of_total(overall, "n", ["o_orderstatus"], "pct_estado")


@query(
    "W09_conditional_total",
    """SELECT o_orderpriority, n, CAST(sum(n) OVER () AS BIGINT) AS total,
       CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN n ELSE 0 END) OVER () AS BIGINT) AS urgentes FROM
       (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""",
)
def w09(w: Warehouse):
    groups = w.table("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    urgent = F.when(c("o_orderpriority").startswith("1"), c("n")).otherwise(0)
    return windows.conditional_total(groups, {"total": c("n"), "urgentes": urgent})


@query(
    "W10_cumulative_by_score",
    """SELECT CAST(v AS DOUBLE) AS v, CAST(sum(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)) OVER w AS BIGINT) AS tp,
       CAST(sum(count(*)) OVER w AS BIGINT) AS contactos FROM ev GROUP BY v
       WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)""",
)
def w10(w: Warehouse):
    marked = w.events.select("v", (c("event_type") == "purchase").cast("int").alias("pos"), F.lit(1).alias("uno"))
    return windows.cumulative_by_score(marked, "v", {"pos": "tp", "uno": "contactos"})


@query(
    "W11_named_window",
    """SELECT conv_id, turn, lag(role) OVER w AS rol_anterior, lead(role) OVER w AS rol_siguiente FROM conversations
       WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def w11(w: Warehouse):
    # both neighbours share one window specification and one sort
    turns = w.table("conversations").select("conv_id", "turn", "role")
    both = windows.ordered_context(
        turns, ["conv_id"], ["turn"], F.floor(c("turn") / 2), previous=["role"], following=["role"], hot_rows=3
    )
    return both.select(
        "conv_id", "turn", c("prev.role").alias("rol_anterior"), c("next.role").alias("rol_siguiente")
    )


# ---- ranking ---------------------------------------------------------------------------------


@query(
    "L01_first_per_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
       (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def l01(w: Warehouse):
    rows = w.table("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.first_per_key(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("L02_sample_one", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 1")
def l02(w: Warehouse):
    return ranking.sample_one(w.table("orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@query("L03_top_values", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def l03(w: Warehouse):
    return ranking.top_values(w.table("part"), "p_type")


@query(
    "L04_arg_max",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice FROM lineitem ORDER BY l_quantity DESC, l_extendedprice, l_orderkey DESC, 2 DESC LIMIT 1",
)
def l04(w: Warehouse):
    rows = w.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return ranking.arg_max(rows, [c("l_quantity"), -c("l_extendedprice"), c("l_orderkey"), c("l_linenumber")])


@query("L05_ordered_output", "SELECT s_suppkey, s_name FROM supplier")
def l05(w: Warehouse):
    return ranking.ordered_output(w.table("supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@query("L06_head_sample", f"SELECT event_id, {ts('t')} FROM ev ORDER BY t, event_id LIMIT 100")
def l06(w: Warehouse):
    return ranking.head_sample(w.events.select("event_id", "t"), ["t", "event_id"], 100)


# ---- sets ------------------------------------------------------------------------------------


@query(
    "U01_union_all",
    """SELECT op AS operador, id AS evento_id, strftime(uso, '%Y-%m-%d %H:%M:%S') AS fecha_uso,
       CAST(tarifa AS DOUBLE) AS tarifa_quetzales, punto AS punto_origen FROM ops""",
)
def u01(w: Warehouse):
    schema = [("operador", "string"), ("evento_id", "string"), ("fecha_uso", "timestamp_ntz"),
              ("tarifa_quetzales", "decimal(18,4)"), ("punto_origen", "string")]
    return sets.union_all([silver.operations(w.silver)], schema)


@query(
    "U02_union_distinct",
    "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation",
)
def u02(w: Warehouse):
    parts = {"customer": "c_nationkey", "supplier": "s_nationkey", "nation": "n_nationkey"}
    return sets.union_distinct([w.table(t).select(c(k).alias("k")) for t, k in parts.items()])


@query(
    "U03_symmetric_diff",
    """SELECT 'izquierda' AS lado, k, s FROM (SELECT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'A'
         EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
       UNION ALL SELECT 'derecha', k, s FROM (SELECT l_partkey AS k, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R'
         EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""",
)
def u03(w: Warehouse):
    def flag(value):
        rows = w.table("lineitem").filter(c("l_returnflag") == value)
        return rows.select(c("l_partkey").alias("k"), c("l_suppkey").alias("s"))

    return sets.symmetric_diff(flag("A"), flag("R"))


# ---- change log ------------------------------------------------------------------------------


@query("C01_classify_key", "SELECT seq, tarjeta, tipo_llave FROM cdc")
def c01(w: Warehouse):
    return w.cdc_raw.select(c("seq").cast("long"), "tarjeta", cdc.classify_key(c("tarjeta")).alias("tipo_llave"))


@query(
    "C02_current_state",
    f"SELECT tarjeta, perfil, zona_residencia, estado, ultima_seq, {ts('ultimo_commit_ts')}, ultima_operacion FROM state",
)
def c02(w: Warehouse):
    return cdc.current_state(w.cdc)


@query(
    "C03_check_ops",
    """SELECT event_id AS seq_num, 'OPERACION_NO_SOPORTADA' AS problema FROM events WHERE event_type NOT IN ('signup', 'view', 'error')
       UNION ALL SELECT event_id, 'SEQ_NO_NUMERICA' FROM events WHERE event_type = 'view'""",
)
def c03(w: Warehouse):
    op = fx.label(c("event_type"), {"signup": "INSERT", "view": "UPDATE", "error": "DELETE"}, "MERGE")
    number = c("event_id").cast("string")
    seq = F.when(c("event_type") == "view", F.concat(F.lit("n"), number)).otherwise(number)
    log = w.events.select(c("event_id").alias("seq_num"), seq.alias("seq"), op.alias("op"))
    return cdc.check_ops(log).select("seq_num", "problema")


@query(
    "C04_scd2",
    f"""SELECT tarjeta || ':' || seq AS version_id, tarjeta AS tarjeta_id, seq AS valid_from_seq, seq2 AS valid_to_seq,
        {ts('commit_ts', 'valid_from')}, {ts('ts2', 'valid_to')}, seq2 IS NULL AS vigente, op AS operacion,
        CASE op WHEN 'DELETE' THEN 'INACTIVA' ELSE 'ACTIVA' END AS estado_tarjeta, perfil AS perfil_usuario,
        zona AS zona_residencia FROM scd""",
)
def c04(w: Warehouse):
    return cdc.scd2(w.cdc, slot_width=500, hot_rows=50)


@query("C05_current_version", "SELECT tarjeta || ':' || seq AS version_id, op AS operacion FROM scd WHERE seq2 IS NULL")
def c05(w: Warehouse):
    return w.history.filter("vigente").select("version_id", "operacion")


@query(
    "C06_exclude_deleted",
    """SELECT corte, op AS operador, llave FROM (SELECT DISTINCT corte, fc, op, llave FROM cuts, uses WHERE uso < fc) p
       WHERE NOT EXISTS (SELECT 1 FROM scd d WHERE p.op = 'Transmetro' AND d.tarjeta = p.llave AND d.op = 'DELETE'
                         AND d.commit_ts < p.fc)""",
)
def c06(w: Warehouse):
    seen = joins.range_join(w.uses, fx.cut_array(w.cuts), lambda k: c("fecha_uso") < k["fecha_corte"])
    units = seen.select("corte", "fecha_corte", "operador", "llave_operacional").distinct()
    return cdc.exclude_deleted(units, w.history).select("corte", "operador", c("llave_operacional").alias("llave"))


@query(
    "C07_cdc_metrics",
    """SELECT 'op:' || op AS metrica, count(*) AS valor FROM cdc GROUP BY 1
       UNION ALL SELECT 'tipo:' || tipo_llave, count(*) FROM cdc GROUP BY 1
       UNION ALL SELECT 'tarjetas', count(*) FROM state
       UNION ALL SELECT 'activas', count(*) FROM state WHERE estado = 'ACTIVA'
       UNION ALL SELECT 'inactivas', count(*) FROM state WHERE estado = 'INACTIVA'
       UNION ALL SELECT 'delete_sin_cuerpo', count(*) FROM state
         WHERE estado = 'INACTIVA' AND perfil IS NULL AND zona_residencia IS NULL""",
)
def c07(w: Warehouse):
    return cdc.cdc_metrics(w.cdc)
