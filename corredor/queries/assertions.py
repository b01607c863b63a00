"""Assertions bound to relations that break them, so that the violating rows are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from corredor.operators import cdc, quality
from corredor.operators.sets import union_all
from corredor.plans import gold, pit, silver
from corredor.plans.silver import AM, MR, TM, TU
from corredor.queries.bindings import LABEL_DAYS, Warehouse
from corredor.queries.models import _features_sql
from corredor.queries.registry import query

c = F.col
HALF = "2024-01-15"


def _early(w: Warehouse):
    """Change log up to the middle of the month: an outdated copy."""
    return w.cdc.filter(c("commit_ts") < F.lit(HALF).cast("timestamp_ntz"))


@query("Q01_not_null", "SELECT bronze_record_id FROM tu_raw WHERE cod_parada IS NULL")
def q01(w: Warehouse):
    return quality.not_null(w.tu_transactions_raw, "cod_parada").select("bronze_record_id")


@query("Q02_unique", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS filas FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q02(w: Warehouse):
    return quality.unique(w.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q03_foreign_key", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q03(w: Warehouse):
    return quality.foreign_key(w.table("documents").select("doc_id"), "doc_id", w.table("labels"), "doc_id")


@query(
    "Q04_accepted",
    "SELECT o_orderpriority, count(*) AS filas FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1",
)
def q04(w: Warehouse):
    return quality.accepted(w.table("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(
    "Q05_counts_match",
    """SELECT * FROM (SELECT 'Transmetro' AS modo, (SELECT count(*) FROM tm_raw) AS esperado, (SELECT count(*) FROM tm) AS obtenido
       UNION ALL SELECT 'Transurbano', (SELECT count(*) FROM tu_raw), (SELECT count(*) FROM tu)
       UNION ALL SELECT 'MetroRiel', (SELECT count(*) FROM mr_raw), (SELECT count(*) FROM mr)
       UNION ALL SELECT 'Aerometro', (SELECT count(*) FROM am_raw), (SELECT count(*) FROM am)) WHERE esperado <> obtenido""",
)
def q05(w: Warehouse):
    staged = {TM: w.tm_validations, TU: w.tu_transactions_raw, MR: w.mr_trips_raw, AM: w.am_boardings_raw}

    def modes(relations):
        from corredor.operators.sets import union_all

        return union_all([df.select(F.lit(m).alias("modo")) for m, df in relations.items()])

    return quality.counts_match(modes(staged), modes(w.silver), ["modo"])


# Columns that may not leave the conformed layer.
RAW_IDENTIFIERS = [
    "tarjeta", "tarjeta_id", "tarjeta_mr", "id_tarjeta", "llave_origen", "user_hash", "usuario_canonico_id", "num_tarjeta", "card",
]


@query(
    "Q06_forbidden_columns",
    """SELECT relacion, columna, filas FROM (VALUES ('bridge', 'usuario_canonico_id'), ('bridge', 'llave_origen')) x(relacion, columna),
       (SELECT count(*) AS filas FROM bridge)""",
)
def q06(w: Warehouse):
    """Exposed identifiers with the rows that expose them; the published relations have none."""
    relations = {"fact_abordajes": w.boardings, "fact_viajes": w.trips, "dim_usuario": w.users, "bridge": w.bridge}
    found = quality.forbidden_columns(relations, RAW_IDENTIFIERS)
    rows = [df.agg(F.lit(name).alias("relacion"), F.count(F.lit(1)).alias("filas")) for name, df in relations.items()]
    return found.join(union_all(rows), "relacion").select("relacion", "columna", "filas")


@query(
    "Q07_grain",
    """SELECT 'clave_repetida' AS problema, strftime(dia, '%Y-%m-%d') || '|' || hora || '|' || modo AS detalle FROM demand
       GROUP BY dia, hora, modo HAVING count(*) > 1
       UNION ALL SELECT 'filas_distintas', CAST(count(*) AS VARCHAR) FROM demand HAVING count(*) <> 5""",
)
def q07(w: Warehouse):
    return quality.grain(w.demand, ["fecha", "hora", "modo"], 5)


@query(
    "Q08_totals_match",
    """SELECT a.n AS eventos_a, d.n AS eventos_b, CAST(a.t AS DOUBLE) AS tarifa_a, d.t AS tarifa_b FROM
       (SELECT count(*) AS n, sum(tarifa) AS t FROM ops) a,
       (SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(tarifa), 4) AS t FROM demand) d WHERE a.n <> d.n""",
)
def q08(w: Warehouse):
    one = F.lit(1)
    measures = {
        "eventos": (one, c("cantidad_eventos")),
        "tarifa": (c("tarifa_quetzales"), c("tarifa_total_gtq")),
    }
    return quality.totals_match(silver.operations(w.silver), w.demand, measures)


@query(
    "Q09_parts_match_catalog",
    """SELECT modo, z AS en_zonas, n AS en_catalogo FROM
       (SELECT modo, count(*) AS n, count(CASE WHEN zona_conformada <> 'Desconocida' THEN 1 END) AS z FROM points GROUP BY modo) WHERE z <> n""",
)
def q09(w: Warehouse):
    parts = {f"puntos_{s}": m for m, s in silver.MODE_SUFFIX.items()}
    return quality.parts_match_catalog(w.zones, parts, w.points, "modo")


@query("Q09_parts_sum", "SELECT nombre_zona FROM universe WHERE puntos_transmetro + puntos_metroriel <> puntos_transporte")
def q09b(w: Warehouse):
    return quality.parts_sum(w.zones, ["puntos_transmetro", "puntos_metroriel"], "puntos_transporte").select("nombre_zona")


@query(
    "Q10_coverage_consistent",
    "SELECT nombre_zona, tiene_servicio, CAST(0 AS BIGINT) AS eventos_totales FROM coverage WHERE eventos_transmetro = 0 AND tiene_servicio",
)
def q10(w: Warehouse):
    # demand of the turnstile operator alone, against the supply of all operators
    partial = gold.coverage(w.demand.filter(c("modo") == TM), w.zones)
    return quality.coverage_consistent(partial)


@query(
    "Q11_rank_valid",
    """SELECT o_custkey, n, rn, r AS ranking_esperado FROM (SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS rn,
       rank() OVER (ORDER BY n DESC) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) WHERE rn <> r""",
)
def q11(w: Warehouse):
    from corredor.operators.windows import number_rows

    per = w.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return quality.rank_valid(number_rows(per, [F.desc("n"), "o_custkey"], "rn"), "n", "rn")


@query(
    "Q12_transfer_rules",
    "SELECT md5(usuario_sk || ':' || id0 || ':' || id) AS transbordo_sk FROM transfer WHERE uso > uso0 + INTERVAL 60 MINUTE",
)
def q12(w: Warehouse):
    return quality.transfer_rules(w.transfers, 60)


@query(
    "Q13_transfer_sequence",
    """SELECT usuario_sk, id0 AS bronze_record_id_origen, id AS bronze_record_id_destino, 'izquierda' AS lado FROM transfer
       WHERE uso > uso0 + INTERVAL 45 MINUTE""",
)
def q13(w: Warehouse):
    return quality.transfer_sequence(gold.transfers(w.user_events, 45), w.user_events)


@query(
    "Q14_same_rows",
    """SELECT modo, zona, n, 'izquierda' AS lado FROM (SELECT modo, zona, CAST(sum(n) AS BIGINT) AS n FROM demand GROUP BY 1, 2
         EXCEPT ALL SELECT modo, zona, CAST(sum(n) AS BIGINT) FROM demand WHERE es_hora_pico GROUP BY 1, 2)
       UNION ALL SELECT modo, zona, n, 'derecha' FROM (SELECT modo, zona, CAST(sum(n) AS BIGINT) AS n FROM demand WHERE es_hora_pico GROUP BY 1, 2
         EXCEPT ALL SELECT modo, zona, CAST(sum(n) AS BIGINT) FROM demand GROUP BY 1, 2)""",
)
def q14(w: Warehouse):
    def by_zone(df):
        return df.groupBy("modo", "zona").agg(F.sum("cantidad_eventos").alias("n"))

    return quality.same_rows(by_zone(w.demand), by_zone(w.demand.filter("es_hora_pico")))


@query(
    "Q15_history_matches_state",
    f"""SELECT coalesce(v.tarjeta, a.tarjeta) AS tarjeta FROM (SELECT tarjeta, max(seq) AS s FROM scd GROUP BY 1) v FULL JOIN
        (SELECT tarjeta, max(seq) AS s FROM scd WHERE commit_ts < TIMESTAMP '{HALF}' GROUP BY 1) a ON a.tarjeta = v.tarjeta
        WHERE v.s IS DISTINCT FROM a.s""",
)
def q15(w: Warehouse):
    return quality.history_matches_state(w.history, cdc.current_state(_early(w)))


@query(
    "Q16_history_intervals",
    f"SELECT tarjeta AS tarjeta_id, seq AS valid_from_seq, 'sin_pareja' AS problema FROM scd WHERE commit_ts >= TIMESTAMP '{HALF}'",
)
def q16(w: Warehouse):
    return quality.history_intervals(silver.card_history(_early(w), slot_width=1_000, hot_rows=50), w.cdc)


_CUT = "TIMESTAMP '2024-01-20'"


@query("Q17_user_feature_rules", _features_sql(_CUT, "SELECT usuario_canonico_id FROM uf WHERE modos_utilizados = 1"))
def q17(w: Warehouse):
    features = silver.user_features(w.silver, w.points, "2024-01-20 00:00:00", bridge=w.bridge)
    return quality.user_feature_rules(features.withColumn("es_multimodal", F.lit(True)))


@query("Q18_user_features_recomputed", _features_sql(_CUT, "SELECT usuario_canonico_id FROM uf WHERE eventos_aerometro > 0"))
def q18(w: Warehouse):
    w = w.stored
    features = silver.user_features(w.silver, w.points, "2024-01-20 00:00:00", bridge=w.bridge)
    altered = features.withColumn("total_eventos", c("total_eventos") + c("usa_aerometro").cast("int"))
    return quality.user_features_recomputed(altered, w.silver, w.bridge, w.points)


@query("Q19_population_rules", "SELECT corte, unidad_id FROM pop WHERE op = 'Aerometro' AND (corte = 'C' OR futuros > 0)")
def q19(w: Warehouse):
    altered = F.when(c("operador") == AM, 1).otherwise(c("etiqueta"))
    return quality.population_rules(w.population.withColumn("etiqueta", altered), label_days=LABEL_DAYS)


@query("Q20_card_feature_rules", "SELECT unidad_id FROM feat WHERE op = 'MetroRiel'")
def q20(w: Warehouse):
    altered = F.when(c("operador") == MR, c("viajes_14d") + 1).otherwise(c("viajes_7d"))
    return quality.card_feature_rules(w.features.withColumn("viajes_7d", altered), w.population)


@query(
    "Q21_load_counts",
    """SELECT 'tm' AS relacion, (SELECT count(*) FROM tm_raw) AS esperadas, (SELECT count(*) FROM tm) AS cargadas,
         (SELECT count(*) FROM tm) - (SELECT count(*) FROM tm_raw) AS diferencia
       UNION ALL SELECT 'mr', (SELECT count(*) FROM mr_raw), (SELECT count(*) FROM mr),
         (SELECT count(*) FROM mr) - (SELECT count(*) FROM mr_raw)""",
)
def q21(w: Warehouse):
    return quality.load_counts(
        {"tm": w.tm_validations, "mr": w.mr_trips_raw}, {"tm": w.silver[TM], "mr": w.silver[MR]}
    )


@query("Q22_runs_equal", "SELECT 'orders' AS relacion, (SELECT count(*) FROM orders) AS filas_a, (SELECT count(*) FROM orders) AS filas_b")
def q22(w: Warehouse):
    names = ("orders", "customer", "lineitem", "nation")
    first = {n: w.table(n) for n in names}
    second = {**first, "orders": w.table("orders").withColumn("o_orderstatus", F.lower("o_orderstatus"))}
    second["lineitem"] = w.table("lineitem").withColumn("fecha_proceso", F.current_date())
    out = quality.runs_equal(first, second, exclude=["fecha_proceso"])
    return out.select("relacion", "filas_a", "filas_b")


@query(
    "Q23_scoring_input_rules",
    """SELECT unidad_id, 'nulo' AS problema FROM feat WHERE op = 'MetroRiel' AND corte = 'A'
       UNION ALL SELECT md5(op || '-' || llave), 'clave' FROM feat WHERE op = 'Aerometro' AND corte = 'A'""",
)
def q23(w: Warehouse):
    w = w.at_cut("A")
    cards = w.population.select("unidad_id", "corte", c("llave_operacional").alias("tarjetas"))
    rows = w.features.join(cards, ["unidad_id", "corte"])
    broken = rows.withColumns(
        {
            "gasto_28d_gtq": F.when(c("operador") != MR, c("gasto_28d_gtq")),
            "unidad_id": F.when(c("operador") == AM, F.md5(F.concat_ws("-", "operador", "tarjetas"))).otherwise(c("unidad_id")),
        }
    )
    return quality.scoring_input_rules(broken, ["gasto_28d_gtq", "viajes_28d"])


_TIMES = {TM: ["fecha_hora"], TU: ["fecha_hora"], AM: ["fecha_hora"], MR: ["fecha_hora_ingreso", "fecha_hora_salida"]}
_AUDITED = [
    "operador", "viajes_28d", "viajes_7d", "viajes_14d", "dias_activos_28d", "dias_desde_ultimo_uso", "gasto_28d_gtq",
    "tarifa_media_gtq", "puntos_origen_28d", "proporcion_hora_pico", "proporcion_fin_semana",
]
_ZEROS = ", ".join(f"('{n}')" for n in ["__fila_ausente__", *_AUDITED])


def _features_at(w: Warehouse, cut: str):
    cuts = [x for x in w.cuts if x[0] == cut]

    def build(sources):
        uses = silver.card_uses({op: sources[op] for op in silver.MODE_SUFFIX}, sources["cuarentena"])
        pop = pit.card_population(uses, sources["historia"], cuts, label_days=LABEL_DAYS)
        return pit.card_features(pop, uses, cuts)

    return build


@query("Q24_leakage_audit", f"SELECT n AS columna, CAST(0 AS BIGINT) AS diferencias FROM (VALUES {_ZEROS}) x(n) WHERE (SELECT count(*) FROM feat) > 0")
def q24(w: Warehouse):
    sources = {**w.silver, "cuarentena": w.quarantine, "historia": w.history}
    return quality.leakage_audit(
        sources, {**_TIMES, "historia": ["valid_from"]}, "2024-01-15 00:00:00", _features_at(w, "A"),
        ["unidad_id", "fecha_corte"], ["corte", "etiqueta"],
    )


@query("Q25_invariance_audit", f"SELECT n AS columna, CAST(0 AS BIGINT) AS diferencias FROM (VALUES {_ZEROS}) x(n) WHERE (SELECT count(*) FROM feat) > 0")
def q25(w: Warehouse):
    w = w.stored
    sources = {**w.silver, "cuarentena": w.quarantine, "historia": w.history}
    cut = dict(w.cuts)["C"]
    future = pit.future_rows(sources, cut, 30)
    return quality.invariance_audit(
        sources, future, _features_at(w, "C"), ["unidad_id", "fecha_corte"], ["corte", "etiqueta"]
    )
