"""Feature-to-decision queries on the card features of the bound sources."""

from __future__ import annotations

from functools import lru_cache

from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from corredor.ml import evaluation, models, segments
from corredor.queries.bindings import Warehouse, kept
from corredor.queries.oracle import CTES
from corredor.queries.registry import query
from corredor.session import cut_lineage, work_dir

c = F.col
K, SEED = 5, models.SEED
CTES["fold_a"] = f"""
SELECT *, CAST((row_number() OVER (ORDER BY etiqueta, md5('{SEED}:' || unidad_id), unidad_id) - 1) % {K} AS BIGINT) AS fold
FROM feat WHERE corte = 'A'"""
# one 0/1 predictor: a logistic model without penalty then scores each group with its own rate
CTES["bin_a"] = "SELECT unidad_id, CAST(etiqueta AS BIGINT) AS y, fold, CASE WHEN dias_desde_ultimo_uso >= 7 THEN 1 ELSE 0 END AS x FROM fold_a"
CTES["bin_rate"] = """
SELECT v.fold AS vuelta, t.fold <> v.fold AS dentro, t.unidad_id, t.fold, t.y, t.x,
       avg(CASE WHEN t.fold <> v.fold THEN t.y END) OVER (PARTITION BY v.fold, t.x) AS s
FROM bin_a t, (SELECT DISTINCT fold FROM bin_a) v"""
CTES["bin_auc"] = """
SELECT vuelta, dentro, (sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n) AS auc FROM (
  SELECT *, rank() OVER (PARTITION BY vuelta, dentro ORDER BY s) + (count(*) OVER (PARTITION BY vuelta, dentro, s) - 1) / 2.0 AS r,
         sum(y) OVER (PARTITION BY vuelta, dentro) AS p, sum(1 - y) OVER (PARTITION BY vuelta, dentro) AS n FROM bin_rate)
GROUP BY vuelta, dentro, p, n"""


@lru_cache(maxsize=4)
def _matrix(w: Warehouse, cut: str):
    """Features of one cut-off with its cards, written once: every fit reads them again."""
    w = w.at_cut(cut)
    cards = w.population.select("unidad_id", "corte", c("llave_operacional").alias("tarjetas"))
    rows = w.features.join(cards, ["unidad_id", "corte"])
    return kept(models.as_matrix(rows), "matrix")


@lru_cache(maxsize=2)
def _folded(w: Warehouse):
    return kept(evaluation.stratified_folds(_matrix(w, "A"), "etiqueta", K, SEED), "folds")


@lru_cache(maxsize=2)
def _validated(w: Warehouse):
    oof, metrics = models.cross_validate(_folded(w), models.SPECS, K)
    return oof, cut_lineage(metrics)


@lru_cache(maxsize=2)
def _binary(w: Warehouse):
    """The folded units with one 0/1 predictor; every other predictor is constant."""
    x = (c("dias_desde_ultimo_uso") >= 7).cast("double")
    flat = {n: F.lit(0.0) for n in models.NUMERIC} | {"viajes_28d": x, "operador": F.lit(models.OPERATORS[0])}
    return cut_lineage(_folded(w).withColumns(flat))


FREE = models.Spec("logistica_libre", "logistic", {"C": 1e9, "l1": 0.0})


@lru_cache(maxsize=2)
def _binary_validated(w: Warehouse):
    oof, metrics = models.cross_validate(_binary(w), [FREE], K)
    return cut_lineage(oof), cut_lineage(metrics)


@query("D01_stratified_folds", "SELECT unidad_id, CAST(etiqueta AS BIGINT) AS etiqueta, fold FROM fold_a")
def d01(w: Warehouse):
    return evaluation.stratified_folds(_matrix(w, "A"), "etiqueta", K, SEED).select("unidad_id", "etiqueta", "fold")


@query(
    "D02_preprocess",
    """SELECT unidad_id, round((viajes_28d - avg(viajes_28d) OVER ()) / stddev_samp(viajes_28d) OVER (), 6) AS viajes,
       round((gasto_28d_gtq - avg(gasto_28d_gtq) OVER ()) / stddev_samp(gasto_28d_gtq) OVER (), 6) AS gasto,
       CAST(CASE WHEN op = 'MetroRiel' THEN 1 ELSE 0 END AS DOUBLE) AS metroriel,
       CAST(CASE WHEN op = 'Transurbano' THEN 1 ELSE 0 END AS DOUBLE) AS transurbano, CAST(13 AS BIGINT) AS columnas
       FROM feat WHERE corte = 'A'""",
)
def d02(w: Warehouse):
    rows = _matrix(w, "A")
    ready = Pipeline(stages=models.preprocess("logistic")).fit(rows).transform(rows)
    x = vector_to_array("features")
    return ready.select(
        "unidad_id", x[0].alias("viajes"), x[5].alias("gasto"), x[10].alias("metroriel"), x[12].alias("transurbano"),
        F.size(x).alias("columnas"),
    )


@query(
    "D03_baselines",
    """SELECT unidad_id, fold, round((sum(etiqueta) OVER () - sum(etiqueta) OVER f) / (count(*) OVER () - count(*) OVER f), 6) AS puntaje_tasa,
       round(dias_desde_ultimo_uso, 6) AS puntaje_recencia FROM fold_a WINDOW f AS (PARTITION BY fold)""",
)
def d03(w: Warehouse):
    return evaluation.baselines(_folded(w), K).select("unidad_id", "fold", "puntaje_tasa", "puntaje_recencia")


@query(
    "D04_logistic_sweep",
    """SELECT penalty, C, "lambda", round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM (
         SELECT p.penalty, g.C, 1 / g.C AS "lambda", CASE WHEN p.penalty = 'l1' AND m.g <= 1 / (g.C * m.n) THEN 0.5 ELSE a.auc END AS auc
         FROM (VALUES ('l1.0'), ('l2')) p(penalty), (SELECT unnest([0.001, 0.01, 0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS C) g,
              (SELECT vuelta, abs(covar_pop(x, y)) / stddev_samp(x) AS g, count(*) AS n FROM bin_rate WHERE dentro GROUP BY vuelta) m
         JOIN bin_auc a ON a.vuelta = m.vuelta AND NOT a.dentro) GROUP BY ALL""".replace("'l1.0'", "'l1'"),
)
def d04(w: Warehouse):
    """Every penalty and C: with one predictor the order of the scores, and so the AUC, is known but where L1 erases it."""
    return models.logistic_sweep(_binary(w), K)


@query("D04_full_sweep")
def d04b(w: Warehouse):
    return models.logistic_sweep(_folded(w), K)


@query(
    "D05_forest",
    """SELECT unidad_id, CASE WHEN x = 1 THEN (SELECT avg(y) FROM bin_a WHERE x = 1) > (SELECT avg(y) FROM bin_a WHERE x = 0)
       ELSE (SELECT avg(y) FROM bin_a WHERE x = 0) > (SELECT avg(y) FROM bin_a WHERE x = 1) END AS alto FROM bin_a""",
)
def d05(w: Warehouse):
    """The group with the higher rate gets the higher score."""
    scored = models.with_score(models.forest(_binary(w), leaf=1), _binary(w))
    top = scored.agg(F.max("puntaje").alias("_max"), F.min("puntaje").alias("_min"))
    from corredor.operators.joins import with_scalar

    high = (c("puntaje") == c("_max")) & (c("_max") > c("_min"))
    return with_scalar(scored, top).select("unidad_id", high.alias("alto"))


@query(
    "D06_cross_validate",
    "SELECT unidad_id, fold, y AS etiqueta, round(s, 3) AS puntaje FROM bin_rate WHERE NOT dentro",
)
def d06(w: Warehouse):
    """Out of fold, a model with one 0/1 predictor scores the rate of the group in the other folds."""
    return _binary_validated(w)[0].select("unidad_id", "fold", c("etiqueta").cast("long").alias("etiqueta"), F.round("puntaje", 3).alias("puntaje"))


@query(
    "D06_all_models",
    f"""SELECT m AS modelo, unidad_id, fold, CAST(etiqueta AS BIGINT) AS etiqueta, true AS finito FROM fold_a,
        (VALUES {', '.join(f"('{s.name}')" for s in models.SPECS)}) x(m)""",
)
def d06c(w: Warehouse):
    oof, _ = _validated(w)
    return oof.select("modelo", "unidad_id", "fold", "etiqueta", (c("puntaje").isNotNull() & ~F.isnan("puntaje")).alias("finito"))


@query(
    "D06_fold_metrics",
    """SELECT vuelta, max(CASE WHEN dentro THEN auc END) AS auc_entrenamiento, max(CASE WHEN NOT dentro THEN auc END) AS auc_validacion,
       max(CASE WHEN dentro THEN auc END) - max(CASE WHEN NOT dentro THEN auc END) AS brecha, true AS convergio FROM bin_auc GROUP BY vuelta""",
)
def d06b(w: Warehouse):
    return _binary_validated(w)[1].select("vuelta", "auc_entrenamiento", "auc_validacion", "brecha", "convergio")


@query(
    "D07_roc_auc",
    """SELECT event_type, p AS positivos, n AS negativos, round((s - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n), 6) AS auc FROM (
       SELECT event_type, count(CASE WHEN y = 1 THEN 1 END) AS p, count(CASE WHEN y = 0 THEN 1 END) AS n, sum(CASE WHEN y = 1 THEN r END) AS s FROM (
         SELECT event_type, y, (rank() OVER (PARTITION BY event_type ORDER BY v)) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0 AS r FROM (
           SELECT event_type, floor(v) AS v, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y FROM ev)) GROUP BY event_type)""",
)
def d07(w: Warehouse):
    rows = w.events.select("event_type", F.floor("v").alias("s"), (c("user_id") % 3 == 0).cast("int").alias("y"))
    return evaluation.roc_auc(rows, "y", "s", ["event_type"])


@query(
    "D07_roc_auc_labels",
    """SELECT p AS positivos, n AS negativos, round((s - p * (p + 1) / 2) / (CAST(p AS DOUBLE) * n), 6) AS auc FROM (
       SELECT count(CASE WHEN y = 1 THEN 1 END) AS p, count(CASE WHEN y = 0 THEN 1 END) AS n, sum(CASE WHEN y = 1 THEN r END) AS s FROM (
         SELECT quality AS y, (rank() OVER (ORDER BY n_chars)) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r
         FROM documents JOIN labels USING (doc_id)))""",
)
def d07b(w: Warehouse):
    rows = w.table("documents").select("doc_id", "n_chars").join(w.table("labels"), "doc_id")
    return evaluation.roc_auc(rows, "quality", "n_chars")


_KINDS = {"click": ("logistic", 0), "error": ("logistic", 0), "purchase": ("forest", 1), "signup": ("forest", 2), "view": ("forest", 3)}


@query(
    "D08_choose_model",
    f"""WITH i(modelo, familia, complejidad) AS (VALUES {', '.join(f"('{m}', '{f}', {x})" for m, (f, x) in _KINDS.items())}),
        m AS (SELECT event_type AS modelo, CAST(user_id % 5 AS BIGINT) AS vuelta, avg(least(value, 1)) + max(complejidad) * 0.0015 AS auc,
              avg(least(value, 10)) / 1000 AS brecha FROM events JOIN i ON modelo = event_type GROUP BY 1, 2),
        st AS (SELECT modelo, familia, complejidad, avg(auc) AS media, stddev_pop(auc) AS de, avg(brecha) AS brecha FROM m JOIN i USING (modelo) GROUP BY ALL),
        bar AS (SELECT * FROM st WHERE familia = 'logistic' ORDER BY media DESC, de, modelo LIMIT 1),
        d AS (SELECT m.modelo, avg(m.auc - b.auc) AS g, count(CASE WHEN m.auc > b.auc THEN 1 END) AS won FROM m JOIN m b ON m.vuelta = b.vuelta
              WHERE b.modelo = (SELECT modelo FROM bar) GROUP BY 1),
        ok AS (SELECT st.*, d.g FROM st JOIN d USING (modelo), bar WHERE st.familia = 'forest' AND d.g >= 0.002 AND d.won >= 4
               AND st.de <= bar.de + 0.002 AND st.brecha <= bar.brecha + 0.020),
        pick AS (SELECT modelo, g FROM ok WHERE g >= (SELECT max(g) FROM ok) - 0.001 ORDER BY complejidad LIMIT 1)
        SELECT coalesce((SELECT modelo FROM pick), bar.modelo) AS modelo, bar.modelo AS mejor_logistica,
               coalesce((SELECT g FROM pick), 0) AS delta_auc_vs_logistica FROM bar""",
)
def d08(w: Warehouse):
    """The rule over metrics that stand for models: event types as models, fifths of the users as folds."""
    info = w.spark.createDataFrame([(m, f, x) for m, (f, x) in _KINDS.items()], "modelo string, familia string, complejidad int")
    rows = w.table("events").join(F.broadcast(info), c("event_type") == c("modelo")).groupBy("modelo", "familia", "complejidad", (c("user_id") % 5).alias("vuelta"))
    metrics = rows.agg(
        (F.avg(F.least("value", F.lit(1.0))) + F.max("complejidad") * 0.0015).alias("auc_validacion"),
        (F.avg(F.least("value", F.lit(10.0))) / 1000).alias("brecha"),
    )
    return models.choose_model(metrics.withColumns({"auc_entrenamiento": c("auc_validacion") + c("brecha"), "convergio": F.lit(True)}))


@query("D08_recommended")
def d08b(w: Warehouse):
    return models.choose_model(_validated(w)[1])


@query(
    "D09_permutation_importance",
    f"""SELECT variable, true AS primera, CAST({K} AS BIGINT) AS vueltas FROM (VALUES ('viajes_28d')) v(variable)
        UNION ALL SELECT variable, false, {K} FROM (VALUES {', '.join(f"('{n}')" for n in (*models.NUMERIC[1:], 'operador'))}) v(variable)""",
)
def d09(w: Warehouse):
    """A predictor that equals the label but for one unit in sixteen, beside constant ones: only it can lose AUC, in every fold."""
    other = F.substring(F.md5("unidad_id"), 1, 1) == "0"
    planted = F.when(other, 1 - c("etiqueta")).otherwise(c("etiqueta")).cast("double")
    rows = cut_lineage(_binary(w).withColumn("viajes_28d", planted))
    oof, _ = models.cross_validate(rows, [FREE], K)
    drops = models.importance_per_fold(rows, FREE, K, oof=oof)
    return drops.select("variable", (c("caida_auc_media") > 1e-9).alias("primera"), "vueltas")


@query("D09_all_predictors")
def d09b(w: Warehouse):
    return models.importance_per_fold(_folded(w), models.SPECS[4], K, oof=_validated(w)[0])


@query(
    "D10_coefficients",
    """SELECT 'viajes_28d' AS variable, round(ln(a * d / (b * e)) * s, 3) AS coeficiente, round(abs(ln(a * d / (b * e)) * s), 3) AS abs_coef FROM (
       SELECT CAST(count(CASE WHEN x = 1 AND y = 1 THEN 1 END) AS DOUBLE) AS a, count(CASE WHEN x = 1 AND y = 0 THEN 1 END) AS b,
              count(CASE WHEN x = 0 AND y = 0 THEN 1 END) AS d, count(CASE WHEN x = 0 AND y = 1 THEN 1 END) AS e, stddev_samp(x) AS s FROM bin_a)""",
)
def d10(w: Warehouse):
    """Without penalty the coefficient of a 0/1 predictor is the log of the odds ratio, times its deviation as predictors are scaled."""
    rows = _binary(w)
    found = models.coefficients(models.build(FREE, rows.count()).fit(rows)).filter(c("variable") == "viajes_28d")
    return found.select("variable", F.round("coeficiente", 3).alias("coeficiente"), F.round("abs_coef", 3).alias("abs_coef"))


@query("D10_all_predictors")
def d10b(w: Warehouse):
    rows = _matrix(w, "A")
    return models.coefficients(models.build(models.SPECS[3], rows.count()).fit(rows))


def _scored(w: Warehouse):
    """Events as scored units: the score falls with the amount."""
    score = F.round(1 / (1 + c("value")), 6)
    return w.table("events").select(
        c("event_id").alias("unidad_id"), score.alias("puntaje"), (c("event_type") == "purchase").cast("int").alias("etiqueta")
    )


_SCORED = "SELECT event_id, round(1 / (1 + value), 6) AS s, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events"
_TABLE_SQL = f"""WITH sc AS ({_SCORED}), th AS (SELECT DISTINCT s AS t FROM sc UNION SELECT unnest([0.0, 1.0 / 3, 1.0, 1.0000000000000002])),
    per AS (SELECT t, count(s) AS n, coalesce(sum(y), 0) AS tp FROM th LEFT JOIN sc ON s = t GROUP BY t),
    cum AS (SELECT t, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(tp) OVER w AS BIGINT) AS tp FROM per WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
    tot AS (SELECT CAST(sum(y) AS BIGINT) AS p, count(*) AS a FROM sc)"""
_TABLE_COLUMNS = """n AS contactadas, tp, n - tp AS fp, a - p - (n - tp) AS tn, p - tp AS fn,
    CASE WHEN n > 0 THEN round(tp / n, 6) ELSE 0 END AS precision, CASE WHEN p > 0 THEN round(tp / p, 6) ELSE 0 END AS recall,
    15 * tp - 5 * n AS ganancia_gtq"""


@query("D11_threshold_table", f"{_TABLE_SQL} SELECT round(t, 6) AS umbral, {_TABLE_COLUMNS} FROM cum, tot")
def d11(w: Warehouse):
    return evaluation.threshold_table(_scored(w))


@query(
    "D12_select_threshold",
    f"{_TABLE_SQL} SELECT * FROM (SELECT round(t, 6) AS umbral, {_TABLE_COLUMNS} FROM cum, tot ORDER BY 15 * tp - 5 * n DESC, n, t DESC LIMIT 1)",
)
def d12(w: Warehouse):
    return evaluation.select_threshold(evaluation.threshold_table(_scored(w)))


@query(
    "D13_evaluate_threshold",
    f"""WITH sc AS ({_SCORED}), cum AS (SELECT 0.05 AS t, count(*) AS n, CAST(sum(y) AS BIGINT) AS tp FROM sc WHERE s >= 0.05),
        tot AS (SELECT CAST(sum(y) AS BIGINT) AS p, count(*) AS a FROM sc) SELECT CAST(t AS DOUBLE) AS umbral, {_TABLE_COLUMNS} FROM cum, tot""",
)
def d13(w: Warehouse):
    return evaluation.evaluate_threshold(_scored(w), 0.05)


@query(
    "D14_validate_oof",
    """SELECT unidad_id, 'probabilidad' AS problema FROM fold_a WHERE op = 'MetroRiel'
       UNION ALL SELECT unidad_id, 'fold' FROM fold_a WHERE op = 'Aerometro'""",
)
def d14(w: Warehouse):
    rows = _folded(w).withColumns(
        {
            "probabilidad_abandono": F.when(c("operador") == "MetroRiel", 1.5).otherwise(0.5),
            "fold": F.when(c("operador") == "Aerometro", (c("fold") + 1) % K).otherwise(c("fold")),
        }
    )
    return evaluation.validate_oof(rows, K, SEED)


_PLACES = """SELECT c_custkey, 100.0 * r_regionkey + c_acctbal / 1000 AS a, 100.0 * (r_regionkey * r_regionkey % 5) + c_custkey % 7 AS b
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(
    "D15_segment",
    f"""WITH p AS ({_PLACES.replace("c_custkey, 100", "c_custkey, r_regionkey AS g, 100")}),
        z AS (SELECT g, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b FROM p)
        SELECT CAST(5 AS BIGINT) AS k, round(sum((a - ma) * (a - ma) + (b - mb) * (b - mb)), 4) AS inercia, true AS elegido
        FROM (SELECT a, b, avg(a) OVER (PARTITION BY g) AS ma, avg(b) OVER (PARTITION BY g) AS mb FROM z)""",
)
def d15(w: Warehouse):
    """Customers as points around their region's place: five segments, and the inertia is that of the regions."""
    joined = w.table("customer").join(w.table("nation"), c("c_nationkey") == c("n_nationkey")).join(w.table("region"), c("n_regionkey") == c("r_regionkey"))
    points = joined.select(
        c("c_custkey").alias("unidad_id"),
        (100.0 * c("r_regionkey") + c("c_acctbal") / 1000).cast("double").alias("a"),
        (100.0 * (c("r_regionkey") * c("r_regionkey") % 5) + c("c_custkey") % 7).cast("double").alias("b"),
    )
    _, curve = segments.segment(points, features=("a", "b"))
    return curve.filter("elegido").select("k", F.round("inercia", 4).alias("inercia"), "elegido")


@query("D15_card_segments")
def d15b(w: Warehouse):
    return segments.segment(_matrix(w, "A"))[1]


@query(
    "D16_project",
    """SELECT unidad_id, round(abs(u + sg * v) / sqrt(2), 4) AS pc1, round(abs(u - sg * v) / sqrt(2), 4) AS pc2 FROM (
         SELECT unidad_id, (viajes_28d - avg(viajes_28d) OVER ()) / stddev_samp(viajes_28d) OVER () AS u,
                (dias_desde_ultimo_uso - avg(dias_desde_ultimo_uso) OVER ()) / stddev_samp(dias_desde_ultimo_uso) OVER () AS v,
                sign(corr(viajes_28d, dias_desde_ultimo_uso) OVER ()) AS sg FROM feat WHERE corte = 'A')""",
)
def d16(w: Warehouse):
    """Of two standardised columns the components are their sum and difference over the root of two."""
    out, _ = segments.project(_matrix(w, "A"), 2, ("viajes_28d", "dias_desde_ultimo_uso"))
    return out.select("unidad_id", *[F.round(F.abs(n), 4).alias(n) for n in ("pc1", "pc2")])


@query("D16_all_predictors")
def d16b(w: Warehouse):
    out, _ = segments.project(_matrix(w, "A"))
    return out.select("unidad_id", "pc1", "pc2")


@query(
    "D17_describe_segments",
    """SELECT op AS segmento, count(*) AS tamano, CAST(sum(etiqueta) AS BIGINT) AS positivos, round(sum(etiqueta) / count(*), 6) AS tasa_abandono,
       CAST(median(viajes_28d) AS DOUBLE) AS mediana_viajes_28d, round(median(dias_desde_ultimo_uso), 6) AS mediana_dias_desde_ultimo_uso,
       'Uso ' || CASE WHEN median(viajes_28d) >= (SELECT median(viajes_28d) FROM feat WHERE corte = 'A') THEN 'frecuente' ELSE 'ocasional' END
       || ' y ' || CASE WHEN median(dias_desde_ultimo_uso) <= (SELECT median(dias_desde_ultimo_uso) FROM feat WHERE corte = 'A')
       THEN 'reciente' ELSE 'con pausa mayor' END AS nombre,
       CASE WHEN row_number() OVER (ORDER BY median(dias_desde_ultimo_uso) DESC, op DESC) = 1 THEN 'b'
            WHEN row_number() OVER (ORDER BY median(dias_desde_ultimo_uso), op) = 1 THEN 'a'
            WHEN median(viajes_28d) >= (SELECT median(viajes_28d) FROM feat WHERE corte = 'A') THEN 'a' ELSE 'b' END AS accion_retencion
       FROM feat WHERE corte = 'A' GROUP BY op""",
)
def d17(w: Warehouse):
    rows = _matrix(w, "A").withColumn("segmento", c("operador"))
    found = segments.describe_segments(rows, offers=("a", "b"))
    return found.select(
        "segmento", "tamano", "positivos", "tasa_abandono", "mediana_viajes_28d", "mediana_dias_desde_ultimo_uso", "nombre",
        "accion_retencion",
    )


@lru_cache(maxsize=2)
def _saved(w: Warehouse) -> str:
    path = work_dir(w.spark, "model")
    models.fit_final(_matrix(w, "A"), models.SPECS[4], path, threshold=1 / 3)
    return path


@query("D18_fit_final", "SELECT unidad_id, true AS igual FROM feat WHERE corte = 'A'")
def d18(w: Warehouse):
    path = work_dir(w.spark, "model")
    rows = _matrix(w, "A")
    model = models.fit_final(rows, models.SPECS[4], path)
    before = models.with_score(model, rows).select("unidad_id", c("puntaje").alias("a"))
    after = models.with_score(models.load_model(w.spark, path)[0], rows).select("unidad_id", c("puntaje").alias("b"))
    return before.join(after, "unidad_id").select("unidad_id", (c("a") == c("b")).alias("igual"))


@query(
    "D19_score",
    """SELECT unidad_id, round(s, 3) AS puntaje, CAST(s >= 0.4 AS BIGINT) AS contactar FROM (
       SELECT f.unidad_id, (SELECT avg(y) FROM bin_a b WHERE b.x = CASE WHEN f.dias_desde_ultimo_uso >= 7 THEN 1 ELSE 0 END) AS s
       FROM feat f WHERE corte = 'C')""",
)
def d19(w: Warehouse):
    """A saved model with one 0/1 predictor scores the units of cut-off C with the rates of A; its threshold is saved with it."""
    path = work_dir(w.spark, "model")
    models.fit_final(_binary(w), FREE, path, threshold=0.4)
    x = (c("dias_desde_ultimo_uso") >= 7).cast("double")
    flat = {n: F.lit(0.0) for n in models.NUMERIC} | {"viajes_28d": x}
    out = models.score(_matrix(w, "C").withColumns(flat), path)
    return out.select("unidad_id", F.round("puntaje", 3).alias("puntaje"), "contactar")


@query("D19_score_contract", "SELECT unidad_id, llave AS tarjetas, true AS valido FROM feat WHERE corte = 'C'")
def d19b(w: Warehouse):
    out = models.score(_matrix(w, "C"), _saved(w))
    valid = c("puntaje").between(0, 1) & (c("contactar") == (c("puntaje") >= 1 / 3).cast("int"))
    return out.select("unidad_id", "tarjetas", valid.alias("valido"))
