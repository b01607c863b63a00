import math
import random

import pytest
from pyspark.sql import functions as F

from corredor.functions.scalars import md5_key
from corredor.ml import evaluation, models, segments


def scored(spark, pairs):
    return spark.createDataFrame([(f"u{i}", p, y) for i, (p, y) in enumerate(pairs)], "unidad_id string, puntaje double, etiqueta int")


CASES = [
    [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (1.0, 1), (0.0, 0)],
    [(0.5, 1), (0.5, 0), (0.5, 0)],
    [(round(random.Random(3).random() * i % 1, 2), i % 3 == 0) for i in range(1, 60)],
]


def brute_auc(pairs):
    pos = [p for p, y in pairs if y]
    neg = [p for p, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("pairs", CASES)
def test_auc_and_thresholds_equal_brute_force(spark, pairs):
    pairs = [(p, int(y)) for p, y in pairs]
    df = scored(spark, pairs)
    assert abs(evaluation.roc_auc(df, "etiqueta", "puntaje").head()["auc"] - brute_auc(pairs)) < 1e-12
    table = evaluation.threshold_table(df)
    got = {r["umbral"]: (r["contactadas"], r["tp"], r["fp"], r["tn"], r["fn"], r["ganancia_gtq"]) for r in table.collect()}
    thresholds = {p for p, _ in pairs} | {0.0, 1 / 3, 1.0, math.nextafter(1.0, math.inf)}
    expected = {}
    for t in thresholds:
        n = sum(p >= t for p, _ in pairs)
        tp = sum(p >= t and y for p, y in pairs)
        pos = sum(y for _, y in pairs)
        expected[t] = (n, tp, n - tp, len(pairs) - pos - (n - tp), pos - tp, 15 * tp - 5 * n)
    assert got == expected
    chosen = evaluation.select_threshold(table).head()
    best = max(expected.items(), key=lambda kv: (kv[1][5], -kv[1][0], kv[0]))
    assert chosen["umbral"] == best[0]
    again = evaluation.evaluate_threshold(df, chosen["umbral"]).head()
    assert (again["contactadas"], again["tp"], again["ganancia_gtq"]) == (best[1][0], best[1][1], best[1][5])


def test_auc_of_groups_is_separate(spark):
    pairs = [("a", p, y) for p, y in CASES[0]] + [("b", p, 1 - y) for p, y in CASES[0]]
    df = spark.createDataFrame(pairs, "g string, puntaje double, etiqueta int")
    got = {r["g"]: r["auc"] for r in evaluation.roc_auc(df, "etiqueta", "puntaje", ["g"]).collect()}
    assert abs(got["a"] + got["b"] - 1) < 1e-12 and abs(got["a"] - brute_auc(CASES[0])) < 1e-12


def test_folds_are_disjoint_balanced_and_reproducible(spark):
    df = scored(spark, [(0.0, int(i % 7 == 0)) for i in range(203)])
    one = evaluation.stratified_folds(df, "etiqueta", 5, 2026)
    two = evaluation.stratified_folds(df.repartition(7), "etiqueta", 5, 2026)
    assert {(r["unidad_id"], r["fold"]) for r in one.collect()} == {(r["unidad_id"], r["fold"]) for r in two.collect()}
    sizes = one.groupBy("etiqueta", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["etiqueta"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    other = evaluation.stratified_folds(df, "etiqueta", 5, 1)
    assert {(r["unidad_id"], r["fold"]) for r in one.collect()} != {(r["unidad_id"], r["fold"]) for r in other.collect()}


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        x = [rng.gauss(0, 1) for _ in models.NUMERIC]
        label = int(x[4] + rng.gauss(0, 0.3) > 0)
        rows.append((f"u{i:03d}", models.OPERATORS[i % 4], *x, label))
    schema = "unidad_id string, operador string, " + ", ".join(f"{c} double" for c in models.NUMERIC) + ", etiqueta int"
    df = evaluation.stratified_folds(spark.createDataFrame(rows, schema), "etiqueta", 3, 1)
    from corredor.session import cut_lineage

    return cut_lineage(df)


SPECS = (
    models.Spec("tasa", "constant"), models.Spec("recencia", "recency"),
    models.Spec("l2", "logistic", {"C": 1.0, "l1": 0.0, "iterations": 100}),
    models.Spec("rf", "forest", {"trees": 8, "depth": 3, "leaf": 3}, 1),
)


def test_cross_validation_and_choice(spark, matrix):
    oof, metrics = models.cross_validate(matrix, SPECS, 3)
    assert oof.groupBy("modelo").count().filter("count <> 120").count() == 0
    assert oof.groupBy("modelo", "unidad_id").count().filter("count <> 1").count() == 0
    mean = {r["modelo"]: r["m"] for r in metrics.groupBy("modelo").agg(F.avg("auc_validacion").alias("m")).collect()}
    assert mean["tasa"] == 0.5 and mean["recencia"] > 0.85 and mean["l2"] > 0.85
    assert models.choose_model(metrics).head()["mejor_logistica"] == "l2"


def test_choice_rule(spark):
    def metrics(rows):
        return spark.createDataFrame(
            [(m, f, c, v, auc + 0.01, auc, 0.01, True) for m, f, c, aucs in rows for v, auc in enumerate(aucs)],
            "modelo string, familia string, complejidad int, vuelta int, auc_entrenamiento double, auc_validacion double, brecha double, convergio boolean",
        )

    base = ("l2", "logistic", 0, [0.80, 0.81, 0.79, 0.80, 0.80])
    simple = ("rf1", "forest", 1, [0.81, 0.82, 0.80, 0.81, 0.81])
    flexible = ("rf2", "forest", 2, [0.8105, 0.8205, 0.8005, 0.8105, 0.8105])
    weak = ("rf3", "forest", 3, [0.801, 0.811, 0.791, 0.801, 0.801])
    # within tolerance of the best the simplest wins
    assert models.choose_model(metrics([base, simple, flexible])).head()["modelo"] == "rf1"
    assert models.choose_model(metrics([base, weak])).head()["modelo"] == "l2"
    few_wins = ("rf4", "forest", 1, [0.90, 0.90, 0.90, 0.79, 0.79])
    assert models.choose_model(metrics([base, few_wins])).head()["modelo"] == "l2"


def test_no_converged_logistic_model_is_an_error(spark):
    rows = [("rf", "forest", 1, v, 0.9, 0.8, 0.1, True) for v in range(5)] + [("l2", "logistic", 0, v, 0.9, 0.8, 0.1, False) for v in range(5)]
    metrics = spark.createDataFrame(
        rows, "modelo string, familia string, complejidad int, vuelta int, auc_entrenamiento double, auc_validacion double, brecha double, convergio boolean"
    )
    with pytest.raises(Exception, match="no converged logistic"):
        models.choose_model(metrics).collect()


def test_forests_keep_their_leaves_on_rare_labels(spark, matrix):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier

    rng = random.Random(4)
    rare = {r["unidad_id"]: int(rng.random() < (0.25 if r["dias_desde_ultimo_uso"] > 0 else 0.05)) for r in matrix.collect()}
    labels = spark.createDataFrame(list(rare.items()), "unidad_id string, etiqueta int")
    rows = matrix.drop("etiqueta").join(labels, "unidad_id")
    model = models.forest(rows, trees=20, depth=4, leaf=5)
    pruned = RandomForestClassifier(labelCol="etiqueta", numTrees=20, maxDepth=4, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=models.SEED)
    pruned = Pipeline(stages=[*models.preprocess("forest"), pruned]).fit(rows)
    assert model.stages[-1].totalNumNodes > pruned.stages[-1].totalNumNodes
    scored = models.with_score(model, rows)
    low, high, values = scored.agg(F.min("puntaje"), F.max("puntaje"), F.countDistinct("puntaje")).head()
    assert 0 <= low < high <= 1 and values > 20
    rates = {r["alto"]: r["m"] for r in scored.groupBy((F.col("dias_desde_ultimo_uso") > 0).alias("alto")).agg(F.avg("puntaje").alias("m")).collect()}
    assert rates[True] > rates[False]


def test_forests_do_not_walk_their_trees_per_level_and_grow_the_same(spark, matrix):
    spec = models.Spec("rf", "forest", {"trees": 6, "depth": 12, "leaf": 2})
    cached, walked = models.build(spec, 1), models.build(spec, 1)
    assert cached.getStages()[-1].getCacheNodeIds()
    walked.getStages()[-1].setParams(cacheNodeIds=False)
    a, b = (models.with_score(p.fit(matrix), matrix).select("unidad_id", "puntaje") for p in (cached, walked))
    assert a.exceptAll(b).isEmpty() and a.count() == 120


def test_importance_stops_on_other_scores_and_on_models_that_did_not_converge(spark, matrix):
    oof, _ = models.cross_validate(matrix, SPECS[2:], 3)
    for spec in SPECS[2:]:
        drops = models.drops_per_fold(matrix, spec, 3, repeats=2, oof=oof)
        assert drops.groupBy("vuelta", "variable").count().filter("count <> 2").count() == 0 and drops.count() == 3 * 11 * 2
    with pytest.raises(RuntimeError, match="reproduce"):
        models.drops_per_fold(matrix, SPECS[2], 3, repeats=1, oof=oof.withColumn("puntaje", F.col("puntaje") + 1e-3))
    short = models.Spec("corta", "logistic", {"C": 1.0, "l1": 0.0, "iterations": 1})
    with pytest.raises(RuntimeError, match="converge"):
        models.drops_per_fold(matrix, short, 3, repeats=1)
    with pytest.raises(RuntimeError, match="converge"):
        models.fit_final(matrix, short, "/nowhere")


def test_importance_per_fold(spark, matrix):
    got = {r["variable"]: r for r in models.importance_per_fold(matrix, SPECS[2], 3, repeats=2).collect()}
    assert max(got.values(), key=lambda r: r["caida_auc_media"])["variable"] == "dias_desde_ultimo_uso"
    assert all(r["vueltas"] == 3 for r in got.values()) and got["dias_desde_ultimo_uso"]["de_vueltas"] >= 0


def test_importance_finds_the_predictor_that_matters(spark, matrix):
    model = models.build(SPECS[2], 120).fit(matrix)
    drops = {r["variable"]: r["caida_auc_media"] for r in models.permutation_importance(model, matrix, repeats=3).collect()}
    assert max(drops, key=drops.get) == "dias_desde_ultimo_uso" and drops["dias_desde_ultimo_uso"] > 0.2
    assert models.coefficients(model).orderBy(F.desc("abs_coef")).head()["variable"] == "dias_desde_ultimo_uso"


def test_saved_model_scores_alike_and_checks_its_input(spark, matrix, tmp_path):
    path = str(tmp_path / "m")
    model = models.fit_final(matrix, SPECS[3], path, threshold=0.5)
    rows = matrix.withColumn("tarjetas", F.col("unidad_id")).withColumn(
        "operador", F.when(F.col("unidad_id") == "u000", "Nuevo").otherwise(F.col("operador"))
    )
    rows = rows.withColumn("unidad_id", md5_key(F.col("operador"), F.col("tarjetas")))
    out = models.score(rows, path)
    assert out.columns == ["unidad_id", "tarjetas", "puntaje", "contactar"] and out.count() == 120
    direct = models.with_score(model, rows).select("unidad_id", F.col("puntaje").alias("p"))
    assert out.join(direct, "unidad_id").filter((F.col("p") != F.col("puntaje")) | (F.col("contactar") != (F.col("p") >= 0.5).cast("int"))).count() == 0
    with pytest.raises(ValueError, match="may not be scored"):
        models.score(rows.withColumn("viajes_28d", F.lit(float("nan"))), path)
    with pytest.raises(ValueError, match="missing columns"):
        models.score(rows.drop("viajes_28d"), path)
    with pytest.raises(ValueError, match="threshold"):
        models.fit_final(matrix, SPECS[3], path, threshold=1.5)


def test_thresholds_reject_scores_that_are_none(spark):
    for bad in (float("nan"), 1.5, None):
        with pytest.raises(Exception, match="score outside"):
            evaluation.threshold_table(scored(spark, [(0.2, 0), (bad, 1)])).collect()


def test_segments_of_separated_clusters(spark):
    rng = random.Random(5)
    rows = [(f"u{i}", *[rng.gauss(10 * (i % 3), 0.2) for _ in range(2)]) for i in range(90)]
    df = spark.createDataFrame(rows, "unidad_id string, a double, b double")
    out, curve = segments.segment(df, ks=(2, 3, 4), restarts=2, features=("a", "b"))
    best = curve.filter("elegido").head()
    assert best["k"] == 3 and best["silueta"] > 0.9
    assert out.groupBy("segmento").count().filter("count = 30").count() == 3


def test_all_segment_runs_share_their_passes_and_match_single_fits(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = random.Random(11)
    rows = [([rng.gauss(6 * (i % 4), 1), rng.gauss(5 * (i % 2), 1)],) for i in range(400)] + [([50.0, 50.0],)] * 200  # a third at one point
    points = spark.createDataFrame(rows, "p array<double>").repartition(5)
    runs, passes, step = [(k, r) for k in (2, 5) for r in range(4)], [], segments.lloyd_step

    def counted(df, centres):
        passes.append(len(centres))
        return step(df, centres)

    monkeypatch.setattr(segments, "lloyd_step", counted)
    fits = segments.lloyd(points, segments.starts(points, runs))
    assert passes[0] == len(runs) and passes == sorted(passes, reverse=True) and len(passes) < 60
    again = segments.starts(points.coalesce(1), runs)
    assert all((a == b).all() for a, b in zip(again, segments.starts(points, runs)))
    vectors = points.select(array_to_vector("p").alias("x"))
    for i, k in enumerate((2, 5)):
        best = min(fit[2] for fit in fits[4 * i : 4 * i + 4])
        single = min(KMeans(featuresCol="x", k=k, seed=r, maxIter=300).fit(vectors).summary.trainingCost for r in range(4))
        assert best <= single * 1.001
    for centres, sizes, inertia in fits:
        gaps = [[sum((a - b) ** 2 for a, b in zip(p, c)) for c in centres] for p, in rows]
        assert abs(sum(map(min, gaps)) - inertia) < 1e-6 * inertia and sizes.sum() == len(rows)


def test_silhouette_equals_brute_force(spark):
    from pyspark.ml.linalg import Vectors

    rng = random.Random(9)
    points = [([rng.random(), rng.random()], i % 3) for i in range(40)]
    df = spark.createDataFrame([(Vectors.dense(p), g) for p, g in points], ["x", "g"])
    total = 0
    for i, (p, g) in enumerate(points):
        by = {}
        for j, (q, h) in enumerate(points):
            if i != j:
                by.setdefault(h, []).append(math.dist(p, q) ** 2)
        a = sum(by[g]) / len(by[g])
        b = min(sum(v) / len(v) for k, v in by.items() if k != g)
        total += (b - a) / max(a, b)
    assert abs(segments.silhouette(df, "g") - total / len(points)) < 1e-9


def test_elbow_measures_true_distances_of_uneven_k(spark):
    curve = [(2, 100.0), (3, 40.0), (4, 30.0), (8, 0.0)]
    df = spark.createDataFrame(curve, "k int, inercia double")
    far = max(curve, key=lambda r: 1 - (r[0] - 2) / 6 - r[1] / 100)[0]
    assert segments.elbow(df).head()[0] == far == 3


def test_segment_rejects_what_it_cannot_split(spark):
    flat = spark.createDataFrame([(f"u{i}", 1.0) for i in range(9)], "unidad_id string, a double")
    with pytest.raises(ValueError, match="distinct"):
        segments.segment(flat, features=("a",))
    broken = spark.createDataFrame([(f"u{i}", float(i) if i else float("nan")) for i in range(9)], "unidad_id string, a double")
    with pytest.raises(ValueError, match="finite"):
        segments.segment(broken, features=("a",))


def test_segments_get_two_proposals(spark):
    rows = [(f"u{i}", i % 3, 5.0, float(i % 3), 0) for i in range(30)]
    flat = spark.createDataFrame(rows, "unidad_id string, segmento int, viajes_28d double, dias_desde_ultimo_uso double, etiqueta int")
    out = segments.describe_segments(flat, features=("viajes_28d", "dias_desde_ultimo_uso"), offers=("x", "y"))
    assert {r["segmento"]: r["accion_retencion"] for r in out.collect()} == {0: "x", 1: "x", 2: "y"}


def test_oof_contract(spark, matrix):
    good = matrix.withColumns({"corte": F.lit("A"), "probabilidad_abandono": F.lit(0.5)})
    assert evaluation.validate_oof(good, 3, 1).count() == 0
    bad = good.withColumn("probabilidad_abandono", F.when(F.col("unidad_id") == "u001", F.lit(float("nan"))).otherwise(F.lit(0.5)))
    assert [tuple(r) for r in evaluation.validate_oof(bad, 3, 1).collect()] == [("u001", "probabilidad")]


def test_stratified_sample_keeps_the_share(spark):
    df = scored(spark, [(0.0, int(i % 5 == 0)) for i in range(100)])
    picked = models.stratified_sample(df, "etiqueta", 20, ["unidad_id"])
    counts = {r["etiqueta"]: r["count"] for r in picked.groupBy("etiqueta").count().collect()}
    assert counts == {0: 16, 1: 4}
    assert models.stratified_sample(df, "etiqueta", 500, ["unidad_id"]).count() == 100


def test_fits_do_not_depend_on_the_layout_and_rows_are_scored_once(spark, matrix, monkeypatch):
    specs = SPECS[3:]
    monkeypatch.setattr(models, "FIT_ROWS", 50, raising=False)  # several tasks a fit
    spread, whole = matrix.repartition(7, "gasto_28d_gtq"), matrix.coalesce(1)
    (a, _), (b, _) = (models.cross_validate(x, specs, 3) for x in (spread, whole))
    assert a.exceptAll(b).isEmpty() and a.count() == 120
    # what leaves is a copy of the scores: no model stands in its plan any more
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "Relation" in plan
    models.drops_per_fold(whole, specs[0], 3, repeats=1, oof=a)
