"""Model specifications, cross validation, choice and importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corredor.ml.evaluation import roc_auc
from corredor.operators.ranking import arg_max
from corredor.operators.sets import union_all
from corredor.operators.windows import number_rows
from corredor.session import write_once

# Predictors, operators and the compared model families.
NUMERIC = (
    "viajes_28d", "viajes_7d", "viajes_14d", "dias_activos_28d", "dias_desde_ultimo_uso",
    "gasto_28d_gtq", "tarifa_media_gtq", "puntos_origen_28d", "proporcion_hora_pico", "proporcion_fin_semana",
)
OPERATORS = ("Aerometro", "MetroRiel", "Transmetro", "Transurbano")
SEED = 2026


@dataclass(frozen=True)
class Spec:
    """A model to compare; ``complexity`` orders the forests from simple to flexible."""

    name: str
    family: str  # constant, recency, logistic or forest
    params: Mapping[str, float] = field(default_factory=dict)
    complexity: int = 0


SPECS = (
    Spec("baseline_tasa", "constant"),
    Spec("baseline_recencia", "recency"),
    Spec("logistica_l1", "logistic", {"C": 0.1, "l1": 1.0}),
    Spec("logistica_l2", "logistic", {"C": 0.01, "l1": 0.0}),
    Spec("rf_somero", "forest", {"trees": 100, "depth": 6, "leaf": 50}, 1),
    Spec("rf_regularizado", "forest", {"trees": 100, "depth": 12, "leaf": 20}, 2),
    Spec("rf_flexible", "forest", {"trees": 100, "depth": 30, "leaf": 5}, 3),
)
C_VALUES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


def as_matrix(features: DataFrame) -> DataFrame:
    """Features with numeric predictors as doubles, as MLlib takes them."""
    return features.withColumns({c: F.col(c).cast("double") for c in NUMERIC})


def preprocess(family: str, numeric: Sequence[str] = NUMERIC, levels: Sequence[str] = OPERATORS) -> list:
    """Stages from predictors to ``features``.

    Unknown operators encode as zeros. Logistic models drop the first operator and scale the
    numeric predictors; forests take them as they are.
    """
    indexer = StringIndexerModel.from_labels(list(levels), inputCol="operador", outputCol="_op", handleInvalid="keep")
    # the extra index of unknown values is last and is the one left out
    onehot = OneHotEncoder(inputCols=["_op"], outputCols=["_hot"], dropLast=True)
    if family != "logistic":
        return [indexer, onehot, VectorAssembler(inputCols=[*numeric, "_hot"], outputCol="features")]
    return [
        indexer,
        onehot,
        VectorSlicer(inputCol="_hot", outputCol="_hot1", indices=list(range(1, len(levels)))),
        VectorAssembler(inputCols=list(numeric), outputCol="_num"),
        StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_scaled", "_hot1"], outputCol="features"),
    ]


def build(spec: Spec, rows: int, label: str = "etiqueta") -> Pipeline:
    """Unfitted pipeline of a specification; ``rows`` turns C into a mean-loss penalty.

    A forest is fitted as a regression on the 0/1 label: the variance of a 0/1 label is half its Gini impurity, so the
    splits are the same, and a leaf keeps the mean of its rows. The classifier would merge leaves of one majority class,
    and with it lose all probabilities below one half. Node ids are cached: without them each level walks every row
    down every tree from its root again, leaves included. The trees are the same.
    """
    if spec.family == "logistic":
        estimator = LogisticRegression(
            labelCol=label,
            regParam=1.0 / (spec.params["C"] * rows),
            elasticNetParam=spec.params["l1"],
            standardization=False,
            maxIter=int(spec.params.get("iterations", 1000)),
            tol=1e-6,
        )
    else:
        estimator = RandomForestRegressor(
            labelCol=label,
            numTrees=int(spec.params["trees"]),
            maxDepth=int(spec.params["depth"]),
            minInstancesPerNode=int(spec.params["leaf"]),
            featureSubsetStrategy="sqrt",
            cacheNodeIds=True,
            seed=SEED,
        )
    return Pipeline(stages=[*preprocess(spec.family), estimator])


def with_score(model: PipelineModel, df: DataFrame, name: str = "puntaje") -> DataFrame:
    """``df`` with the probability of label 1: of a logistic model directly, of a forest the mean of its leaves' means."""
    scored = model.transform(df)
    return scored.withColumn(name, vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction"))


def converged(model: PipelineModel) -> bool:
    """A logistic model that ended before its last iteration; other models always."""
    last = model.stages[-1]
    return not hasattr(last, "getMaxIter") or last.summary.totalIterations < last.getMaxIter()


def fit_converged(spec: Spec, df: DataFrame, rows: int, label: str = "etiqueta") -> PipelineModel:
    """The fitted pipeline; a logistic model that ran out of iterations is an error."""
    model = build(spec, rows, label).fit(df)
    if not converged(model):
        raise RuntimeError(f"{spec.name} did not converge")
    return model


def forest(df: DataFrame, trees: int = 100, depth: int = 6, leaf: int = 50) -> PipelineModel:
    """D05."""
    return build(Spec("rf", "forest", {"trees": trees, "depth": depth, "leaf": leaf}), 1).fit(df)


#: Fits that run side by side; each is a Spark job over all rows.
PARALLEL_FITS = 8
#: Rows of a task of these fits. Every task of a forest ships the histograms of all nodes of a level, so few tasks do less work.
FIT_ROWS = 250_000


def fit_all(jobs: Sequence) -> list:
    """Results of the given calls in their order, ``PARALLEL_FITS`` at a time."""
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(lambda job: job(), jobs))


def _laid_out(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as fits side by side read it: in as many tasks as its ``rows`` need, by unit and whatever the layout of ``df``.

    Bootstrap draws follow tasks and places, so a refit on another layout of the same rows draws the same.
    """
    return df.repartition(1 + rows // FIT_ROWS, "unidad_id").sortWithinPartitions("unidad_id").persist()


def cross_validate(df: DataFrame, specs: Sequence[Spec], k: int, label: str = "etiqueta") -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores of every specification, and its AUC per fold on both sides.

    ``df`` carries ``fold``; its rows are held laid out while the fits run. The fitted models score all rows in
    one pass that is written once, and the AUC of all models, folds and sides and the out-of-fold scores read that.
    Logistic fits go first: behind tasks of forests each of their many short jobs would wait. Then the largest forests.
    """
    spark = df.sparkSession
    sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}  # one row per fold
    total = sum(sizes.values())
    laid, models = _laid_out(df, total), {}
    try:
        for family in ("logistic", "forest"):
            own = sorted((s for s in specs if s.family == family), key=lambda s: -s.complexity)
            trained = [(spec, fold) for spec in own for fold in range(k)]
            jobs = [lambda s=s, f=f: build(s, total - sizes[f], label).fit(laid.filter(F.col("fold") != f)) for s, f in trained]
            models.update(zip([(s.name, f) for s, f in trained], fit_all(jobs)))
    finally:
        laid.unpersist()
    # plans of many stages, made side by side
    ready = dict(zip(models, fit_all([lambda m=m: with_score(m, df) for m in models.values()])))
    scored, outcomes = [], []
    for spec in specs:
        for fold in range(k):
            finished = True
            if spec.family == "recency":
                rows = df.withColumn("puntaje", F.col("dias_desde_ultimo_uso").cast("double"))
            elif spec.family == "constant":
                rate = df.filter(F.col("fold") != fold).agg(F.avg(F.col(label).cast("double")).alias("_r"))
                rows = df.withColumn("puntaje", rate.scalar())
            else:
                finished = converged(models[spec.name, fold])
                rows = ready[spec.name, fold]
            outcomes.append((spec.name, spec.family, spec.complexity, fold, finished))
            side = F.when(F.col("fold") == fold, "validacion").otherwise("entrenamiento").alias("lado")
            keep = ["unidad_id", "fold", F.col(label).alias("etiqueta"), "puntaje"]
            scored.append(rows.select(F.lit(spec.name).alias("modelo"), F.lit(fold).alias("vuelta"), side, *keep))
    every = write_once(union_all(scored), "scores")
    per_side = roc_auc(every, "etiqueta", "puntaje", ["modelo", "vuelta", "lado"])
    wide = per_side.groupBy("modelo", "vuelta").agg(
        *[F.max(F.when(F.col("lado") == s, F.col("auc"))).alias(f"auc_{s}") for s in ("entrenamiento", "validacion")]
    )
    info = spark.createDataFrame(outcomes, "modelo string, familia string, complejidad int, vuelta int, convergio boolean")
    metrics = wide.join(F.broadcast(info), ["modelo", "vuelta"]).withColumn(
        "brecha", F.col("auc_entrenamiento") - F.col("auc_validacion")
    )
    oof = every.filter(F.col("lado") == "validacion").select("modelo", "unidad_id", "fold", "etiqueta", "puntaje")
    return oof, metrics


def logistic_sweep(
    df: DataFrame, k: int, values: Sequence[float] = C_VALUES, penalties: Sequence[float] = (0.0, 1.0), iterations: int = 1000
) -> DataFrame:
    """Mean and deviation of the validation AUC per penalty and C."""
    specs = [
        Spec(f"{'l1' if l1 else 'l2'}:{c}", "logistic", {"C": c, "l1": l1, "iterations": iterations})
        for l1 in penalties
        for c in values
    ]
    _, metrics = cross_validate(df, specs, k)
    parts = F.split("modelo", ":")
    c_value = parts[1].cast("double")
    return metrics.groupBy(parts[0].alias("penalty"), c_value.alias("C"), (1 / c_value).alias("lambda")).agg(
        F.avg("auc_validacion").alias("mean_auc"), F.stddev_pop("auc_validacion").alias("std_auc")
    )


# Tolerances of the model choice.
MIN_GAIN, MIN_WINS, STD_TOLERANCE, GAP_TOLERANCE, COMPLEXITY_TOLERANCE = 0.002, 4, 0.002, 0.020, 0.001


def choose_model(metrics: DataFrame) -> DataFrame:
    """The recommended model as one row.

    The best converged logistic model is the bar. A forest must beat it in the mean and in most
    folds without losing stability or widening the gap; of those close to the best, the simplest
    is taken. ``metrics`` has one row per model and fold.
    """
    stats = metrics.groupBy("modelo", "familia", "complejidad").agg(
        F.avg("auc_validacion").alias("media"),
        F.stddev_pop("auc_validacion").alias("de"),
        F.avg("brecha").alias("brecha"),
        F.bool_and("convergio").alias("convergio"),
    )
    usable = stats.filter("convergio")
    bar = arg_max(usable.filter(F.col("familia") == "logistic"), [F.col("media"), -F.col("de")])
    bar = bar.select(F.col("modelo").alias("mejor_logistica"), F.col("media").alias("_media"),
                     F.col("de").alias("_de"), F.col("brecha").alias("_brecha"))
    bar_folds = metrics.join(F.broadcast(bar), F.col("modelo") == F.col("mejor_logistica")).select(
        "vuelta", F.col("auc_validacion").alias("_bar")
    )
    deltas = (
        metrics.filter(F.col("familia") == "forest")
        .join(bar_folds, "vuelta")
        .withColumn("_d", F.col("auc_validacion") - F.col("_bar"))
        .groupBy("modelo")
        .agg(F.avg("_d").alias("ganancia"), F.count_if(F.col("_d") > 0).alias("folds_ganados"))
    )
    from corredor.operators.joins import with_scalar

    compared = with_scalar(usable.join(deltas, "modelo"), bar)
    eligible = compared.filter(
        (F.col("ganancia") >= MIN_GAIN)
        & (F.col("folds_ganados") >= MIN_WINS)
        & (F.col("de") <= F.col("_de") + STD_TOLERANCE)
        & (F.col("brecha") <= F.col("_brecha") + GAP_TOLERANCE)
    )
    best = eligible.agg(F.max("ganancia").alias("_best"))
    forests = with_scalar(eligible, best).filter(F.col("ganancia") >= F.col("_best") - COMPLEXITY_TOLERANCE)
    candidates = forests.select("modelo", "mejor_logistica", F.lit(0).alias("_rank"), F.col("complejidad").alias("_c"), "ganancia")
    fallback = bar.select(
        F.col("mejor_logistica").alias("modelo"), "mejor_logistica", F.lit(1).alias("_rank"), F.lit(0).alias("_c"), F.lit(0.0).alias("ganancia")
    )
    chosen = arg_max(candidates.unionByName(fallback), [-F.col("_rank"), -F.col("_c")])
    # an empty choice means that no logistic model converged: there is no bar to compare with
    named = F.coalesce("modelo", F.raise_error(F.lit("no converged logistic model to compare with")).cast("string"))
    return chosen.select(named.alias("modelo"), "mejor_logistica", F.col("ganancia").alias("delta_auc_vs_logistica"))


def stratified_sample(df: DataFrame, label: str, n: int, order: Sequence[str]) -> DataFrame:
    """First rows per class in the given total order, in proportion, ``n`` in all (or every row)."""
    numbered = number_rows(df, [label, *order], "_i")
    classes = numbered.groupBy(label).agg(F.min("_i").alias("_from"), F.count(F.lit(1)).alias("_size"))
    from corredor.operators.joins import with_scalar

    sized = with_scalar(classes, classes.agg(F.sum("_size").alias("_all")))
    quota = F.least(F.col("_size"), F.round(F.lit(n) * F.col("_size") / F.col("_all")).cast("long"))
    limits = sized.select(label, "_from", quota.alias("_quota"))
    # two classes: the limits are a two-row relation
    return numbered.join(F.broadcast(limits), label).filter(F.col("_i") - F.col("_from") < F.col("_quota")).select(*df.columns)


def permutation_importance(
    model: PipelineModel, df: DataFrame, n: int | None = None, repeats: int = 5, seed: int = SEED, label: str = "etiqueta",
    predictors: Sequence[str] = (*NUMERIC, "operador"),
) -> DataFrame:
    """Mean AUC drop when one predictor is shuffled, and its spread over the repeats."""
    return permutation_drops(model, df, n, repeats, seed, label, predictors).groupBy("variable").agg(
        F.avg("caida_auc").alias("caida_auc_media"), F.stddev_pop("caida_auc").alias("de_permutacion")
    )


def permutation_drops(
    model: PipelineModel, df: DataFrame, n: int | None = None, repeats: int = 5, seed: int = SEED, label: str = "etiqueta",
    predictors: Sequence[str] = (*NUMERIC, "operador"),
) -> DataFrame:
    """AUC drop (``variable``, ``repeticion``, ``caida_auc``) of every shuffle, on all units or a stratified sample of about ``n``.

    The units are numbered in seeded random order; for each predictor and repeat a row takes the
    value of the row a seeded distance away. All shuffles are scored in one pass.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "unidad_id")))
    sample = hashed.select("unidad_id", label, "_h", *predictors)
    if n is not None:
        sample = stratified_sample(sample, label, n, ["_h", "unidad_id"])
    placed = number_rows(sample, ["_h", "unidad_id"], "_pos")
    size = placed.agg(F.count(F.lit(1)).alias("_size"))
    from corredor.operators.joins import with_scalar

    plans = F.explode(
        F.array(*[F.struct(F.lit(p).alias("variable"), F.lit(r).alias("vuelta")) for p in predictors for r in range(repeats)])
    )
    distance = F.pmod(F.xxhash64(F.lit(seed), "variable", "vuelta"), F.col("_size") - 1) + 1
    spread = (
        with_scalar(placed, size)
        .withColumn("_plan", plans)
        .select("*", "_plan.*")
        .withColumn("_from", F.pmod(F.col("_pos") - 1 + distance, F.col("_size")) + 1)
    )
    donors = placed.select(F.col("_pos").alias("_from"), *[F.col(p).alias(f"_d_{p}") for p in predictors])
    shuffled = spread.join(donors, "_from").withColumns(
        {p: F.when(F.col("variable") == p, F.col(f"_d_{p}")).otherwise(F.col(p)) for p in predictors}
    )
    dropped = roc_auc(with_score(model, shuffled), label, "puntaje", ["variable", "vuelta"]).select("variable", "vuelta", "auc")
    base = roc_auc(with_score(model, placed), label, "puntaje").select(F.col("auc").alias("_base"))
    return with_scalar(dropped, base).select("variable", F.col("vuelta").alias("repeticion"), (F.col("_base") - F.col("auc")).alias("caida_auc"))


#: A refit on the same rows gives the same scores but for the order of floating-point sums.
REFIT_TOLERANCE = 1e-6


def drops_per_fold(
    df: DataFrame, spec: Spec, k: int, repeats: int = 5, seed: int = SEED, label: str = "etiqueta", oof: DataFrame | None = None
) -> DataFrame:
    """D09, raw: (``vuelta``, ``variable``, ``repeticion``, ``caida_auc``) of each fold's model on the rows it has not seen.

    With ``oof``, the out-of-fold scores of a cross validation, the refitted models must reproduce the scores of
    ``spec`` unit by unit, and a model that did not converge is an error.
    """
    sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}  # one row per fold
    total = sum(sizes.values())
    laid = _laid_out(df, total)
    try:
        fitted = fit_all([lambda f=f: fit_converged(spec, laid.filter(F.col("fold") != f), total - sizes[f], label) for f in range(k)])
    finally:
        laid.unpersist()
    unseen = [df.filter(F.col("fold") == fold) for fold in range(k)]
    if oof is not None:
        again = union_all([with_score(m, rows, "_otra").select("unidad_id", "_otra") for m, rows in zip(fitted, unseen)])
        known = oof.filter(F.col("modelo") == spec.name).select("unidad_id", "puntaje")
        far = F.coalesce(F.abs(F.col("puntaje") - F.col("_otra")) > REFIT_TOLERANCE, F.lit(True))
        moved = known.join(again, "unidad_id", "full").filter(far).select("unidad_id").take(1)
        if moved:
            raise RuntimeError(f"the refit of {spec.name} does not reproduce the score of {moved[0]['unidad_id']}")
    drops = fit_all([lambda m=m, rows=rows: permutation_drops(m, rows, repeats=repeats, seed=seed, label=label) for m, rows in zip(fitted, unseen)])
    return union_all([own.withColumn("vuelta", F.lit(f)) for f, own in enumerate(drops)])


def importance_per_fold(
    df: DataFrame, spec: Spec, k: int, repeats: int = 5, seed: int = SEED, label: str = "etiqueta", oof: DataFrame | None = None
) -> DataFrame:
    """D09 over folds, from :func:`drops_per_fold`.

    One row per predictor: mean drop, its spread across folds, and the mean spread within a fold's permutations.
    """
    raw = drops_per_fold(df, spec, k, repeats, seed, label, oof)
    per_fold = raw.groupBy("variable", "vuelta").agg(F.avg("caida_auc").alias("media"), F.stddev_pop("caida_auc").alias("de"))
    return per_fold.groupBy("variable").agg(
        F.avg("media").alias("caida_auc_media"),
        F.stddev_pop("media").alias("de_vueltas"),
        F.avg("de").alias("de_permutacion"),
        F.count(F.lit(1)).alias("vueltas"),
    )


def coefficients(model: PipelineModel, numeric: Sequence[str] = NUMERIC, levels: Sequence[str] = OPERATORS) -> DataFrame:
    """Coefficient per predictor of a logistic pipeline, with its magnitude."""
    names = [*numeric, *[f"operador={v}" for v in levels[1:]]]
    values = model.stages[-1].coefficients.toArray()
    rows = [(n, float(v), abs(float(v))) for n, v in zip(names, values, strict=True)]
    return SparkSession.getActiveSession().createDataFrame(rows, "variable string, coeficiente double, abs_coef double")


def fit_final(
    df: DataFrame, spec: Spec, path: str, label: str = "etiqueta", threshold: float | None = None
) -> PipelineModel:
    """Fit the chosen pipeline on the labelled cut-off and save it with its predictors and threshold.

    A logistic model that did not converge is not saved but an error.
    """
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError(f"threshold {threshold} is outside 0 to 1")
    model = fit_converged(spec, df, df.count(), label)
    model.write().overwrite().save(f"{path}/modelo")
    contract = [(spec.name, threshold, [*NUMERIC, "operador"])]
    df.sparkSession.createDataFrame(contract, CONTRACT).write.mode("overwrite").json(f"{path}/contrato")
    return model


CONTRACT = "modelo string, umbral double, columnas array<string>"


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """A saved pipeline and its contract."""
    return PipelineModel.load(f"{path}/modelo"), spark.read.schema(CONTRACT).json(f"{path}/contrato").first().asDict()


def score(df: DataFrame, path: str, threshold: float | None = None, key: str = "tarjetas") -> DataFrame:
    """``unidad_id``, card, score and contact flag of every unit, by a saved pipeline.

    Units that may not be scored (Q23) and missing columns stop the batch before, scores outside 0 to 1
    after. The threshold is the one saved with the model unless another is given.
    """
    from corredor.operators.quality import scoring_input_rules

    model, contract = load_model(df.sparkSession, path)
    threshold = contract["umbral"] if threshold is None else threshold
    if threshold is None:
        raise ValueError("no threshold was saved with the model")
    missing = sorted({"unidad_id", key, *contract["columnas"]} - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    problems = scoring_input_rules(df, NUMERIC, key).groupBy("problema").count().collect()  # one row per rule
    if problems:
        raise ValueError(f"units that may not be scored: {sorted((r['problema'], r['count']) for r in problems)}")
    scored = with_score(model, df)
    bad = F.col("puntaje").isNull() | F.isnan("puntaje") | ~F.col("puntaje").between(0, 1)
    wrong = F.raise_error(F.concat(F.lit("score outside 0 to 1: "), F.col("unidad_id"))).cast("double")
    scored = scored.withColumn("puntaje", F.when(bad, wrong).otherwise(F.col("puntaje")))
    flag = (F.col("puntaje") >= F.lit(threshold)).cast("int")
    return scored.select("unidad_id", key, "puntaje", flag.alias("contactar"))
