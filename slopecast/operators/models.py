"""Susceptibility classifiers on Spark ML: preparation, training, evaluation and scoring."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import circular_encode
from ..session import materialise
from ..settings import CATEGORICAL, FOLDS, MODEL_NUMERIC, SEED
from . import forest, svm
from .background import stratified_folds
from .metrics import binary_metrics, confusion_matrix, roc_auc
from .pixels import PIXEL, valid_mask

LABEL = "landslide"

# --- fixed values: model settings --------------------------------------------
FOREST_TREES = 300
FOREST_MIN_LEAF = 2
SVM_C = 2.0
SVM_CALIBRATION_FOLDS = 3
SVM_TOLERANCE = 1e-3
LOGISTIC_C = 1.0
LOGISTIC_ITERATIONS = 2000

SVM_PASSES = 500  # the tolerance ends a fit long before
SVM_FILE_ROWS = 32_768
FOREST_DEPTH = 30
FITS_AT_ONCE = 4


def engineer(df: DataFrame) -> DataFrame:
    """Aspect as sine and cosine, the land class as text."""
    sin, cos = circular_encode("aspect")
    typed = {c: F.col(c).cast("double").cast("string") for c in CATEGORICAL}
    return df.withColumns({"aspect_sin": sin, "aspect_cos": cos, **typed})


def scaling(df: DataFrame, columns: list[str] = MODEL_NUMERIC) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column keeps scale 1."""
    row = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns]).first()
    return {c: (row[c]["m"], row[c]["s"] or 1.0) for c in columns}


def scale_numeric(df: DataFrame, columns: list[str] = MODEL_NUMERIC) -> DataFrame:
    """Columns replaced by their zero-mean, unit-deviation values."""
    fitted = scaling(df, columns)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def balanced_weights(df: DataFrame, label: str = LABEL, name: str = "weight") -> DataFrame:
    """Weight n / (classes * class rows) for every row."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(name, weight)


def one_hot(columns: list[str] = CATEGORICAL) -> list:
    """Stages that give every known level a slot and an unknown one none."""
    indexed, encoded = [f"{c}_index" for c in columns], [f"{c}_hot" for c in columns]
    return [
        StringIndexer(inputCols=columns, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
    ]


def _scaler(df: DataFrame) -> SQLTransformer:
    fitted = scaling(df)
    parts = [f"(`{c}` - ({m!r}D)) / {s!r}D AS `{c}_z`" for c, (m, s) in fitted.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def prepare(df: DataFrame, scale: bool) -> tuple[list, list[str]]:
    """Pipeline stages that build ``features`` and the numeric inputs they use."""
    numeric = [f"{c}_z" for c in MODEL_NUMERIC] if scale else list(MODEL_NUMERIC)
    stages = [_scaler(df)] if scale else []
    inputs = [*numeric, *[f"{c}_hot" for c in CATEGORICAL]]
    return [*stages, *one_hot(), VectorAssembler(inputCols=inputs, outputCol="features")], numeric


@dataclass
class Scorer:
    """A fitted model that adds ``score`` (probability of the positive class) and ``predicted``."""

    name: str
    stages: PipelineModel
    kernel: "svm.Kernel | None" = None
    forest: "forest.Forest | None" = None
    calibration: tuple[float, float] | None = None
    extra: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.forest is not None:
            prepared = self.stages.transform(df).select(*df.columns, vector_to_array("features").alias("_inputs"))
            scored = self.forest.scored(prepared, "_inputs")
            return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*df.columns, "score", "predicted")
        if self.kernel is None:
            scored = self.stages.transform(df).withColumn("score", vector_to_array("probability")[1])
            return scored.select(*df.columns, "score", F.col("prediction").cast("int").alias("predicted"))
        margin = self.stages.transform(df).withColumn("margin", self.kernel.margin(self.extra["weights"], vector_to_array("features")))
        slope, intercept = self.calibration
        scored = margin.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.col("margin") + F.lit(intercept)))))
        return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*df.columns, "score", "predicted")


def fit_forest(train: DataFrame, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, key: str = "sample_id") -> Scorer:
    weighted = balanced_weights(train)
    stages, _ = prepare(weighted, scale=False)
    prepared = Pipeline(stages=stages).fit(weighted)
    grown = forest.fit(prepared.transform(weighted), key, LABEL, "weight", trees, depth, FOREST_MIN_LEAF, SEED)
    return Scorer("Random Forest", prepared, forest=grown)


def fit_logistic(train: DataFrame) -> Scorer:
    """L2-penalised; Spark's mean loss matches a summed loss at lambda = 1 / (C * sum of weights)."""
    weighted = balanced_weights(train)
    stages, _ = prepare(weighted, scale=True)
    mass = weighted.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(
        labelCol=LABEL,
        weightCol="weight",
        maxIter=LOGISTIC_ITERATIONS,
        regParam=1.0 / (LOGISTIC_C * mass),
        elasticNetParam=0.0,
        standardization=False,
    )
    return Scorer("Logistic Regression", Pipeline(stages=[*stages, model]).fit(weighted))


def _gamma(df: DataFrame) -> tuple[int, float, int]:
    """Inputs, 1 / (inputs * variance over all entries of the design matrix) and rows."""
    entries = df.select(F.explode(vector_to_array("features")).alias("v"))
    row = entries.agg(F.var_pop("v").alias("v"), F.count("v").alias("n")).first()
    rows = df.count()
    size = row["n"] // max(rows, 1)
    return size, 1.0 / (size * (row["v"] or 1.0)), rows


def side_by_side(spark: SparkSession, steps: list[Callable]) -> list:
    """Results of independent fits whose Spark jobs may overlap; an error of one is raised."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def _platt(margins: DataFrame) -> tuple[float, float]:
    """Sigmoid through out-of-fold margins with Platt's smoothed targets, as weighted rows."""
    counts = {r[LABEL]: r["count"] for r in margins.groupBy(LABEL).count().collect()}
    up, down = (counts.get(1, 0) + 1.0) / (counts.get(1, 0) + 2.0), 1.0 / (counts.get(0, 0) + 2.0)
    target = F.when(F.col(LABEL) == 1, F.lit(up)).otherwise(F.lit(down))
    both = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("y"), target.alias("w")), F.struct(F.lit(0.0).alias("y"), (F.lit(1.0) - target).alias("w"))
        )
    )
    rows = margins.select("margin", both.alias("p")).select("margin", "p.*")
    rows = VectorAssembler(inputCols=["margin"], outputCol="features").transform(rows)
    model = LogisticRegression(labelCol="y", weightCol="w", regParam=0.0, standardization=False).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def fit_svm(train: DataFrame, key: str = "sample_id") -> Scorer:
    """RBF support vector machine through random Fourier features, calibrated out of fold."""
    weighted = balanced_weights(train)
    stages, _ = prepare(weighted, scale=True)
    prepared_model = Pipeline(stages=stages).fit(weighted)
    prepared = prepared_model.transform(weighted)
    inputs, gamma, n = _gamma(prepared)
    kernel = svm.Kernel(inputs, gamma, seed=SEED)
    folded = stratified_folds(prepared.select(key, LABEL, "weight", "features"), key, LABEL, SVM_CALIBRATION_FOLDS)
    given = folded.select(key, "fold", F.col(LABEL).cast("int").alias("y"), F.col("weight").alias("w"), vector_to_array("features").alias("x"))
    rows = materialise(given.repartition(max(1, n // SVM_FILE_ROWS), key), "svm")
    *held_out, final = svm.fit(rows, kernel, [*range(SVM_CALIBRATION_FOLDS), -1], SVM_C, SVM_TOLERANCE, SVM_PASSES)
    margins = rows.select(F.col("y").alias(LABEL), kernel.margin(np.stack(held_out), F.col("x"), F.col("fold")).alias("margin"))
    return Scorer("SVM", prepared_model, kernel, calibration=_platt(materialise(margins, "margins")), extra={"weights": final})


FITTERS = {"Random Forest": fit_forest, "SVM": fit_svm, "Logistic Regression": fit_logistic}


def evaluate_model(name: str, train: DataFrame, test: DataFrame, folds: int = FOLDS, key: str = "sample_id") -> tuple[DataFrame, Scorer]:
    """One metrics row (cross-validated and hold-out) and the model fitted on all training rows.

    Preparation is refitted inside every fold; without folds the cross-validated columns are NULL.
    """
    fit = FITTERS[name]
    aucs = []
    if folds:
        folded = materialise(stratified_folds(train, key, LABEL, folds, name="cv"), "folds")

        def held_out(fold: int) -> float:
            model = fit(folded.where(F.col("cv") != fold).drop("cv"))
            scored = materialise(model.transform(folded.where(F.col("cv") == fold).drop("cv")).select(LABEL, "score"), "fold")
            return roc_auc(scored, LABEL, "score").first()["roc_auc"]

        aucs = side_by_side(train.sparkSession, [lambda f=f: held_out(f) for f in range(folds)])
    cv = {"mean": float(np.mean(aucs)), "std": float(np.std(aucs))} if aucs else {"mean": None, "std": None}
    final = fit(train)
    scored = materialise(final.transform(test).select(key, LABEL, "score", "predicted"), "holdout")
    hold_out = binary_metrics(confusion_matrix(scored, LABEL, "predicted"))
    auc = roc_auc(scored, LABEL, "score").first()["roc_auc"]
    row = hold_out.select(
        F.lit(name).alias("model"),
        F.lit(train.count()).alias("train_rows"),
        F.lit(test.count()).alias("test_rows"),
        F.lit(cv["mean"]).cast("double").alias("cv_roc_auc_mean"),
        F.lit(cv["std"]).cast("double").alias("cv_roc_auc_std"),
        *[F.col(c).alias(f"test_{c}") for c in ("accuracy", "precision", "recall", "f1")],
        F.lit(auc).alias("test_roc_auc"),
        "true_negative",
        "false_positive",
        "false_negative",
        "true_positive",
    )
    return row, final


def rank_models(metrics: DataFrame, by: str = "test_roc_auc") -> DataFrame:
    """Highest score first, equal scores by name."""
    return metrics.orderBy(F.desc(by), "model")


def select_best(metrics: DataFrame, by: str = "test_roc_auc") -> DataFrame:
    return rank_models(metrics, by).limit(1)


def feature_names(scored: DataFrame, column: str = "features") -> list[str]:
    """Input names of an assembled vector from its attribute metadata."""
    groups = scored.schema[column].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for g in groups.values() for a in g), key=lambda a: a["idx"])]


def feature_importance(scorer: Scorer, like: DataFrame) -> DataFrame:
    """(model, feature, importance_type, importance), highest first; empty for models without either."""
    spark = like.sparkSession
    schema = "model string, feature string, importance_type string, importance double"
    final = scorer.stages.stages[-1]
    if scorer.forest is not None:
        kind, values = "feature_importance", scorer.forest.importances()
    elif hasattr(final, "coefficients"):
        kind, values = "absolute_coefficient", np.abs(final.coefficients.toArray())
    else:
        return spark.createDataFrame([], schema)
    names = feature_names(scorer.stages.transform(like.limit(0)))
    rows = [(scorer.name, n, kind, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")


def score_pixels(scorer: Scorer, pixels: DataFrame, features: list[str]) -> DataFrame:
    """Probability of the positive class for every valid pixel, as float."""
    scored = scorer.transform(engineer(valid_mask(pixels, features)))
    return scored.select(*PIXEL, F.col("score").cast("float").alias("score"))


def save_model(scorer: Scorer, path: str, metrics: DataFrame, facts: dict[str, str]) -> None:
    """Fitted stages, their facts and the metrics table below one folder."""
    spark = metrics.sparkSession
    scorer.stages.write().overwrite().save(f"{path}/stages")
    described = {"model_name": scorer.name, **facts}
    if scorer.forest is not None:
        scorer.forest.save(f"{path}/forest")
        described["forest_inputs"] = str(scorer.forest.inputs)
    if scorer.kernel is not None:
        weights = scorer.extra["weights"].tolist()
        kernel = [(float(p), f.tolist(), w) for p, f, w in zip(scorer.kernel.phases, scorer.kernel.frequencies.T, weights)]
        spark.createDataFrame(kernel, "phase double, frequency array<double>, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/kernel")
        described |= {"kernel_intercept": repr(weights[-1]), "calibration_slope": repr(scorer.calibration[0]), "calibration_intercept": repr(scorer.calibration[1])}
    spark.createDataFrame(sorted(described.items()), "key string, value string").write.mode("overwrite").parquet(f"{path}/facts")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> Scorer:
    facts = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/facts").collect()}
    scorer = Scorer(facts["model_name"], PipelineModel.load(f"{path}/stages"))
    if "forest_inputs" in facts:
        scorer.forest = forest.Forest.load(spark, f"{path}/forest", int(facts["forest_inputs"]))
    if "calibration_slope" in facts:
        rows = spark.read.parquet(f"{path}/kernel").collect()  # one row a feature
        kernel = svm.Kernel(1, 1.0)
        kernel.phases = np.array([r["phase"] for r in rows])
        kernel.frequencies = np.array([r["frequency"] for r in rows]).T
        scorer.kernel = kernel
        scorer.calibration = (float(facts["calibration_slope"]), float(facts["calibration_intercept"]))
        scorer.extra = {"weights": np.array([*(r["weight"] for r in rows), float(facts["kernel_intercept"])])}
    return scorer
