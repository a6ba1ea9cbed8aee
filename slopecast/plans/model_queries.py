"""Metric and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import background, metrics, models, workflow
from ..operators.pixels import PIXEL
from ..session import materialise, shared_dir
from ..settings import FEATURES, MODEL_NUMERIC
from .cleaning_queries import SPLIT, tidy
from .fixtures import RULES as INSIDE
from .fixtures import Tables
from .registry import query

CONFUSION = "SELECT count(CASE WHEN label = 0 AND NOT hit THEN 1 END) AS true_negative, count(CASE WHEN label = 0 AND hit THEN 1 END) AS false_positive, count(CASE WHEN label = 1 AND NOT hit THEN 1 END) AS false_negative, count(CASE WHEN label = 1 AND hit THEN 1 END) AS true_positive FROM (SELECT label, score >= 0.02::DOUBLE AS hit FROM fx_scored) s"
AUC = """SELECT sum(CASE WHEN {y} = 1 THEN r END) - count(CASE WHEN {y} = 1 THEN 1 END) * (count(CASE WHEN {y} = 1 THEN 1 END) + 1) / 2.0 AS u, count(CASE WHEN {y} = 1 THEN 1 END) AS pos, count(CASE WHEN {y} <> 1 THEN 1 END) AS neg
FROM (SELECT {y}, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE AS r FROM {t}) x"""


def _predicted(t: Tables) -> DataFrame:
    hit = F.when(F.col("score") >= F.lit(0.02), 1).otherwise(0)
    return t.view("fx_scored").withColumn("predicted", hit)


@query("a17_confusion_matrix", CONFUSION, ("fx_scored",))
def a17(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(_predicted(t), "label", "predicted")


@query(
    "a18_binary_metrics",
    f"""SELECT *, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy, round(tp::DOUBLE / (tp + fp), 6) AS "precision", round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1
  FROM (SELECT *, true_negative AS tn, false_positive AS fp, false_negative AS fn, true_positive AS tp FROM ({CONFUSION}) c) d""".replace(
        "SELECT *, round((tp", "SELECT true_negative, false_positive, false_negative, true_positive, round((tp"
    ),
    ("fx_scored",),
)
def a18(t: Tables) -> DataFrame:
    return tidy(metrics.binary_metrics(metrics.confusion_matrix(_predicted(t), "label", "predicted")))


@query(
    "a19_roc_auc",
    f"SELECT round(u / (pos::DOUBLE * neg), 6) AS roc_auc, pos AS positives, neg AS negatives FROM ({AUC.format(y='label', s='score', t='fx_scored')}) a",
    ("fx_scored",),
)
def a19(t: Tables) -> DataFrame:
    return tidy(metrics.roc_auc(t.view("fx_scored"), "label", "score"))


# Single-feature scorers: the share of its range that a feature reaches.
RULES = {"by_slope": "slope", "by_rainfall": "rainfall", "by_ndvi": "ndvi", "by_twi": "twi"}
RULE_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS model, round(u / (pos::DOUBLE * neg), 6) AS test_roc_auc FROM ({AUC.format(y='landslide', s=c, t='fx_train')}) a"
    for name, c in RULES.items()
)


def _rules(t: Tables) -> DataFrame:
    rows = None
    for name, column in RULES.items():
        auc = metrics.roc_auc(t.view("fx_train"), "landslide", column)
        part = auc.select(F.lit(name).alias("model"), F.col("roc_auc").alias("test_roc_auc"))
        rows = part if rows is None else rows.unionByName(part)
    return tidy(rows)


@query(
    "l1_rank_models",
    f"SELECT model, test_roc_auc, CAST(row_number() OVER (ORDER BY test_roc_auc DESC, model) - 1 AS BIGINT) AS place FROM ({RULE_ROWS}) r",
    ("fx_train",),
)
def l1(t: Tables) -> DataFrame:
    ranked = models.rank_models(_rules(t)).coalesce(1)
    return ranked.withColumn("place", F.monotonically_increasing_id())


@query("m9_select_best", f"SELECT model, test_roc_auc FROM ({RULE_ROWS}) r ORDER BY test_roc_auc DESC, model LIMIT 1", ("fx_train",))
def m9(t: Tables) -> DataFrame:
    return models.select_best(_rules(t))


@query("a20_cv_mean_std", f"SELECT round(avg(test_roc_auc), 5) AS mean, round(stddev_pop(test_roc_auc), 5) AS std FROM ({RULE_ROWS}) r", ("fx_train",))
def a20(t: Tables) -> DataFrame:
    found = metrics.mean_std(_rules(t), "test_roc_auc")
    return found.select(F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


INPUTS = "(SELECT *, sin(radians(aspect)) AS aspect_sin, cos(radians(aspect)) AS aspect_cos FROM fx_train)"


@query(
    "m1_scale_numeric",
    f"SELECT t.sample_id, {', '.join(f'round((t.{c} - m.{c}_m) / m.{c}_s, 6) + 0.0 AS {c}' for c in MODEL_NUMERIC)} FROM {INPUTS} t, (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in MODEL_NUMERIC)} FROM {INPUTS} i) m",
    ("fx_train",),
)
def m1(t: Tables) -> DataFrame:
    return tidy(models.scale_numeric(models.engineer(t.view("fx_train"))).select("sample_id", *MODEL_NUMERIC))


@query(
    "m2_one_hot",
    "SELECT sample_id, CAST(lulc AS DOUBLE) AS lulc, CASE lulc WHEN 10 THEN 0 WHEN 100 THEN 1 WHEN 30 THEN 2 WHEN 40 THEN 3 WHEN 50 THEN 4 WHEN 60 THEN 5 WHEN 70 THEN 6 WHEN 80 THEN 7 END AS slot FROM fx_train",
    ("fx_train",),
)
def m2(t: Tables) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = models.engineer(t.view("fx_train"))
    encoded = Pipeline(stages=models.one_hot()).fit(rows).transform(rows)
    slot = F.array_position(vector_to_array("lulc_hot"), F.lit(1.0)) - 1
    return encoded.select("sample_id", F.col("lulc").cast("double").alias("lulc"), slot.cast("int").alias("slot"))


@query(
    "m3_balanced_weights",
    "SELECT landslide, count(*) AS \"rows\", round(max((SELECT count(*) FROM fx_train)::DOUBLE) / (2 * count(*)), 6) AS weight FROM fx_train GROUP BY landslide",
    ("fx_train",),
)
def m3(t: Tables) -> DataFrame:
    weighted = models.balanced_weights(t.view("fx_train").select("landslide"))
    return tidy(weighted.groupBy("landslide").agg(F.count(F.lit(1)).alias("rows"), F.max("weight").alias("weight")))


def _parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = models.engineer(t.view("fx_train")).select("sample_id", *MODEL_NUMERIC, "lulc", "landslide")
    split = materialise(background.stratified_split(rows, "sample_id", "landslide"), "split")
    return tuple(split.where(F.col("split") == part).drop("split") for part in ("train", "test"))


#: Least area under the curve on held-out rows, by which SQL can judge a fitted model.
LEAST_AUC = 0.85
JUDGED = f"SELECT sample_id, landslide, true AS probable, true AS consistent, true AS discriminates FROM ({SPLIT}) s WHERE split = 'test'"


def _judged(t: Tables, name: str) -> DataFrame:
    """Held-out rows with what holds for the model's scores: probabilities, classes cut at one half, and an area above the floor."""
    train, test = _parts(t)
    scored = materialise(models.FITTERS[name](train).transform(test).select("sample_id", "landslide", "score", "predicted"), "scored")
    auc = metrics.roc_auc(scored, "landslide", "score").first()["roc_auc"]
    return scored.select(
        "sample_id",
        "landslide",
        F.col("score").between(0.0, 1.0).alias("probable"),
        ((F.col("score") >= 0.5) == (F.col("predicted") == 1)).alias("consistent"),
        F.lit(auc >= LEAST_AUC).alias("discriminates"),
    )


@query("m4_random_forest", JUDGED, ("fx_train",))
def m4(t: Tables) -> DataFrame:
    return _judged(t, "Random Forest")


@query("m5_svm_rbf_calibrated", JUDGED, ("fx_train",))
def m5(t: Tables) -> DataFrame:
    return _judged(t, "SVM")


@query("m6_logistic_regression", JUDGED, ("fx_train",))
def m6(t: Tables) -> DataFrame:
    return _judged(t, "Logistic Regression")


MEASURES = ["cv_roc_auc_mean", "test_accuracy", "test_precision", "test_recall", "test_f1", "test_roc_auc"]


def _evaluated_sql(name: str) -> str:
    floors = ", ".join(f"true AS {m}" for m in MEASURES)
    return f"SELECT '{name}' AS model, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'test') AS test_rows, true AS steady, {floors} FROM ({SPLIT}) s"


def _evaluated(t: Tables, name: str) -> DataFrame:
    """Row counts, and whether each measure lies above the floor and the five folds agree."""
    row = models.evaluate_model(name, *_parts(t))[0]
    floors = [F.col(m).between(LEAST_AUC if "auc" in m else 0.5, 1.0).alias(m) for m in MEASURES]
    counts = [F.col(c).cast("long").alias(c) for c in ("train_rows", "test_rows")]
    return row.select("model", *counts, (F.col("cv_roc_auc_std") < 0.05).alias("steady"), *floors)


@query("m7_evaluate_model", _evaluated_sql("Logistic Regression"), ("fx_train",))
def m7(t: Tables) -> DataFrame:
    return _evaluated(t, "Logistic Regression")


@query("m7_evaluate_forest", _evaluated_sql("Random Forest"), ("fx_train",))
def m7_forest(t: Tables) -> DataFrame:
    return _evaluated(t, "Random Forest")


@query("m7_evaluate_svm", _evaluated_sql("SVM"), ("fx_train",))
def m7_svm(t: Tables) -> DataFrame:
    return _evaluated(t, "SVM")


NUMERIC_SLOTS = ", ".join(f"('{c}_z')" for c in MODEL_NUMERIC)
#: The inputs of a model: each numeric column, and each land class that the training rows hold.
SLOTS = f"""(SELECT f FROM (VALUES {NUMERIC_SLOTS}) v(f) UNION ALL
  SELECT 'lulc_hot_' || CAST(CAST(lulc AS DOUBLE) AS VARCHAR) FROM (SELECT DISTINCT f.lulc FROM fx_train f JOIN ({SPLIT}) s ON f.sample_id = s.sample_id WHERE s.split = 'train') d)"""


def _importance(t: Tables) -> DataFrame:
    train, _ = _parts(t)
    return models.feature_importance(models.fit_logistic(train), train)


@query(
    "m8_feature_importance",
    f"SELECT 'Logistic Regression' AS model, f AS feature, 'absolute_coefficient' AS importance_type, true AS positive FROM {SLOTS} v",
    ("fx_train",),
)
def m8(t: Tables) -> DataFrame:
    return _importance(t).select("model", "feature", "importance_type", (F.col("importance") >= 0).alias("positive"))


@query(
    "l2_rank_importance",
    f"SELECT CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS place, true AS descending FROM {SLOTS} v",
    ("fx_train",),
)
def l2(t: Tables) -> DataFrame:
    """Places of the ranked features, and whether each is at least as important as the next."""
    order = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    ranked = _importance(t).withColumn("place", F.row_number().over(order))
    return ranked.select("place", F.coalesce(F.col("importance") >= F.lead("importance").over(order), F.lit(True)).alias("descending"))


@query(
    "m10_score_pixels",
    f"SELECT row_id, col_id, true AS probable FROM fx_grid WHERE {' AND '.join(INSIDE[c] for c in FEATURES if c in INSIDE)}",
    ("fx_grid",),
)
def m10(t: Tables) -> DataFrame:
    train, _ = _parts(t)
    scored = models.score_pixels(models.fit_logistic(train), t.grid, FEATURES)
    return scored.select(*PIXEL, F.col("score").between(0.0, 1.0).alias("probable"))


@query(
    "k6_save_model",
    f"SELECT 3::BIGINT AS models, true AS best_saved, count(*) AS \"rows\", 0::DOUBLE AS difference FROM ({SPLIT}) s WHERE split = 'test'",
    ("fx_train",),
)
def k6(t: Tables) -> DataFrame:
    """Compare the three models, save the best with its facts and all metrics, and score the held-out rows with both copies."""
    rows = models.engineer(t.view("fx_train")).select("sample_id", *MODEL_NUMERIC, "lulc", "landslide")
    measured, best = workflow.compare(materialise(rows, "training"), list(models.FITTERS), folds=0)
    path = shared_dir(t.spark, "model")
    models.save_model(best, path, measured, {"features": ",".join(MODEL_NUMERIC + ["lulc"]), "seed": "42", "test_share": "0.2"})
    again = models.load_model(t.spark, path)
    _, test = _parts(t)
    pair = best.transform(test).select("sample_id", "score").join(again.transform(test).select("sample_id", F.col("score").alias("again")), "sample_id")
    kept = t.spark.read.parquet(f"{path}/metrics")
    first = F.lit(models.select_best(kept).first()["model"] == again.name)
    same = pair.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("score") - F.col("again"))).alias("difference"))
    return tidy(same.select(F.lit(kept.count()).cast("long").alias("models"), first.alias("best_saved"), "rows", "difference"))
