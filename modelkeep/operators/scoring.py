"""Scoring, feedback and live performance: F1-F10.

The prediction log and feedback are append-only tables; the label a
prediction gets is the latest feedback for its id, joined at read time.
Accuracy checks are aggregates per deployment, never row loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeep.sources.tables import write_table

# Evaluation rules and request texts.
MIN_LABELLED = 5
REGRESSION_TOLERANCE = 0.15
PERF_REQUEST_SUFFIX = "_autoretrain_v"
DRIFT_REQUEST_SUFFIX = "_autotune_v"
PERF_REQUEST_MESSAGE = "Performance drop auto-trigger retraining."
DRIFT_REQUEST_MESSAGE = "Auto-retrained due to data drift."
PERF_ALARM_TEXT = ("Model performance dropped to %s (threshold: %s). "
                   "Triggering automatic retraining.")


def check_inputs(log: DataFrame, required: list[str], column: str = "input_json") -> DataFrame:
    """per logged input, the required features it lacks (as a list)."""
    req = F.array(*[F.lit(c) for c in required])
    keys = F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>"))
    return log.withColumn("missing", F.array_except(req, keys))


def decode_labels(pred: DataFrame, classes: list[str], index: str = "raw_prediction") -> DataFrame:
    """class index -> class string; an unknown index stays as is.

    ``classes`` is the model's label list (bounded by its class count), so
    the lookup is a literal array, not a join.
    """
    names = F.array(*[F.lit(c) for c in classes])
    idx = F.col(index).cast("int")
    known = (idx >= 0) & (idx < len(classes))
    return pred.withColumn(
        "prediction", F.when(known, F.element_at(names, idx + 1))
        .otherwise(F.col(index).cast("long").cast("string")))


def scored(model, df: DataFrame) -> DataFrame:
    """``df`` with what the model adds.  The preparation replaces feature
    columns by imputed and scaled ones; the prediction log, and the drift
    tests that read it, need them as they came in."""
    pred = model.transform(df.withColumn("__raw", F.struct(*df.columns)))
    added = [c for c in pred.columns if c not in df.columns and not c.startswith("__")]
    return pred.select("__raw.*", *added)


def log_predictions(pred: DataFrame, deployment_id: int, inputs: list[str],
                    output: str = "prediction") -> DataFrame:
    """rows for the prediction log: inputs as JSON, output, time."""
    return pred.select(
        F.lit(deployment_id).cast("long").alias("deployment_id"),
        F.to_json(F.struct(*inputs)).alias("input_json"),
        F.col(output).cast("string").alias("prediction"),
        F.current_timestamp().alias("logged_at"))


def append_predictions(pred: DataFrame, path: str, deployment_id: int, inputs: list[str],
                       output: str = "prediction") -> DataFrame:
    """F4 (write side): the rows appended to the prediction log, each with a
    ``prediction_id`` of its own, by which feedback is attached later."""
    return write_table(log_predictions(pred, deployment_id, inputs, output), path, id_col="prediction_id")


def prediction_counts(log: DataFrame) -> DataFrame:
    """predictions per deployment (derived, never a counter)."""
    return log.groupBy("deployment_id").agg(F.count(F.lit(1)).cast("long").alias("prediction_count"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Latest actual value per prediction id (later arrival wins)."""
    return feedback.groupBy("prediction_id").agg(
        F.max_by(F.col("actual_value").cast("string"), "received_at").alias("actual"))


def attach_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """the log with its latest actual value (NULL when unlabelled)."""
    return log.drop("actual").join(latest_feedback(feedback), "prediction_id", "left")


def unknown_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """feedback for prediction ids that were never logged."""
    return latest_feedback(feedback).join(log.select("prediction_id"), "prediction_id", "left_anti")


def accuracy_classification(log: DataFrame) -> DataFrame:
    """labelled rows, case-insensitive equality, per deployment."""
    lab = log.where(F.col("actual").isNotNull())
    ok = F.lower(F.col("prediction").cast("string")) == F.lower(F.col("actual").cast("string"))
    return lab.groupBy("deployment_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_labelled"),
        F.count_if(ok).cast("long").alias("n_correct"),
        F.avg(ok.cast("double")).alias("accuracy"))


def tolerance_correct(prediction, actual):
    """Regression hit: relative error < 0.15 (|p| < 0.15 when the actual is
    0); unparsable text counts as wrong."""
    p = prediction.cast("string").try_cast("double")
    a = actual.cast("string").try_cast("double")
    hit = (F.when(a != 0, F.abs(p - a) / F.abs(a) < REGRESSION_TOLERANCE)
           .otherwise(F.abs(p) < REGRESSION_TOLERANCE))
    return F.coalesce(hit, F.lit(False))


def accuracy_tolerance(log: DataFrame) -> DataFrame:
    """F8: regression accuracy by tolerance, per deployment."""
    lab = log.where(F.col("actual").isNotNull())
    ok = tolerance_correct(F.col("prediction"), F.col("actual"))
    return lab.groupBy("deployment_id").agg(
        F.count(F.lit(1)).cast("long").alias("n_labelled"),
        F.count_if(ok).cast("long").alias("n_correct"),
        F.avg(ok.cast("double")).alias("accuracy"))


def performance_check(log: DataFrame, deployments: DataFrame,
                      problem_type: str = "classification") -> DataFrame:
    """accuracy only with >= 5 labelled rows; alarm iff accuracy is
    below the deployment's performance threshold."""
    return check_accuracy(accuracy_classification(log) if problem_type == "classification"
                          else accuracy_tolerance(log), deployments)


def check_accuracy(accuracy: DataFrame, deployments: DataFrame) -> DataFrame:
    """F9 on ``(deployment_id, n_labelled, accuracy)``."""
    dep = deployments.select(F.col("id").alias("deployment_id"), "performance_threshold")
    j = accuracy.where(F.col("n_labelled") >= MIN_LABELLED).join(dep, "deployment_id")
    alarm = F.col("accuracy") < F.col("performance_threshold")
    return j.select("deployment_id", "n_labelled", "accuracy", "performance_threshold",
                    alarm.alias("alarm"),
                    F.when(alarm, F.format_string(PERF_ALARM_TEXT, F.format_number("accuracy", 2),
                                                  F.format_number("performance_threshold", 2)))
                    .alias("message"))


def _dataset_stem(name):
    return F.replace(name, F.lit(".csv"), F.lit(""))


def retrain_requests(alarms: DataFrame, models: DataFrame, deployments: DataFrame,
                     datasets: DataFrame, kind: str = "performance") -> DataFrame:
    """one PENDING model row per alarm.

    performance: ``<dataset>_autoretrain_v{active version + 1}``;
    drift: ``<dataset>_autotune_v{models of the dataset + 1}``.
    ``alarms`` has ``deployment_id`` (and ``alarm``/``has_drift`` true).
    """
    dep = deployments.select(F.col("id").alias("deployment_id"), "model_id")
    mod = models.select(F.col("id").alias("model_id"), "dataset_id", "version", "algorithm")
    ds = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name"))
    j = alarms.select("deployment_id").join(dep, "deployment_id").join(mod, "model_id").join(ds, "dataset_id")
    if kind == "performance":
        version = F.col("version") + 1
        suffix, message = PERF_REQUEST_SUFFIX, PERF_REQUEST_MESSAGE
    else:
        counts = models.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_models"))
        j = j.join(counts, "dataset_id")
        version = F.col("n_models") + 1
        suffix, message = DRIFT_REQUEST_SUFFIX, DRIFT_REQUEST_MESSAGE
    return j.select(
        "dataset_id",
        F.concat(_dataset_stem(F.col("dataset_name")), F.lit(suffix), version.cast("string")).alias("model_name"),
        "algorithm", version.cast("long").alias("version"), F.lit("PENDING").alias("status"),
        F.lit(message).alias("status_message"))
