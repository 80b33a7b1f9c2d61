"""Registry tables: R1-R13 (models, deployments, training job events).

Snapshots are immutable DataFrames: updates return the next snapshot
(``when``/``unionByName``) and are written to a new path by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeep.functions.ordered import positions
from modelkeep.sources.snapshots import SnapshotTable

# Deployment defaults, status names and event texts.
DEFAULT_DRIFT_THRESHOLD = 0.3
DEFAULT_PERFORMANCE_THRESHOLD = 0.7
DONE, PENDING, TRAINING, FAILED = "DONE", "PENDING", "TRAINING", "FAILED"
ACTIVE, INACTIVE = "active", "inactive"
MISSING_METRIC = -1.0
PROMOTED_TEXT = ("Retrained model v%d (%.4f) outperformed active model v%d (%.4f). "
                 "Auto-promoting...")
SKIPPED_TEXT = ("Retrained model v%d (%.4f) did not outperform active model v%d (%.4f). "
                "Promotion skipped.")
STATUS_TEXT = {"TRAINING": "Training in progress...", "DONE": "Training successfully completed."}
DEPLOYED_TEXT = "Model v%d (%s) deployed successfully. API is live."
COMPARISON_SIZE = 8


def model_score(models: DataFrame):
    """coalesce(f1, r2, 0) -- the score the leaderboard sorts by."""
    return F.coalesce(F.col("f1_score"), F.col("r2_score"), F.lit(0.0))


def next_record_id(table: DataFrame) -> int:
    """The smallest id after all ids of a table; 0 for an empty one."""
    last = table.agg(F.max("id")).first()[0]
    return 0 if last is None else last + 1


def next_version(models: DataFrame) -> DataFrame:
    """``(dataset_id, next_version)`` = models of the dataset + 1."""
    return models.groupBy("dataset_id").agg((F.count(F.lit(1)) + 1).cast("long").alias("next_version"))


def list_models(models: DataFrame) -> DataFrame:
    """R2: every model with its ``position``, newest first (ties: newest id first)."""
    return positions(models, [F.col("created_at").desc(), F.col("id").desc()])


def model_status(models: DataFrame, model_id: int) -> DataFrame:
    """Point lookup (pushed into the scan as a filter)."""
    return models.where(F.col("id") == F.lit(model_id))


def active_models(deployments: DataFrame) -> DataFrame:
    return deployments.where(F.col("status") == ACTIVE).select(F.col("model_id").alias("id")).distinct()


def leaderboard(models: DataFrame, deployments: DataFrame, search: str | None = None) -> DataFrame:
    """DONE models by score (desc, then id), ranked from 1, with the
    active flag; optional case-insensitive search on algorithm or name.

    Ranks are positions by the whole order, so neither the table nor the
    models of one score are ever sorted inside one task.
    """
    done = models.where(F.col("status") == DONE)
    if search:
        s = search.lower()
        done = done.where(F.lower("algorithm").contains(s) | F.lower("model_name").contains(s))
    scored = done.select("id", "model_name", "algorithm", "version",
                         model_score(done).alias("score"))
    ranked = positions(scored, [F.col("score").desc(), F.col("id")], name="rank")
    active = active_models(deployments).withColumn("is_active", F.lit(True))
    return (ranked.join(active, "id", "left")
            .select(F.col("rank").cast("long").alias("rank"), "id", "model_name", "algorithm", "version",
                    "score", F.coalesce("is_active", F.lit(False)).alias("is_active")))


def job_counts(models: DataFrame) -> DataFrame:
    """Done, in-progress (PENDING/TRAINING) and failed counts."""
    st = F.col("status")
    return models.agg(
        F.count_if(st == DONE).cast("long").alias("done"),
        F.count_if(st.isin(PENDING, TRAINING)).cast("long").alias("in_progress"),
        F.count_if(st == FAILED).cast("long").alias("failed"))


def jobs_not_done(models: DataFrame) -> DataFrame:
    """The jobs that wait, run or failed, newest first."""
    left = models.where(F.col("status").isin(PENDING, TRAINING, FAILED))
    return left.orderBy(F.col("created_at").desc(), F.col("id").desc())


#: Metrics that a model row can carry.
METRICS = ("accuracy", "f1_score", "precision", "recall", "roc_auc", "r2_score", "mae", "mse", "rmse")


def metrics_map(models: DataFrame):
    """Numeric metrics of a model as a map (NULL entries dropped)."""
    have = [name for name in METRICS if name in models.columns]
    m = F.create_map(*[x for name in have for x in (F.lit(name), F.col(name).cast("double"))])
    return F.map_filter(m, lambda k, v: v.isNotNull() & ~F.isnan(v))


def explode_metrics(models: DataFrame) -> DataFrame:
    """One row per numeric metric of DONE models; title-cased name,
    value x 100 rounded."""
    done = models.where(F.col("status") == DONE).select("id", metrics_map(models).alias("m"))
    ex = done.select("id", F.explode("m").alias("metric_key", "v"))
    return ex.select("id", F.initcap(F.regexp_replace("metric_key", "_", " ")).alias("metric"),
                     F.round(F.col("v") * 100).cast("long").alias("value"))


def model_comparison(models: DataFrame, n: int = COMPARISON_SIZE) -> DataFrame:
    """First ``n`` DONE models, newest first, ``v<version> <algorithm's
    first word>`` and score % rounded; a bounded top-n, not a sort."""
    done = models.where(F.col("status") == DONE)
    top = done.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
    return top.select(
        "id",
        F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(" "),
                 F.split("algorithm", " ").getItem(0)).alias("name"),
        F.round(model_score(top) * 100).cast("long").alias("score"))


def select_best(results: DataFrame, score: str = "score", order: str = "position") -> DataFrame:
    """M7: the candidate with the highest score; strict ``>`` over the
    candidate order, so the first one wins a tie."""
    return results.agg(F.max_by(F.struct(*results.columns),
                                F.struct(F.col(score), -F.col(order))).alias("best")).select("best.*")


def set_active(deployments: DataFrame, models: DataFrame, model_id: int) -> DataFrame:
    """Activate ``model_id`` (must be DONE); every other deployment
    becomes inactive; a model without a deployment gets a new one with the
    default thresholds and the next id."""
    m = models.where((F.col("id") == model_id) & (F.col("status") == DONE)).select("id")
    if m.isEmpty():
        raise ValueError("Cannot deploy a model that is not in 'DONE' state.")
    updated = deployments.withColumn(
        "status", F.when(F.col("model_id") == model_id, F.lit(ACTIVE)).otherwise(F.lit(INACTIVE)))
    next_id = next_record_id(deployments)
    new = (m.join(deployments.select(F.col("model_id").alias("id")), "id", "left_anti")
           .select(F.lit(next_id).cast("long").alias("id"), F.col("id").alias("model_id"),
                   F.lit(ACTIVE).alias("status"),
                   F.lit(DEFAULT_DRIFT_THRESHOLD).alias("drift_threshold"),
                   F.lit(DEFAULT_PERFORMANCE_THRESHOLD).alias("performance_threshold")))
    return updated.select(*new.columns).unionByName(new)


def active_deployment(deployments: DataFrame, models: DataFrame) -> DataFrame:
    """Active deployments with their model."""
    act = deployments.where(F.col("status") == ACTIVE).select(
        F.col("id").alias("deployment_id"), "model_id", "drift_threshold", "performance_threshold")
    return act.join(models.select(F.col("id").alias("model_id"), "dataset_id", "version", "algorithm",
                                  "model_name"), "model_id")


def active_for_dataset(deployments: DataFrame, models: DataFrame) -> DataFrame:
    """``(dataset_id, deployment_id, model_id)`` of active deployments."""
    return active_deployment(deployments, models).select("dataset_id", "deployment_id", "model_id")


def promote_if_better(new_models: DataFrame, models: DataFrame, deployments: DataFrame,
                      datasets: DataFrame) -> DataFrame:
    """Compare each new model with its dataset's active model on f1
    (classification) or r2 (regression); missing = -1.0; promote on strict
    ``>``.  One decision row per new model with an active deployment."""
    act = active_deployment(deployments, models).select(
        "dataset_id", "deployment_id", F.col("model_id").alias("active_model_id"),
        F.col("version").alias("active_version"), "drift_threshold", "performance_threshold")
    act_metrics = models.select(F.col("id").alias("active_model_id"),
                                F.col("f1_score").alias("a_f1"), F.col("r2_score").alias("a_r2"))
    ds = datasets.select(F.col("id").alias("dataset_id"), "problem_type")
    j = (new_models.select(F.col("id").alias("new_model_id"), "dataset_id",
                           F.col("version").alias("new_version"),
                           F.col("f1_score").alias("n_f1"), F.col("r2_score").alias("n_r2"))
         .join(act, "dataset_id").join(act_metrics, "active_model_id").join(ds, "dataset_id"))
    cls = F.col("problem_type") == "classification"
    a_m = F.coalesce(F.when(cls, F.col("a_f1")).otherwise(F.col("a_r2")), F.lit(MISSING_METRIC))
    n_m = F.coalesce(F.when(cls, F.col("n_f1")).otherwise(F.col("n_r2")), F.lit(MISSING_METRIC))
    promoted = n_m > a_m
    msg = F.when(promoted, F.format_string(PROMOTED_TEXT, "new_version", n_m, "active_version", a_m)) \
        .otherwise(F.format_string(SKIPPED_TEXT, "new_version", n_m, "active_version", a_m))
    return j.select("dataset_id", "deployment_id", "active_model_id", "new_model_id",
                    a_m.alias("active_metric"), n_m.alias("new_metric"), promoted.alias("promoted"),
                    msg.alias("message"), "drift_threshold", "performance_threshold")


def apply_promotions(deployments: DataFrame, decisions: DataFrame) -> DataFrame:
    """R11 (write side): promoted datasets get a new active deployment that
    inherits the thresholds; the old ones turn inactive.  Of several promoted
    models of one dataset the best (of equals the first) becomes active, so a
    dataset has one active deployment however many there are."""
    better = F.struct("new_metric", -F.col("new_model_id"))
    won = decisions.where("promoted").groupBy("dataset_id").agg(F.max_by(F.struct(*decisions.columns), better).alias("d")).select("d.*")
    retired = decisions.where("promoted").select(F.col("deployment_id").alias("id")).distinct().withColumn("__retire", F.lit(True))
    base = (deployments.join(retired, "id", "left")
            .withColumn("status", F.when(F.col("__retire"), F.lit(INACTIVE)).otherwise(F.col("status")))
            .drop("__retire"))
    next_id = next_record_id(deployments)
    new = won.select((F.lit(next_id) + F.col("dataset_id")).cast("long").alias("id"),
                     F.col("new_model_id").alias("model_id"), F.lit(ACTIVE).alias("status"),
                     "drift_threshold", "performance_threshold")
    return base.select(*new.columns).unionByName(new)


def update_thresholds(deployments: DataFrame, drift: float | None = None,
                      performance: float | None = None) -> DataFrame:
    """Overwrite thresholds of the active deployment; None keeps."""
    act = F.col("status") == ACTIVE
    out = deployments
    if drift is not None:
        out = out.withColumn("drift_threshold", F.when(act, F.lit(float(drift))).otherwise(F.col("drift_threshold")))
    if performance is not None:
        out = out.withColumn("performance_threshold",
                             F.when(act, F.lit(float(performance))).otherwise(F.col("performance_threshold")))
    return out


def commit_active(table: SnapshotTable, models: DataFrame, model_id: int, token: str | None = None) -> DataFrame:
    """R8 (write side): the stored deployments after :func:`set_active`."""
    return table.update(lambda deps: set_active(deps, models, model_id), token)


def commit_promotions(table: SnapshotTable, decide, token: str | None = None) -> DataFrame:
    """R11 (write side): the stored deployments after the promotions that
    ``decide`` finds for them; decided again if another commit came first, so
    two promotions of one dataset leave one active deployment."""
    return table.update(lambda deps: apply_promotions(deps, decide(deps)), token)


def commit_thresholds(table: SnapshotTable, drift: float | None = None, performance: float | None = None, token: str | None = None) -> DataFrame:
    """R12 (write side): the stored deployments after :func:`update_thresholds`."""
    return table.update(lambda deps: update_thresholds(deps, drift, performance), token)


def job_events(models: DataFrame, error: str | None = None) -> DataFrame:
    """Training job status events derived from model rows: PENDING at
    creation, TRAINING an hour later, DONE/FAILED two hours later, each with its
    status message (of a failure the text in the column ``error``; PENDING has none)."""
    st = F.col("status")
    base = models.select(F.col("id").alias("model_id"), "created_at", "status", (F.col(error) if error else F.lit(None).cast("string")).alias("__error"))
    at = {PENDING: F.col("created_at"), TRAINING: F.col("created_at") + F.expr("INTERVAL 1 HOUR")}
    last = F.col("created_at") + F.expr("INTERVAL 2 HOURS")

    def event(status, ts, message):
        return F.struct(status.alias("status"), ts.alias("ts"), message.cast("string").alias("status_message"))
    steps = F.array(
        event(F.lit(PENDING), at[PENDING], F.lit(None)),
        F.when(st.isin(TRAINING, DONE, FAILED), event(F.lit(TRAINING), at[TRAINING], F.lit(STATUS_TEXT[TRAINING]))),
        F.when(st.isin(DONE, FAILED), event(st, last, F.when(st == DONE, STATUS_TEXT[DONE]).otherwise(F.col("__error")))))
    return base.select("model_id", F.inline(F.array_compact(steps)))


def job_transitions(events: DataFrame) -> DataFrame:
    """Current state of every job = its last event, with its message."""
    last = F.max_by(F.struct("status", "status_message"), "ts")
    return events.groupBy("model_id").agg(last.alias("last"), F.count(F.lit(1)).cast("long").alias("n_events")).select(
        "model_id", "last.status", "last.status_message", "n_events")
