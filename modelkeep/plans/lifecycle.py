"""Composed plans: P15 register_dataset, F2/F4 scoring, D13 drift_monitor,
F11 run_retraining.

These are driver functions that plan Spark jobs; the driver only sees
per-column profiles, per-feature drift rows, candidate metrics and other
small results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelkeep.functions.ordered import written
from modelkeep.functions.values import column_profile, is_nested, is_numeric_type, typed
from modelkeep.operators import drift as D
from modelkeep.operators import profile as P
from modelkeep.operators import registry as R
from modelkeep.operators import scoring as S
from modelkeep.operators import train as M
from modelkeep.operators.prep import feature_lists, union_feedback
from modelkeep.operators.quality import quality_issues, quality_report
from modelkeep.operators.audit import log_event, log_events
from modelkeep.sources.snapshots import SnapshotTable
from modelkeep.sources.tables import save_model, scan_inputs_json, write_table

DATASET_EVENT = "Dataset '%s' uploaded successfully. Target: %s, Task: %s, Rows: %d"
DRIFT_EVENT = ("Data drift detected! Drift ratio is %.2f (threshold: %.2f). "
               "Triggering auto-retraining.")
NO_LOGS_MESSAGE = "No production predictions logged yet. Run predictions first to calculate drift."
RETRAIN_QUEUED = " Data drift exceeded threshold. Retraining job has been queued."


@dataclass
class DatasetProfile:
    target: str
    problem_type: str
    row_count: int
    column_count: int
    profile: DataFrame          # P13 rows, one per profiled column
    description: str
    numerical: list[str]
    categorical: list[str]


def _kept_rows(frame: DataFrame) -> DataFrame:
    """A frame with a row per column or issue, computed once."""
    return frame.sparkSession.createDataFrame(frame.collect(), frame.schema)


def profile_dataset(df: DataFrame, target: str | None = None,
                    raw: DataFrame | None = None) -> DatasetProfile:
    """P3-P7, P13 on one dataset.  ``raw`` is its column profile, if at hand;
    the coerced one is only computed where some column was coerced."""
    tgt = target if target and target in df.columns else P.rule_target(df.columns, target)
    raw = _kept_rows(column_profile(df)) if raw is None else raw
    coerced = P.coerce_numeric(df)
    prof = raw if coerced is df else _kept_rows(column_profile(coerced))
    p5 = P.profile_features(coerced, tgt, prof)
    enriched = _kept_rows(P.enrich_profile(p5, P.rule_profile(df, tgt, raw)))
    desc = P.describe_dataset(df, tgt).first()
    shape = (raw.agg(F.max("n_rows")).first()[0] or 0) if raw.columns else 0
    numerical, categorical = feature_lists(enriched)
    return DatasetProfile(tgt, desc["suggested_problem_type"], shape, len(df.columns), enriched,
                          desc["description"], numerical, categorical)


def register_dataset(df: DataFrame, name: str, target: str | None = None,
                     key: list[str] | None = None, dataset_id: int = 0) -> DataFrame:
    """One ``datasets`` row (metadata as JSON text) for a scanned table."""
    spark = df.sparkSession
    if df.isEmpty():
        raise ValueError("Dataset is empty.")
    raw = _kept_rows(column_profile(df))
    dp = profile_dataset(df, target, raw)
    meta = dp.profile.select(
        "column", F.struct("type", "null_count", "dtype",
                           F.struct("min", "max", "mean", "unique_count").alias("stats"),
                           "role", "explanation").alias("m"))
    meta_json = meta.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("column", "m"))))
                         .alias("j")).first()["j"]  # one entry per column
    if key:
        issues = _kept_rows(quality_issues(df, key, raw))
        qrep = quality_report(df, key, issues=issues).first()
        quality = {"overall_quality_score": qrep["overall_quality_score"],
                   "overall_summary": qrep["overall_summary"],
                   "issues": [r.asDict() for r in issues
                              .orderBy("pos", "issue_order").drop("issue_order").collect()]}
    else:
        quality = None
    row = (dataset_id, name, dp.row_count, dp.column_count, dp.target, dp.problem_type,
           meta_json, dp.description, json.dumps(quality) if quality else None,
           DATASET_EVENT % (name, dp.target, dp.problem_type, dp.row_count))
    return spark.createDataFrame([row], "id long, name string, row_count long, column_count long, "
                                        "target_column string, problem_type string, features_metadata string, "
                                        "description string, quality_report string, audit_message string") \
        .withColumn("created_at", F.current_timestamp())


def score_batch(model: PipelineModel, df: DataFrame, classes: list[str] | None) -> DataFrame:
    """F2 + F3: predictions of the active pipeline, decoded to class names,
    beside the inputs as they came in."""
    pred = S.scored(model, df)
    if classes:
        return S.decode_labels(pred.withColumnRenamed("prediction", "raw_prediction"), classes)
    return pred.withColumn("raw_prediction", F.col("prediction"))


REPORT_SCHEMA = "deployment_id long, drift_score double, has_drift boolean, message string"


def logged_values(log: DataFrame) -> DataFrame:
    """``(deployment_id, key, kind, num, txt, n, firsts)``: how often each value
    of each key stands in the JSON inputs of each deployment, by one scan of
    the log.  ``firsts`` counts the first cell of every row, so their sum are a
    deployment's rows; JSON nulls, and rows without an object, have no kind."""
    spark = log.sparkSession
    parsed = log.select("deployment_id", F.try_parse_json("input_json").alias("__v"))
    each = parsed.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
    kind = F.expr("CASE WHEN value IS NULL OR is_variant_null(value) THEN NULL ELSE schema_of_variant(value) END")
    kind = F.when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "DOUBLE").when(
        kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "BIGINT").when(kind == "BOOLEAN", kind).when(kind.isNotNull(), "STRING")
    cells = each.select("deployment_id", "key", kind.alias("kind"), "value", (F.coalesce("pos", F.lit(0)) == 0).cast("long").alias("first"))
    num = F.when(F.col("kind").isin("BIGINT", "DOUBLE"), F.expr("try_variant_get(value, '$', 'double')")).when(
        F.col("kind") == "BOOLEAN", F.expr("try_variant_get(value, '$', 'boolean')").cast("double"))
    txt = F.when(F.col("kind").isNotNull(), F.coalesce(F.expr("try_variant_get(value, '$', 'string')"), F.to_json("value")))
    return cells.groupBy("deployment_id", "key", "kind", num.alias("num"), txt.alias("txt")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("first").alias("firsts"))


def _reference_values(references: dict[int, DataFrame]):
    """Value counts ``(ref_id, feature, num, txt, n)`` of each distinct
    reference, its columns, and which reference each dataset has."""
    frames: dict[int, tuple[int, DataFrame]] = {}
    of_dataset, columns, counts = [], [], None
    for dataset_id, frame in references.items():
        if id(frame) not in frames:
            number = len(frames)
            frames[id(frame)] = (number, frame)
            names = [f.name for f in frame.schema.fields if not is_nested(f.dataType)]
            columns += [(number, c, k, is_numeric_type(frame.schema[c].dataType)) for k, c in enumerate(names)]
            cells = [F.struct(F.lit(c).alias("feature"),
                              (typed(frame, c).cast("double") if is_numeric_type(frame.schema[c].dataType) else F.lit(None).cast("double")).alias("num"),
                              D.cell_text(frame, c).alias("txt")) for c in names]
            own = frame.select(F.inline(F.array(*cells))).groupBy("feature", "num", "txt").agg(F.count(F.lit(1)).alias("n"))
            own = own.withColumn("ref_id", F.lit(number))
            counts = own if counts is None else counts.unionByName(own)
        of_dataset.append((dataset_id, frames[id(frame)][0]))
    spark = counts.sparkSession
    return (counts, spark.createDataFrame(columns, "ref_id int, feature string, at int, ref_numeric boolean"),
            spark.createDataFrame(of_dataset, "dataset_id long, ref_id int"))


def drift_monitors(deployments: DataFrame, models: DataFrame, datasets: DataFrame,
                   references: dict[int, DataFrame], log: DataFrame):
    """D13 for every active deployment whose training data is in
    ``references``: ``(reports, features with deployment_id, requests)``.

    One plan for all of them: the log is scanned once, each reference once, and
    all tests work on counts keyed by deployment and feature, so the work
    doesn't grow with the number of deployments.
    """
    counts, columns, of_dataset = _reference_values(references) if references else (None, None, None)
    spark = log.sparkSession
    if counts is None:
        raise ValueError("No active model deployment found.")
    target = datasets.select(F.col("id").alias("dataset_id"), "target_column")
    active = written(R.active_deployment(deployments, models).join(target, "dataset_id").join(of_dataset, "dataset_id").select(
        "deployment_id", "drift_threshold", "target_column", "ref_id"), "active")
    if active.isEmpty():
        raise ValueError("No active model deployment found.")
    ids = active.select("deployment_id")
    cur = written(logged_values(log.join(F.broadcast(ids), "deployment_id", "left_semi")), "logged-values")  # ids: bookkeeping
    rows = cur.groupBy("deployment_id").agg(F.sum("firsts").cast("long").alias("n_rows"))
    kinds = cur.where("kind IS NOT NULL").groupBy("deployment_id", F.col("key").alias("feature")).agg(
        F.collect_set("kind").alias("kinds"), F.sum("n").alias("n_present"))
    number = F.size(F.array_except("kinds", F.array(F.lit("BIGINT"), F.lit("DOUBLE")))) == 0
    cur_type = F.when(number, F.when(F.array_contains("kinds", "DOUBLE"), "DOUBLE").otherwise("BIGINT")).when(
        (F.size("kinds") == 1) & F.array_contains("kinds", "BOOLEAN"), "BOOLEAN").otherwise("STRING")
    met = active.join(columns, "ref_id").where("feature <> coalesce(target_column, '')").join(kinds, ["deployment_id", "feature"]).join(rows, "deployment_id")
    met = met.select("deployment_id", "ref_id", "feature", "n_rows", "n_present", cur_type.alias("cur_type"),
                     (F.col("ref_numeric") & (cur_type != "STRING")).alias("numeric"),
                     (F.row_number().over(Window.partitionBy("deployment_id").orderBy("at")) - 1).alias("position"))
    feats = written(met.where(F.col("n_rows") >= D.MIN_CURRENT_ROWS), "monitored-features")
    key = ["deployment_id"]

    def cells(df):
        """num of numeric features, cat of the others."""
        return df.select("deployment_id", "feature", F.when(F.col("numeric"), F.col("num")).alias("num"),
                         F.when(~F.col("numeric"), F.coalesce("txt", F.lit("nan"))).alias("cat"), "n")
    # A text side's numbers and truth values are written as the reference's are.
    written_as = F.when(F.col("cur_type") == "DOUBLE", F.col("num").cast("string")).when(F.col("cur_type") == "BOOLEAN", F.initcap("txt")).otherwise(F.col("txt"))
    logged = cur.where("kind IS NOT NULL").withColumnRenamed("key", "feature").join(feats, ["deployment_id", "feature"]).withColumn("txt", written_as)
    missing = feats.where("n_rows > n_present").select("*", F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("txt"),
                                                       (F.col("n_rows") - F.col("n_present")).alias("n"))
    raw = written(D.align_counts(cells(counts.join(feats, ["ref_id", "feature"])), cells(logged).unionByName(cells(missing)), key), "aligned")
    aligned = D.fill_from_reference(raw, key)
    tests = written(D.choose_test(aligned, key), "tests")
    place = feats.select(*key, "feature", "position")
    features = written(D.feature_rows(D.drift_statistics(aligned, tests, key).join(place, [*key, "feature"]), F.col("position"), key), "drift-features")
    return _reports(active, rows, met, features), features, S.retrain_requests(
        _reports(active, rows, met, features).where("has_drift").select("deployment_id"), models, deployments, datasets, kind="drift")


def _reports(active: DataFrame, rows: DataFrame, met: DataFrame, features: DataFrame) -> DataFrame:
    """A row of ``REPORT_SCHEMA`` for every active deployment."""
    drifted, many = F.count_if("drift_detected"), F.count(F.lit(1))
    scored = features.groupBy("deployment_id").agg((drifted / many).alias("score"), F.format_string(
        D.DONE_MESSAGE, drifted, many, F.format_number(drifted / many, 2)).alias("done"))
    all_ = active.join(rows, "deployment_id", "left").join(met.groupBy("deployment_id").agg(F.count(F.lit(1)).alias("n_features")), "deployment_id", "left").join(
        scored, "deployment_id", "left")
    n = F.coalesce("n_rows", F.lit(0))
    has = F.coalesce(F.col("score") >= F.col("drift_threshold"), F.lit(False))
    message = (F.when(n == 0, F.lit(NO_LOGS_MESSAGE))
               .when(n < D.MIN_CURRENT_ROWS, F.format_string(D.GATE_MESSAGE, n, F.lit(D.MIN_CURRENT_ROWS)))
               .when(F.col("n_features").isNull(), F.lit(D.NO_FEATURES_MESSAGE))
               .otherwise(F.concat("done", F.when(has, RETRAIN_QUEUED).otherwise(""))))
    return all_.select("deployment_id", F.coalesce("score", F.lit(0.0)).alias("drift_score"), has.alias("has_drift"), message.alias("message"))


def drift_monitor(deployments: DataFrame, models: DataFrame, datasets: DataFrame,
                  references: dict[int, DataFrame], log: DataFrame):
    """The first active deployment -> its training data vs its logged
    inputs -> drift report, and a retrain request when it drifts.  Returns
    ``(report, features, requests)``; :func:`drift_monitors` does all."""
    first = R.active_deployment(deployments, models).orderBy("deployment_id").select("dataset_id", "deployment_id").first()
    if first is None:
        raise ValueError("No active model deployment found.")
    one = deployments.where(F.col("id") == first["deployment_id"])
    reports, features, requests = drift_monitors(one, models, datasets, references, log)
    return reports, features.drop("deployment_id"), requests if reports.first()["has_drift"] else None


def store_monitoring(root: str, reports: DataFrame, requests: DataFrame, deployments: DataFrame) -> None:
    """Write side of D13: report rows, a warning event for each alarm and the
    requested models, appended below ``root``."""
    spark = reports.sparkSession
    write_table(reports.withColumn("created_at", F.current_timestamp()), f"{root}/drift_reports")
    alarms = reports.where("has_drift").join(deployments.select(F.col("id").alias("deployment_id"), "drift_threshold"), "deployment_id").collect()
    if alarms:
        log_events(spark, f"{root}/audit_log", [("DRIFT", DRIFT_EVENT % (a["drift_score"], a["drift_threshold"]), "WARNING") for a in alarms])
        write_table(requests.withColumn("created_at", F.current_timestamp()), f"{root}/model_requests")


def feedback_rows(log: DataFrame, target: str) -> DataFrame:
    """Labelled production inputs as dataset rows (target := actual), with
    their prediction id."""
    lab = log.where(F.col("actual").isNotNull())
    return scan_inputs_json(lab, keep=["prediction_id", "actual"]).withColumnRenamed("actual", target)


def consume_feedback(root: str, log: DataFrame, run: str, mark: str = "prediction_id") -> DataFrame:
    """Labelled rows of the log enter the ledger ``training_feedback`` below
    ``root`` once: those beyond their deployment's high-water ``mark`` (a column
    that ascends with the labels' arrival).  Returns the whole ledger, which is
    what training uses; a replayed ``run`` adds nothing."""
    def new(used: DataFrame | None) -> DataFrame:
        rows = log.where(F.col("actual").isNotNull()).select("deployment_id", "prediction_id", F.col(mark).alias("mark"), "input_json", "actual")
        if used is None:
            return rows.withColumn("run", F.lit(run))
        high = used.groupBy(F.col("deployment_id").alias("of")).agg(F.max("mark").alias("high"))
        met = rows.join(high, F.col("deployment_id").eqNullSafe(F.col("of")), "left")
        return met.where("high IS NULL OR mark > high").drop("of", "high").withColumn("run", F.lit(run))
    return SnapshotTable(log.sparkSession, f"{root}/training_feedback", "entry").extend(new, run)


def training_set(dataset: DataFrame, target: str, key: str, feedback: DataFrame | None) -> DataFrame:
    """The rows F11 trains on: the dataset and the labelled feedback, with a
    split key of their own (the dataset's key may be a feature; feedback rows
    get a deterministic one, so the split survives recomputation)."""
    data = dataset.withColumn(M.SPLIT_KEY, F.col(key).cast("string"))
    if feedback is None:
        return data
    fb = feedback_rows(feedback, target)
    fb = fb.withColumn(M.SPLIT_KEY, F.concat(F.lit("fb:"), F.col("prediction_id").cast("string")))
    return union_feedback(data, fb.drop("prediction_id"), target)


def run_retraining(dataset: DataFrame, dp: DatasetProfile, key: str, log: DataFrame | None,
                   models: DataFrame, deployments: DataFrame, datasets: DataFrame,
                   dataset_id: int, kinds: list[str] | None = None, root: str | None = None, run: str = "0"):
    """dataset (+ labelled feedback of its active deployment) -> M9 ->
    R11 decision.  Returns ``(TrainResult, decision_df)``.  With ``root`` the
    feedback goes through the ledger there, so a label enters training once
    however many runs there are."""
    if log is not None and root is not None:
        log = consume_feedback(root, log, run)
    data = training_set(dataset, dp.target, key, log)
    result = M.auto_train(data, dp.target, dp.problem_type, dp.numerical, dp.categorical, M.SPLIT_KEY, kinds)
    spark = dataset.sparkSession
    new_version = (models.where(F.col("dataset_id") == dataset_id).count()) + 1
    new = spark.createDataFrame(
        [(-1, dataset_id, new_version,
          result.best.metrics.get("f1_score"), result.best.metrics.get("r2_score"))],
        "id long, dataset_id long, version long, f1_score double, r2_score double")
    decision = R.promote_if_better(new, models, deployments, datasets)
    return result, decision


def store_dataset(root: str, row: DataFrame) -> DataFrame:
    """Write side of P15: the dataset's row with a new id, and its audit event."""
    spark = row.sparkSession
    stored = write_table(row.drop("id", "audit_message"), f"{root}/datasets")
    log_event(spark, f"{root}/audit_log", "DATASET", row.first()["audit_message"])
    return stored


def store_training(root: str, result: M.TrainResult, dataset_id: int, version: int, name: str,
                   deployments: DataFrame | None = None, decision: DataFrame | None = None, decide=None) -> tuple[int, DataFrame | None]:
    """Write side of F11, M9 and M10: the model row, its artefact, and, with a
    decision (R11), the deployments after it as a new snapshot and its event.
    ``decide(deployments, model_id)`` decides again where another commit to the
    stored deployments came first.

    Returns the model's id and the deployments as stored.
    """
    spark = SparkSession.active()
    metrics = {k: result.best.metrics.get(k) for k in R.METRICS}
    row = spark.createDataFrame([(dataset_id, version, "DONE", result.best.name, name, *metrics.values())],
                                "dataset_id long, version long, status string, algorithm string, model_name string, "
                                + ", ".join(f"{k} double" for k in metrics)).withColumn("created_at", F.current_timestamp())
    model_id = write_table(row, f"{root}/models").first()["id"]
    save_model(result.final_model, result.metadata(), f"{root}/artifacts/{model_id}")
    events = [("TRAINING", f"{name} trained: {result.best.name}", "INFO")]
    after = None
    if decision is not None and deployments is not None:
        decided = decision.withColumn("new_model_id", F.lit(model_id).cast("long"))
        table = SnapshotTable(spark, f"{root}/deployments")
        if table.version() < 0:
            table.append(deployments, "first")
        after = R.commit_promotions(table, lambda deps: decide(deps, model_id) if decide else decided, f"model={model_id}")
        events += [("PROMOTION", r["message"], "INFO") for r in decided.select("message").collect()]
    log_events(spark, f"{root}/audit_log", events)
    return model_id, after


def train_custom(estimator, df: DataFrame, dp: DatasetProfile, key: str, models: DataFrame,
                 deployments: DataFrame, datasets: DataFrame, dataset_id: int):
    """M10 with its comparison: the custom model against the dataset's active
    one (R11).  Returns ``(TrainResult, decision_df)`` for store_training."""
    final, metrics, classes = M.train_custom_estimator(estimator, df, dp.target, dp.problem_type, dp.numerical, dp.categorical, key)
    best = M.SearchResult(type(estimator).__name__, "custom", {}, None, final, metrics)
    result = M.TrainResult(dp.problem_type, dp.target, classes, [best], best, final, dp.numerical, dp.categorical)
    version = models.where(F.col("dataset_id") == dataset_id).count() + 1
    new = df.sparkSession.createDataFrame([(-1, dataset_id, version, metrics.get("f1_score"), metrics.get("r2_score"))],
                                          "id long, dataset_id long, version long, f1_score double, r2_score double")
    return result, R.promote_if_better(new, models, deployments, datasets)
