"""Faults found in review: ids, folds, JSON keys, caches, feedback."""

import pytest
from pyspark.sql import functions as F

from modelkeep.operators import drift as D
from modelkeep.operators import registry as R
from modelkeep.operators import train as M
from modelkeep.plans import lifecycle as L
from modelkeep.session import checkpoint_root
from modelkeep.sources import tables as S
from modelkeep.streaming import streams as X


def test_ids_go_on_after_zero(spark, scratch):
    path = scratch("ids")
    for k in range(4):
        S.write_table(spark.createDataFrame([(k,)], "v long").coalesce(1), path)
    ids = sorted(r["id"] for r in S.read_table(spark, path).collect())
    assert len(set(ids)) == 4
    assert R.next_record_id(spark.createDataFrame([(0,)], "id long")) == 1
    assert R.next_record_id(spark.createDataFrame([], "id long")) == 0


def test_two_folds_and_stratified_folds(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("x"),
                                F.when(F.col("id") < 3, "rare").otherwise("common").alias("y"))
    res = M.auto_train(df, "y", "classification", ["x"], [], "k", kinds=["logistic"])
    assert res.best.cv_metric is None or 0 <= res.best.cv_metric <= 1
    marked = M.with_folds(df, "k", 3, 40, "y")
    per = {(r["y"], r["fold"]): r["count"] for r in marked.groupBy("y", "fold").count().collect()}
    assert all(per["rare", f] == 1 and 12 <= per["common", f] <= 13 for f in range(3))
    many = M.with_folds(df, "k", 2, 10 * M.ROWS_PER_FOLD_BUCKET, "y").groupBy("y", "fold").count().collect()
    assert {r["count"] for r in many if r["y"] == "common"} <= {18, 19}


def test_preparation_is_fitted_once_per_fold(spark, monkeypatch):
    made = []
    fit = M.feature_pipeline
    monkeypatch.setattr(M, "feature_pipeline", lambda *a: made.append(a) or fit(*a))
    df = spark.range(60).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    M.auto_train(df, "y", "classification", ["x"], [], "k", kinds=["logistic", "forest"])
    assert len(made) == 2  # the folds' (fitted once each) and the last refit's


def test_formatted_numbers_are_coerced_before_training(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("$"), F.col("id")).alias("x"), (F.col("id") * 2.0).alias("y"))
    res = M.auto_train(df, "y", "regression", ["x"], [], "k", kinds=["linear"])
    assert res.best.metrics["r2_score"] > 0.99


def test_json_keys_of_any_characters(spark):
    log = spark.createDataFrame([('{"a,b":1,"c<d":2.5,"e":3}',), ('{"e":null,"f g":"t","h":[1]}',), ("broken",)], "input_json string")
    got = S.scan_inputs_json(log)
    assert sorted(got.columns) == ["a,b", "c<d", "e", "f g", "h"]
    rows = [r.asDict() for r in got.collect()]
    assert {"a,b": 1, "c<d": 2.5, "e": 3, "f g": None, "h": None} in rows
    assert {"a,b": None, "c<d": None, "e": None, "f g": "t", "h": "[1]"} in rows


def test_wide_integers_become_doubles(spark, scratch):
    path = scratch("wide")
    S.write_csv(spark.createDataFrame([("12345678901234567890123", "1"), ("1", "2")], "a string, b string"), path)
    got = S.scan_csv(spark, path)
    assert dict(got.dtypes) == {"a": "double", "b": "bigint"} and got.where("a IS NULL").count() == 0


def test_a_drift_report_leaves_nothing_cached(spark):
    spark.catalog.clearCache()
    persistent = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = persistent()
    ref = spark.range(1200).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    feats, summary = D.drift_report(ref, ref.where("x > 100"))
    assert feats.count() == 2 and summary.count() == 1 and persistent() == before


def test_tests_with_p_values_at_any_reference_size(spark):
    ref = spark.range(3000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("b"), (F.col("id") % 7).cast("string").alias("c"))
    _, aligned, tests = D.prepared_counts(ref, ref.where("x < 2000"))
    assert [r["feature"] for r in D.drift_ks(aligned, tests).collect()] == ["x"]
    assert [r["feature"] for r in D.drift_chi2(aligned, tests).collect()] == ["c"]
    assert [r["feature"] for r in D.drift_z(aligned, tests).collect()] == ["b"]


def test_a_corrected_label_counts_once(spark):
    rows = [(1, "A", 1), (1, "B", 2), (2, "A", 1)]
    pairs = spark.createDataFrame(rows, "prediction_id long, actual string, received_at long")
    got = {r["prediction_id"]: r["actual"] for r in X.latest_labels(pairs).collect()}
    assert got == {1: "B", 2: "A"}


def test_all_metrics_and_jobs_not_done(spark):
    models = spark.createDataFrame([(1, "DONE", 0.5, 0.25, 3.0, 1), (2, "FAILED", None, None, None, 2), (3, "PENDING", None, None, None, 3)],
                                   "id long, status string, accuracy double, roc_auc double, mae double, created_at long")
    assert {r["metric"]: r["value"] for r in R.explode_metrics(models).collect()} == {"Accuracy": 50, "Roc Auc": 25, "Mae": 300}
    assert [r["id"] for r in R.jobs_not_done(models).collect()] == [3, 2]


def test_retraining_with_feedback_when_the_key_is_a_feature(spark):
    df = spark.range(60).select("id", (F.col("id") % 9).alias("x"), F.when(F.col("id") % 2 == 0, "yes").otherwise("no").alias("y"))
    models = spark.createDataFrame([(1, 0, "DONE", "a", 0.5, None, 1, "m")], "id long, dataset_id long, status string, algorithm string, f1_score double, "
                                   "r2_score double, version long, model_name string")
    deps = spark.createDataFrame([(0, 1, "active", 0.3, 0.7)], "id long, model_id long, status string, drift_threshold double, performance_threshold double")
    ds = spark.createDataFrame([(0, "d", "classification", "y")], "id long, name string, problem_type string, target_column string")
    dp = L.DatasetProfile("y", "classification", 60, 3, df, "", ["id", "x"], [])
    log = spark.createDataFrame([(101, 0, '{"id": 7, "x": 3}', "yes")], "prediction_id long, deployment_id long, input_json string, actual string")
    result, _ = L.run_retraining(df, dp, "id", log, models, deps, ds, 0, kinds=["logistic"])
    assert result.best.name == "Logistic Regression"


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_the_log_holds_inputs_as_they_came_in(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10.0).alias("x"), (F.col("id") * 2.0).alias("y"))
    res = M.auto_train(df, "y", "regression", ["x"], [], "k", kinds=["linear"])
    pred = L.score_batch(res.final_model, df, None)
    assert pred.where("abs(x - k * 10.0) > 1e-9").count() == 0
    from modelkeep.operators import scoring
    logged = scoring.log_predictions(pred, 1, ["x"]).select(F.get_json_object("input_json", "$.x").cast("double").alias("x"))
    assert logged.agg(F.max("x")).first()[0] == 490.0
