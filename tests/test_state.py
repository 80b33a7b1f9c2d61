"""State changes of the composed plans: rows appended, snapshots, events."""

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from modelkeep.plans import lifecycle as L
from modelkeep.sources.tables import load_model, read_table


def registry(spark):
    models = spark.createDataFrame([(0, 0, "DONE", "Random Forest", 0.1, None, 1, "churn_v1"), (1, 0, "DONE", "Random Forest", 0.2, None, 2, "churn_v2")],
                                   "id long, dataset_id long, status string, algorithm string, f1_score double, r2_score double, version long, model_name string")
    deps = spark.createDataFrame([(0, 0, "active", 0.3, 0.7), (1, 1, "active", 0.9, 0.7)],
                                 "id long, model_id long, status string, drift_threshold double, performance_threshold double")
    ds = spark.createDataFrame([(0, "churn.csv", "classification", "churn")], "id long, name string, problem_type string, target_column string")
    return models, deps, ds


def churn(spark):
    return spark.range(80).select("id", (F.col("id") % 40).alias("age"), F.when(F.col("id") % 2 == 0, "M").otherwise("F").alias("gender"),
                                  F.when(F.col("id") % 40 > 20, "yes").otherwise("no").alias("churn"))


def test_every_active_deployment_is_monitored_and_stored(spark, scratch):
    models, deps, ds = registry(spark)
    log = spark.range(60).select(F.col("id").alias("prediction_id"), (F.col("id") % 2).alias("deployment_id"),
                                 F.to_json(F.struct((F.col("id") + 90).alias("age"), F.lit("Z").alias("gender"))).alias("input_json"))
    reports, features, requests = L.drift_monitors(deps, models, ds, {0: churn(spark).select("age", "gender", "churn")}, log)
    assert {r["deployment_id"]: r["has_drift"] for r in reports.collect()} == {0: True, 1: True}
    assert {(r["deployment_id"], r["feature"]) for r in features.collect()} == {(d, f) for d in (0, 1) for f in ("age", "gender")}
    root = scratch("state")
    L.store_monitoring(root, reports, requests, deps)
    L.store_monitoring(root, reports, requests, deps)
    stored = read_table(spark, f"{root}/drift_reports")
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4
    events = read_table(spark, f"{root}/audit_log").collect()
    assert len(events) == 4 and all(e["severity"] == "WARNING" and "Triggering auto-retraining" in e["message"] for e in events)
    assert read_table(spark, f"{root}/model_requests").count() == 2 * requests.count()


def test_dataset_and_custom_training_are_stored(spark, scratch):
    models, deps, ds = registry(spark)
    df, root = churn(spark), scratch("state")
    for _ in range(2):
        L.store_dataset(root, L.register_dataset(df, "churn.csv"))
    rows = read_table(spark, f"{root}/datasets").collect()
    assert len({r["id"] for r in rows}) == 2 and json.loads(rows[0]["features_metadata"])["gender"]["type"] == "categorical"
    dp = L.DatasetProfile("churn", "classification", 80, 4, df, "", ["age"], ["gender"])
    only = deps.where("id = 0")
    result, decision = L.train_custom(LogisticRegression(maxIter=20), df, dp, "id", models, only, ds, 0)
    decided = decision.first()
    assert decided["promoted"] == (decided["new_metric"] > 0.1)
    model_id, after = L.store_training(root, result, 0, 3, "churn_custom_v3", only, decision)
    model, meta = load_model(spark, f"{root}/artifacts/{model_id}")
    assert meta["classes"] == ["no", "yes"] and model.transform(df).count() == 80
    active = {r["model_id"] for r in after.where("status = 'active'").collect()}
    assert active == ({model_id} if decided["promoted"] else {0})
    assert read_table(spark, f"{root}/models").first()["f1_score"] == result.best.metrics["f1_score"]
    assert {e["event_type"] for e in read_table(spark, f"{root}/audit_log").collect()} == {"DATASET", "TRAINING", "PROMOTION"}
