"""Training: the reference's unseen-class fallback test plus ML invariants."""

from pyspark.sql import functions as F

from modelkeep.operators import evaluate as E
from modelkeep.operators import train as M
from modelkeep.sources.tables import load_model, save_model


def test_empty_test_set_fallback(spark, scratch):
    rows = [(1.0, "A", "yes", "r1"), (2.0, "B", "no", "r2"), (3.0, "A", "maybe", "r3"),
            (4.0, "B", "unknown", "r4"), (5.0, "A", "other", "r5")]
    df = spark.createDataFrame(rows, "feat_num double, feat_cat string, label_txt string, key string")
    res = M.auto_train(df, "label_txt", "classification", ["feat_num"], ["feat_cat"], "key",
                       kinds=["logistic", "forest"])
    assert res.best.name in ("Logistic Regression", "Random Forest")
    path = save_model(res.final_model, res.metadata(), scratch("model"))
    pm, meta = load_model(spark, path)
    assert meta["problem_type"] == "classification" and meta["classes"] == sorted(meta["classes"])
    lab = df.withColumn("label", M.label_column(df, "label_txt", res.classes))
    a = [r["prediction"] for r in res.final_model.transform(lab).orderBy("key").collect()]
    b = [r["prediction"] for r in pm.transform(lab).orderBy("key").collect()]
    assert a == b


def test_regression_beats_mean_predictor(spark):
    df = spark.range(400).select(F.col("id").cast("string").alias("k"),
                                 (F.col("id") % 50).cast("double").alias("x"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    df = df.withColumn("y", F.col("x") * 3 + F.when(F.col("c") == "a", 5.0).otherwise(-5.0))
    res = M.auto_train(df, "y", "regression", ["x"], ["c"], "k", kinds=["linear"])
    assert res.best.metrics["r2_score"] > 0.99
    again = M.auto_train(df, "y", "regression", ["x"], ["c"], "k", kinds=["linear"])
    assert again.best.metrics == res.best.metrics  # deterministic


def test_weighted_metrics_hand_case(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    m = E.weighted_metrics(df).first()
    assert abs(m["weighted_precision"] - 0.5833333333) < 1e-6
    assert abs(m["weighted_recall"] - 0.5) < 1e-12
    assert E.accuracy(df).first()["accuracy"] == 0.5


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([("1", 0.5), ("0", 0.5), ("1", 0.9), ("0", 0.1)], "label string, score double")
    assert E.roc_auc_binary(df, "1").first()["roc_auc"] == 0.875
    one = spark.createDataFrame([("1", 0.5), ("1", 0.7)], "label string, score double")
    assert E.roc_auc_binary(one, "1").first()["roc_auc"] == 0.0


def test_constant_target_r2(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, yhat double")
    assert E.regression_metrics(df).first()["r2_score"] == 1.0
    df2 = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, yhat double")
    assert E.regression_metrics(df2).first()["r2_score"] == 0.0
