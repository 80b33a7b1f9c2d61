"""Drift tests: the reference's two unit tests plus statistics checks."""

import math

from pyspark.sql import functions as F

from modelkeep.functions import pvalues as PV
from modelkeep.operators import drift as D


def test_drift_insufficient_data(spark):
    ref = spark.createDataFrame([(float(i), "AB"[i % 2]) for i in range(1, 11)],
                                "feature_1 double, feature_2 string")
    cur = spark.createDataFrame([(1.0, "A"), (2.0, "B"), (3.0, "A")], "feature_1 double, feature_2 string")
    feats, summary = D.drift_report(ref, cur, threshold=0.3)
    s = summary.first()
    assert s["drift_score"] == 0.0 and s["has_drift"] is False
    assert feats.count() == 0
    assert "Insufficient production data" in s["message"]


def test_drift_calculation(spark):
    base = [1.0, 2.0, 1.5, 2.5, 1.8, 2.2, 1.9, 2.1, 1.7, 2.3] * 5
    cats = ["A", "B"] * 25
    ref = spark.createDataFrame(list(zip(base, cats)), "feature_1 double, feature_2 string")
    cur = spark.createDataFrame(list(zip([10 * x for x in base], cats)), "feature_1 double, feature_2 string")
    feats, summary = D.drift_report(ref, cur, threshold=0.3)
    rows = {r["feature"]: r for r in feats.collect()}
    assert rows["feature_1"]["drift_detected"] is True and rows["feature_1"]["statistic"] == 1.0
    assert rows["feature_2"]["drift_detected"] is False
    assert rows["feature_2"]["test_name"] == D.TEST_Z and rows["feature_2"]["statistic"] == 0.0
    s = summary.first()
    assert s["drift_score"] == 0.5 and s["has_drift"] is True
    assert s["message"].startswith("Drift check complete. 1 of 2 features drifted (ratio: 0.50)")


def test_pvalue_functions():
    assert abs(PV.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(PV.chi2_sf(11.070497693516351, 5) - 0.05) < 1e-9
    assert abs(PV.normal_two_sided(1.959963984540054) - 0.05) < 1e-12
    assert PV.chi2_sf(float("inf"), 3) == 0.0
    assert PV.ks_asymptotic(0.05, 10, 10) == 1.0
    assert abs(PV.ks_asymptotic(0.5, 100, 100) - 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * 12.5)
                                                       for k in range(1, 101))) < 1e-12


def test_large_branch_tests_and_median_fill(spark):
    ref = spark.range(2000).select((F.col("id") % 97).cast("double").alias("x"),
                                   F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"),
                                   F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 7)
                                   .cast("double").alias("g"))
    cur = spark.range(1500).select(((F.col("id") % 97) + 30).cast("double").alias("x"),
                                   F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"),
                                   (F.col("id") % 7).cast("double").alias("g"))
    rows = {r["feature"]: r for r in D.feature_drift(ref, cur).collect()}
    assert rows["x"]["test_name"] == D.TEST_WASSERSTEIN and rows["x"]["drift_detected"]
    assert rows["c"]["test_name"] == D.TEST_JS
    # shares of a: 667/2000 vs 1/2 -> JS distance
    p, q = [667 / 2000, 1333 / 2000], [0.5, 0.5]
    h = [(a + b) / 2 for a, b in zip(p, q)]
    js = math.sqrt(0.5 * sum(a * math.log(a / m) for a, m in zip(p, h)) +
                   0.5 * sum(b * math.log(b / m) for b, m in zip(q, h)))
    assert abs(rows["c"]["statistic"] - js) < 1e-6
    assert rows["g"]["n_ref"] == 2000  # nulls were filled, not dropped


def test_drift_partition_invariance(spark):
    from tests.conftest import SF_SMALL
    from modelkeep.sources.fixtures import v_drift_large
    ref, cur = v_drift_large(spark, SF_SMALL)
    a = sorted((r["feature"], round(r["statistic"], 9)) for r in D.feature_drift(ref.coalesce(1), cur.coalesce(1)).collect())
    b = sorted((r["feature"], round(r["statistic"], 9)) for r in D.feature_drift(ref.repartition(16), cur.repartition(16)).collect())
    assert a == b
