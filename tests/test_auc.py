"""AUCs over score ranges against counting pairs."""

import random

import pytest
from pyspark.sql import functions as F

from modelkeep.functions.ordered import sums_before
from modelkeep.operators import evaluate as E


@pytest.fixture()
def many_ranges(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def _pairs(rows, positive):
    pos = [s for y, s in rows if y == positive]
    neg = [s for y, s in rows if y != positive]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_sums_of_one_large_and_many_small_groups(spark, many_ranges):
    rows = [("big", float(i), i % 7) for i in range(2000)] + [(f"g{i}", 0.5, i) for i in range(50)] + [("two", 1.0, 3), ("two", 2.0, 4)]
    df = spark.createDataFrame(rows, "g string, x double, w long").repartition(5)
    out = sums_before(df, ["g"], ["x"], ["w"])
    got = {(r["g"], r["x"]): r["w_below"] for r in out.collect()}
    total, wanted = {}, {}
    for g, x, w in sorted(rows):
        wanted[g, x] = total.get(g, 0)
        total[g] = wanted[g, x] + w
    assert got == wanted


def test_one_group_is_spread_over_tasks(spark, many_ranges):
    rows = spark.range(20000).select((F.col("id") / 7).alias("x"), F.lit(1).alias("w"))
    out = sums_before(rows, [], ["x"], ["w"])
    sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 12000
    assert out.where("w_below <> round(x * 7)").isEmpty()


@pytest.mark.parametrize("values", [3, 40, 10**6])
def test_binary_auc_with_ties(spark, many_ranges, values):
    rng = random.Random(values)
    rows = [(rng.choice("ab"), rng.randint(0, values) / values) for _ in range(600)]
    got = E.roc_auc_binary(spark.createDataFrame(rows, "label string, score double"), "b").first()["roc_auc"]
    assert got == pytest.approx(_pairs(rows, "b"), abs=1e-12)


def test_auc_without_a_class_and_without_rows(spark):
    one = spark.createDataFrame([("a", 0.1), ("a", 0.2)], "label string, score double")
    assert E.roc_auc_binary(one, "b").first()["roc_auc"] == 0.0
    assert E.roc_auc_binary(one.where("false"), "b").first()["roc_auc"] == 0.0


def test_one_against_the_rest(spark, many_ranges):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), [round(rng.random(), 1) for _ in range(3)]) for _ in range(500)]
    got = E.roc_auc_ovr(spark.createDataFrame(rows, "label string, scores array<double>"), ["a", "b", "c"]).first()["roc_auc"]
    wanted = sum(_pairs([(y, s[i]) for y, s in rows], c) for i, c in enumerate("abc")) / 3
    assert got == pytest.approx(wanted, abs=1e-12)
