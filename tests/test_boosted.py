"""Boosted trees from cells: the trees, draws and bins of Spark ML, few jobs, short plans."""

import re

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from modelkeep.operators import boosted as B
from modelkeep.operators import prep as T
from modelkeep.operators import train as M


def _rows(spark, n, parts=2):
    h = lambda i: F.abs(F.xxhash64("id", F.lit(i)))
    df = spark.range(0, n, 1, parts).select("id", (h(0) % 1000 / 10.0 - 20).alias("a"), (h(1) % 7).cast("double").alias("b"),
                                            (h(2) % 3 == 0).cast("double").alias("c"), F.lit(0.0).alias("z"), (h(3) % 1000 / 250.0).alias("u"))
    df = df.withColumn("y", F.sin("a") * 3 + F.col("b") * F.col("c") + F.col("u")).withColumn("k", (F.col("y") > 3).cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c", "z"], outputCol="features").transform(df).persist()


def _text(model):
    """The trees with numbers to 6 digits."""
    body = model.toDebugString.split("\n", 1)[1]
    return re.sub(r"-?\d+\.\d+(E-?\d+)?", lambda m: f"{float(m[0]):.6g}", body)


def test_generator_is_sparks(spark):
    own = spark._jvm.org.apache.spark.util.random.XORShiftRandom(0)
    own.setSeed(45)
    assert B.draws([7, 45], 300, run=64)[1].tolist() == [own.nextDouble() for _ in range(300)]
    assert B.first_int(42) == spark._jvm.org.apache.spark.util.random.XORShiftRandom(42).nextInt()


@pytest.mark.parametrize("kind,problem,n", [("boosted_level", "regression", 12_000), ("boosted_leaf", "classification", 1500)])
def test_trees_are_those_of_spark_ml(spark, kind, problem, n):
    """The same trees, by jobs that don't grow with the rounds."""
    rows = _rows(spark, n).withColumn("label", F.col("y" if problem == "regression" else "k")).select("features", "label")
    jobs = lambda: int(spark.range(1).rdd.context._jsc.sc().dagScheduler().nextJobId())
    est = M.make_estimator(kind, problem, {"rounds": 6, "maxDepth": 4, "learningRate": 0.1}, n, 2)
    own, before = est.fit(rows), jobs()
    got = M.fitted(est, rows)
    assert jobs() - before < 25
    assert got.getNumTrees == 6 and list(got.treeWeights) == list(own.treeWeights) and len(got.trees) == 6
    a, b = ([r[0] for r in m.transform(rows).select("prediction").collect()] for m in (own, got))
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-9
    assert _text(got).split("Tree 1")[0] == _text(own).split("Tree 1")[0]


def test_rows_spark_refuses_and_fits_too_large_are_sparks(spark, monkeypatch, scratch):
    rows = _rows(spark, 300).withColumn("label", F.col("k")).select("features", "label")
    est = M.make_estimator("boosted_level", "classification", {"rounds": 2, "maxDepth": 2, "learningRate": 0.1}, 0, 2)
    assert B.fit(est, rows.withColumn("label", F.lit(2.0))) is None
    assert B.fit(est, rows.withColumn("label", F.when(F.col("label") == 1, 1.0))) is None
    assert B.fit(est, rows.where("label > 5")) is None
    model, path = B.fit(est, rows), scratch("boosted-model")
    model.write().save(path)
    assert _text(type(est.fit(rows)).load(path)) == _text(model)
    monkeypatch.setattr(B, "MOST_CELLS", 10)
    assert B.fit(est, rows) is None and M.fitted(est, rows).getNumTrees == 2


def test_a_search_reads_short_plans_and_least_squares_keeps_no_copies(spark, monkeypatch):
    rows = _rows(spark, 400).select(F.col("id").cast("string").alias("key"), "a", "b", "y")
    seen, real = [], M.written
    monkeypatch.setattr(M, "written", lambda df, name: seen.append(name) or real(df, name))
    run = M.auto_train(rows, "y", "regression", ["a", "b"], [], "key", kinds=["linear"])
    assert seen == [] and run.best.name == "Linear Regression"
    frame = M._kept(rows.withColumn("c", F.col("a") + 1).groupBy("a").agg(F.sum("c").alias("c")))
    assert seen == ["kept"] and "Aggregate" not in frame._jdf.queryExecution().toString()
    train, test, whole = T.split_written(rows, "key", whole=True, with_key=False)
    assert whole.columns == ["a", "b", "y"] and whole.count() == train.count() + test.count() == 400
