"""Fits of trees: how many rows a task keeps."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from modelkeep.operators import train as M


@pytest.fixture()
def rows(spark):
    """Three groups in one partition, and rows without a weight."""
    df = spark.range(0, 3000, 1, 1).select("id", (F.col("id") % 3).cast("double").alias("x"), ((F.col("id") % 3) * 10 + F.col("id") % 2).cast("double").alias("label"))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(df)


def _parts(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_large_partitions_are_dealt_out(rows, monkeypatch):
    forest = M.make_estimator("forest", "regression", {"numTrees": 3, "maxDepth": 2}, 0)
    assert _parts(M.in_parts(forest, rows)) == [3000]
    monkeypatch.setattr(M, "PART_BYTES", 300 * (M.ROW_BYTES + 4 * M.CELL_BYTES))
    dealt = M.in_parts(forest, rows)
    assert dealt.columns == ["features", "label"] and len(_parts(dealt)) == 10 and max(_parts(dealt)) <= 400
    assert sorted(dealt.collect(), key=str) == sorted(rows.select("features", "label").collect(), key=str)
    wide = M.make_estimator("forest", "regression", {"numTrees": 150, "maxDepth": 2}, 0)
    assert len(_parts(M.in_parts(wide, rows))) > 20
    uneven = rows.where("id < 2990").union(rows.where("id >= 2990").repartition(20))
    assert max(_parts(M.in_parts(forest, uneven))) <= 400
    assert M.in_parts(forest, rows.where("id < 0")).isEmpty()


@pytest.mark.parametrize("kind", ["forest", "boosted_level", "boosted_leaf"])
def test_fits_read_the_parts(rows, monkeypatch, kind):
    """Each fit, and the refit of a search, is given bounded parts and finds the groups' means."""
    seen = []
    real = M.in_parts
    monkeypatch.setattr(M, "in_parts", lambda e, t: seen.append(real(e, t)) or seen[-1])
    monkeypatch.setattr(M, "PART_BYTES", 300 * M.ROW_BYTES)
    setting = {"numTrees": 3, "maxDepth": 2, "rounds": 3, "learningRate": 0.1, "minSplit": 2}
    fit = {"forest": M.fit_forest, "boosted_level": M.fit_boosted_level, "boosted_leaf": M.fit_boosted_leaf}[kind]
    model = fit(rows, "regression", setting)
    best = M.SearchResult(kind, kind, setting, None, None)
    refit = M.refit_full(best, rows.select("x", "label"), "regression", ["x"], [], 0)
    assert len(seen) == 2 and all(len(_parts(p)) >= 10 for p in seen)
    for scored in (model.transform(rows), refit.transform(rows.select("x", "label"))):
        means = {r[0]: r[1] for r in scored.groupBy(F.floor(F.col("label") / 10)).agg(F.avg("prediction")).collect()}
        assert all(abs(means[g] - (g * 10 + 0.5)) < 0.3 for g in (0, 1, 2)), means


def test_kept_frames_are_in_parts(spark, monkeypatch):
    from modelkeep.functions import values as FV
    monkeypatch.setattr(FV, "MOST_ROWS_PER_TASK", 100)
    df = spark.range(0, 3000, 1, 4)
    assert FV.sized(df, 3000).rdd.getNumPartitions() == 30
    assert sorted(r[0] for r in FV.sized(df, 3000).collect()) == list(range(3000))
    monkeypatch.setattr(FV, "MOST_ROWS_PER_TASK", 750)
    assert FV.sized(df, 3000).rdd.getNumPartitions() <= 4
