"""The bounded first-values aggregate against sorting, and its plan."""

import math
import random

from pyspark.sql import functions as F

from modelkeep.functions.smallest import first_of_each
from modelkeep.functions.values import spread
from modelkeep.operators import profile as P
from modelkeep.sources.tables import table


def _wanted(rows, key, column, k):
    def order(r):
        return [(v is not None, isinstance(v, float) and math.isnan(v), 0 if v is None or (isinstance(v, float) and math.isnan(v)) else v)
                for v in (r[c] for c in key)] + [r[column]]
    return [r[column] for r in sorted((r for r in rows if r[column] is not None), key=order)[:k]]


def _frame(spark, n=3000):
    rng = random.Random(4)
    rows = [(rng.choice([None, math.nan, *[float(x) for x in range(12)]]), rng.choice([None, "k1", "k2", "é"]), f"v{rng.randint(0, 9)}",
             rng.choice([None] * 200 + ["rare"]) if i % 3 else None, None, rng.choice(["", None])) for i in range(n)]
    return spark.createDataFrame(rows, "f double, s string, dense string, sparse string, never string, empty string").repartition(6)


def test_first_values_equal_sorting(spark):
    df = _frame(spark)
    rows = [r.asDict() for r in df.collect()]
    for key in (["f"], ["s", "f"], ["f", "s"]):
        for k in (1, 3, 20):
            got = {}
            for r in first_of_each(df, key, {c: F.col(c) for c in ("dense", "sparse", "never", "empty")}, k).orderBy("column", "rn").collect():
                got.setdefault(r["column"], []).append(r["value"])
                assert r["rn"] == len(got[r["column"]])
            assert got == {c: w for c in ("dense", "sparse", "never", "empty") if (w := _wanted(rows, key, c, k))}


def test_no_rows_and_keys_of_other_types(spark):
    df = _frame(spark, 200)
    assert P.first_values(df.where("f < -1"), ["f"], 3).count() == 0
    typed = df.select(F.col("dense"), (F.length("dense") > 1).alias("b"), F.to_date(F.lit("2020-01-01")).alias("d"), F.lit(1).cast("decimal(9,2)").alias("m"))
    assert [r["value"] for r in P.first_values(typed, ["b", "d", "m"], 2, ["dense"]).orderBy("rn").collect()] == ["v0", "v0"]


def test_the_scan_neither_unpivots_nor_ranks(spark):
    plan = P.first_values(table(spark, "/root/testdata/sf0.001", "lineitem"), ["l_orderkey"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan and plan.count("Relation [") == 1


def test_spread_asks_nodes_not_names(spark, scratch):
    path = scratch("Sorted Join")
    spark.range(1000).select(F.col("id").alias("Sort Union")).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    assert spread(one.where("`Sort Union` > 3")).rdd.getNumPartitions() == 4
    assert spread(one.repartition(2)).rdd.getNumPartitions() == 2
    grouped = one.groupBy("Sort Union").count()
    assert spread(grouped) is grouped
