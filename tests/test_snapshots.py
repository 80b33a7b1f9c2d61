"""Snapshot tables: whole versions, ids, replays, and writers at the same time."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from modelkeep.functions.ordered import positions
from modelkeep.operators import prep as T
from modelkeep.operators import registry as R
from modelkeep.plans import lifecycle as L
from modelkeep.sources.snapshots import SnapshotTable
from modelkeep.sources.tables import read_table, write_table


def test_appends_versions_and_replays(spark, scratch):
    t = SnapshotTable(spark, scratch("t"))
    assert t.version() == -1 and t.read() is None
    first = t.append(spark.range(5).select(F.col("id").alias("v")).repartition(3), "a")
    assert first.count() == 5
    again = t.append(spark.range(99).select(F.col("id").alias("v")), "a")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect())) and t.version() == 0
    t.append(spark.range(3).select(F.col("id").alias("v"), F.lit("x").alias("more")), "b")
    rows = t.read().collect()
    assert len(rows) == 8 and len({r["id"] for r in rows}) == 8 and sum(r["more"] == "x" for r in rows) == 3
    assert t.read(0).count() == 5 and "more" not in t.read(0).columns
    assert max(r["id"] for r in first.collect()) < min(r["id"] for r in rows if r["more"] == "x")
    t.append(spark.range(0).select(F.col("id").alias("v")))
    t.update(lambda df: df.where("v < 2"))
    assert sorted(r["v"] for r in t.read().collect()) == [0, 0, 1, 1]
    after = t.append(spark.createDataFrame([(7,)], "v long")).first()["id"]
    assert after > max(r["id"] for r in rows)
    kept = sorted((r["id"], r["v"]) for r in t.read().collect())
    t.compact()
    assert sorted((r["id"], r["v"]) for r in t.read().collect()) == kept and len(t.manifest()["entries"]) == 1
    with pytest.raises(ValueError, match="is bigint"):
        t.append(spark.createDataFrame([("7",)], "v string"))
    write_table(spark.createDataFrame([(1,)], "v long"), scratch("w"), mode="overwrite")
    with pytest.raises(ValueError, match="no records"):
        read_table(spark, scratch("none"))


def test_writers_at_the_same_time_get_ids_of_their_own(spark, scratch):
    path = scratch("t")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda k: write_table(spark.range(20).select(F.lit(k).alias("writer")), path), range(6)))
    rows = read_table(spark, path).collect()
    assert len(rows) == 120 and len({r["id"] for r in rows}) == 120
    assert SnapshotTable(spark, path).version() == 5


def _promotion(spark):
    models = spark.createDataFrame([(0, 0, "DONE", "x", 0.1, None, 1, "m0"), (1, 0, "DONE", "x", 0.5, None, 2, "m1"), (2, 0, "DONE", "x", 0.7, None, 3, "m2")],
                                   "id long, dataset_id long, status string, algorithm string, f1_score double, r2_score double, version long, model_name string")
    deps = spark.createDataFrame([(0, 0, "active", 0.3, 0.7)], "id long, model_id long, status string, drift_threshold double, performance_threshold double")
    ds = spark.createDataFrame([(0, "d.csv", "classification", "y")], "id long, name string, problem_type string, target_column string")
    return models, deps, ds


def test_two_promotions_of_one_dataset_leave_one_active_deployment(spark, scratch):
    models, deps, ds = _promotion(spark)
    new = models.where("id > 0").select("id", "dataset_id", "version", "f1_score", "r2_score")
    once = R.apply_promotions(deps, R.promote_if_better(new, models, deps, ds)).collect()
    assert [r["model_id"] for r in once if r["status"] == "active"] == [2] and len({r["id"] for r in once}) == len(once) == 2
    table = SnapshotTable(spark, scratch("deployments"))
    table.append(deps, "first")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: R.commit_promotions(table, lambda d: R.promote_if_better(new.where(F.col("id") == k), models, d, ds), f"model={k}"), (1, 2)))
    rows = table.read().collect()
    assert [r["model_id"] for r in rows if r["status"] == "active"] == [2] and len({r["id"] for r in rows}) == len(rows)
    R.commit_promotions(table, lambda d: R.promote_if_better(new.where("id = 2"), models, d, ds), "model=2")
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows))
    R.commit_thresholds(table, performance=0.9)
    R.commit_active(table, models, 0)
    rows = table.read().collect()
    assert [(r["model_id"], r["performance_threshold"]) for r in rows if r["status"] == "active"] == [(0, 0.7)]
    assert [r["performance_threshold"] for r in rows if r["model_id"] == 2] == [0.9]


def test_a_label_enters_training_once(spark, scratch):
    log = spark.createDataFrame([(k, k % 2, f'{{"x": {k}}}', "yes" if k % 3 else None) for k in range(30)],
                                "prediction_id long, deployment_id long, input_json string, actual string")
    root = scratch("ledger")
    early = log.where("prediction_id < 10")
    one = L.consume_feedback(root, early, "1")
    labels = lambda df: sorted((r["prediction_id"], r["actual"]) for r in df.collect())
    want = labels(log.where("actual IS NOT NULL").select("prediction_id", "actual"))
    assert labels(one) == [w for w in want if w[0] < 10]
    assert labels(L.consume_feedback(root, early, "2")) == labels(one)
    assert labels(L.consume_feedback(root, log, "3")) == want
    assert labels(L.consume_feedback(root, log.withColumn("actual", F.lit("no")), "3")) == want
    data = L.training_set(spark.range(5).select("id", F.col("id").alias("x"), F.lit("yes").alias("y")), "y", "id", L.consume_feedback(root, log, "4"))
    assert data.count() == 5 + len(want)


# ------------------------------------------------------------------ positions
def test_positions_spread_ties_of_the_first_column(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), F.lit(1.0).alias("score"), (F.col("id") * 7919 % 4001).alias("k"), F.col("id"))
    got = positions(df.repartition(5), [F.col("score").desc(), F.col("k")], name="rank")
    rows = sorted((r["rank"], r["k"]) for r in got.collect())
    assert [r for r, _ in rows] == list(range(1, 4001)) and [k for _, k in rows] == sorted(k for _, k in rows)
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = positions(df, [F.col("score"), F.col("k")], ["g"])
        for g in (0, 1):
            own = sorted((r["position"], r["k"]) for r in dealt.where(F.col("g") == g).collect())
            assert [p for p, _ in own] == list(range(1, 2001)) and [k for _, k in own] == sorted(k for _, k in own)
        same = spark.range(1000).select(F.lit("x").alias("a"))
        ranked = positions(same, [F.col("a")])
        assert sorted(r["position"] for r in ranked.collect()) == list(range(1, 1001))
        assert len([f for f in ranked.inputFiles()]) > 4  # rows tied on everything are many tasks
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    assert positions(df.limit(0), [F.col("k")]).count() == 0
    nulls = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "g string, k int")
    assert sorted((r["g"] or "", r["k"], r["position"]) for r in positions(nulls, [F.col("k")], ["g"]).collect()) == [("", 1, 1), ("", 2, 2), ("a", 1, 1)]


def test_label_dictionary_is_a_table(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("label "), (F.col("id") % 1500).cast("string")).alias("y"))
    labels = T.encode_labels(df, "y")
    names = sorted({f"label {k}" for k in range(1500)})
    assert [r["label"] for r in labels.orderBy("idx").collect()] == names
    rows = T.with_label_index(df.unionByName(spark.createDataFrame([(-1, "new")], "id long, y string")), "y", labels)
    got = {r["id"]: r["label"] for r in rows.collect()}
    assert got[-1] is None and all(names[got[k]] == f"label {k % 1500}" for k in range(3000))
    back = T.with_label_text(rows.withColumn("raw", F.coalesce("label", F.lit(99_999)).cast("double")), "raw", labels)
    assert back.where("id >= 0 AND prediction <> y").count() == 0 and back.where("id = -1").first()["prediction"] == "99999"


def test_long_texts_are_counted_by_digest(spark):
    from modelkeep.functions.values import column_profile
    long = "x" * 100_000
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",), ("https://a.b/" + long,), ("short",), ("s" * 32,), ("s" * 33,), (None,), ("",)], "t string")
    row = column_profile(df).first()
    assert (row["n_rows"], row["non_null"], row["n_unique"]) == (9, 8, 7) and row["url_ratio"] == pytest.approx(1 / 8)
    plan = column_profile(df)._jdf.queryExecution().toString()
    assert "md5" in plan and plan.count("Exchange hashpartitioning") == 2
