"""Preparation stages, the ordered-sum helper and the reference's
preprocessor test."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from modelkeep.functions.ordered import exact_median, running_sums
from modelkeep.operators import prep as T


def test_build_preprocessor(spark):
    df = spark.createDataFrame([(1.0, "A"), (2.0, "B"), (None, "A")], "feat_num double, feat_cat string")
    model = T.feature_pipeline(["feat_num"], ["feat_cat"]).fit(df)
    rows = [r["f"] for r in model.transform(df).select(vector_to_array("features").alias("f")).collect()]
    assert len(rows) == 3 and all(len(r) == 3 for r in rows)
    assert all(x == x for r in rows for x in r)  # no NaN
    # median of {1, 2} is 1.5 -> imputed row scales to 0
    assert abs(rows[2][0]) < 1e-12


def test_exact_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (4.0,)], "x double")
    m = T.MedianImputer(inputCols=["x"]).fit(df)
    assert m.getOrDefault(m.fills) == [2.5]


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    m = T.ModeImputer(inputCols=["c"]).fit(df)
    assert m.getOrDefault(m.fills) == ["a"]
    assert [r["c"] for r in m.transform(df).collect()][-1] == "a"


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    m = T.PopulationScaler(inputCols=["x"]).fit(df)
    assert abs(m.getOrDefault(m.scales)[0] - 1.247219128924647) < 1e-12
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert T.PopulationScaler(inputCols=["x"]).fit(const).transform(const).first()["x"] == 0.0


def test_capped_onehot_order_and_unknown(spark):
    # 60 categories: c00 x60, c01 x59, ... ; the 49 most frequent stay
    rows = [(f"c{i:02d}",) for i in range(60) for _ in range(60 - i)]
    df = spark.createDataFrame(rows, "v string")
    cats = T.capped_categories(df, ["v"]).collect()
    freq = sorted(r["category"] for r in cats if r["frequent"])
    assert freq == [f"c{i:02d}" for i in range(49)]
    assert {r["slot"] for r in cats if not r["frequent"]} == {49}
    model = T.CappedOneHot(inputCols=["v"]).fit(df)
    probe = spark.createDataFrame([("c00",), ("c55",), ("zzz",)], "v string")
    out = model.transform(probe)
    oh = [c for c in out.columns if c.startswith("__oh")]
    assert len(oh) == 50
    vals = [[r[c] for c in oh] for r in out.collect()]
    assert vals[0][0] == 1.0 and sum(vals[0]) == 1.0
    assert vals[1][-1] == 1.0 and sum(vals[1]) == 1.0     # infrequent slot
    assert sum(vals[2]) == 0.0                            # unknown -> zeros


def test_onehot_tells_rare_from_unseen_at_any_number(spark, scratch):
    rows = spark.range(12_000).select(F.concat(F.lit("r"), F.col("id")).alias("v")).unionAll(
        spark.range(500).select(F.concat(F.lit("f"), F.col("id") % 49).alias("v")))
    model = T.CappedOneHot(inputCols=["v"]).fit(rows)
    probe = spark.createDataFrame([("r7",), ("never_seen",), (None,), ("f3",)], "v string")
    path = scratch("onehot")
    model.write().overwrite().save(path)
    for m in (model, T.CappedOneHotModel.load(path)):
        out = {r["v"]: r["__oh0_rare"] for r in m.transform(probe).collect()}
        assert out == {"r7": 1.0, "never_seen": 0.0, None: 0.0, "f3": 0.0}


def test_onehot_tie_keeps_larger_category(spark):
    rows = [(f"k{i:02d}",) for i in range(51)]  # all counts tie
    model = T.CappedOneHot(inputCols=["v"]).fit(spark.createDataFrame(rows, "v string"))
    assert model.getOrDefault(model.categories)[0] == [f"k{i:02d}" for i in range(2, 51)]


def test_running_sums_bucketed_equals_window(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.pmod(F.hash("id"), 997)).cast("double").alias("v"),
                                  F.lit(1).alias("w"))
    df = df.groupBy("g", "v").agg(F.sum("w").alias("w"))
    plain = running_sums(df, ["g"], ["v"], ["w"], with_next=True)
    bucketed = running_sums(df, ["g"], ["v"], ["w"], with_next=True, max_rows_per_bucket=40)
    key = lambda r: (r["g"], r["v"])
    a = sorted((r["g"], r["v"], r["w_cum"], r["v_next"]) for r in plain.collect())
    b = sorted((r["g"], r["v"], r["w_cum"], r["v_next"]) for r in bucketed.collect())
    assert a == b
    win = Window.partitionBy("g").orderBy("v")
    ref = sorted((r["g"], r["v"], r["c"]) for r in df.select("g", "v", F.sum("w").over(win).alias("c")).collect())
    assert [x[:3] for x in a] == ref
    med = {r["g"]: r["median"] for r in exact_median(df.withColumnRenamed("v", "value").withColumnRenamed("w", "n"),
                                                     ["g"], max_rows_per_bucket=50).collect()}
    truth = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.percentile("v", 0.5, F.col("w")).alias("m")).collect()}
    assert med == truth
    del key


def test_split_is_deterministic(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    tr1, te1 = T.split_train_test(df.coalesce(1), "k")
    tr2, te2 = T.split_train_test(df.repartition(7), "k")
    assert sorted(r["k"] for r in te1.collect()) == sorted(r["k"] for r in te2.collect())
    assert 150 < te1.count() < 250


def test_pipeline_persists(spark, scratch):
    df = spark.createDataFrame([(1.0, "A"), (2.0, "B"), (None, "A"), (7.0, None)], "x double, c string")
    model = T.feature_pipeline(["x"], ["c"]).fit(df)
    path = scratch("pipe")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = [r["f"] for r in model.transform(df).select(vector_to_array("features").alias("f")).collect()]
    b = [r["f"] for r in again.transform(df).select(vector_to_array("features").alias("f")).collect()]
    assert a == b
