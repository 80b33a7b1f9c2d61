"""Profiling and quality rules, including the reference's inspect test."""

from pyspark.sql import functions as F

from modelkeep.functions.values import column_profile
from modelkeep.operators import profile as P
from modelkeep.operators import quality as Q

NAN = float("nan")


def _inspect(spark):
    rows = [(1.0, "A", None, "yes"), (2.0, "B", None, "no"), (NAN, "A", None, "yes"),
            (4.0, None, None, "no"), (5.0, "B", None, "yes")]
    return spark.createDataFrame(rows, "feat_num double, feat_cat string, all_null double, label string")


def test_inspect_dataset_classification(spark):
    df = _inspect(spark)
    target = P.resolve_target(df, "label")
    assert target == "label"
    assert P.infer_problem_type(df, target).first()["problem_type"] == "classification"
    meta = {r["column"]: r for r in P.profile_features(P.coerce_numeric(df), target).collect()}
    assert meta["feat_num"]["type"] == "numerical" and meta["feat_num"]["null_count"] == 1
    assert meta["feat_cat"]["type"] == "categorical" and meta["feat_cat"]["null_count"] == 1
    assert "all_null" not in meta
    assert meta["feat_num"]["mean"] == 3.0


def test_coerce_threshold_both_sides(spark):
    # 4 of 5 parse (0.8) -> coerced; 3 of 5 -> kept
    rows = [("₹599", "1,000"), ("$1,234.50", "x"), ("12%", "y"), ("€ 7", "5"), ("oops", "6")]
    df = spark.createDataFrame(rows, "a string, b string")
    rep = {r["column"]: r for r in P.coerce_report(df).collect()}
    assert rep["a"]["coerced"] and rep["a"]["parse_ratio"] == 0.8
    assert not rep["b"]["coerced"]
    out = P.coerce_numeric(df)
    assert dict(out.dtypes)["a"] == "double" and dict(out.dtypes)["b"] == "string"
    assert sorted(r["a"] for r in out.collect() if r["a"] is not None) == [7.0, 12.0, 599.0, 1234.5]


def test_ignorable_thresholds(spark):
    n = 200
    df = spark.range(n).select(
        F.col("id").alias("num_id"),                                  # 200 distinct > 100, ratio 1
        (F.col("id") % 100).alias("num_100"),                         # 100 distinct: not > 100
        F.concat(F.lit("u"), (F.col("id") % 150).cast("string")).alias("txt"),  # 150/200=0.75 > 0.7
        F.concat(F.lit("u"), (F.col("id") % 50).cast("string")).alias("txt50"),  # 50 distinct: not > 50
        F.when(F.col("id") % 10 < 4, F.lit("https://x.org")).otherwise(F.lit("a")).alias("urls"))
    ign = {r["column"]: r["ignorable"] for r in P.detect_ignorable(df).collect()}
    assert ign == {"num_id": True, "num_100": False, "txt": True, "txt50": False, "urls": True}


def test_problem_type_boundary(spark):
    df14 = spark.range(140).select((F.col("id") % 14).alias("y"))
    df15 = spark.range(150).select((F.col("id") % 15).alias("y"))
    assert P.infer_problem_type(df14, "y").first()["problem_type"] == "classification"
    assert P.infer_problem_type(df15, "y").first()["problem_type"] == "regression"


def test_rule_profile_and_describe(spark):
    df = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(20)], "id long, name string, grp long")
    rp = {r["column"]: r for r in P.rule_profile(df).collect()}
    assert rp["grp"]["role"] == "target"
    assert rp["id"]["role"] == "ignore"
    assert rp["name"]["role"] == "ignore"  # 20 distinct > 0.9 * 20
    d = P.describe_dataset(df).first()
    assert d["suggested_target"] == "grp" and "20 rows and 3 columns" in d["description"]


def test_quality_scan(spark):
    rows = [(i, f"${i},000", None if i % 10 < 6 else "x", f"id{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "k long, price string, sparse string, ident string")
    issues = [(r["column"], r["issue_type"]) for r in
              Q.quality_issues(df, ["k"]).orderBy("pos", "issue_order").collect()]
    assert issues == [("price", "formatted_numeric"), ("price", "high_cardinality"),
                      ("sparse", "high_nulls"), ("ident", "high_cardinality")]
    rep = Q.quality_report(df, ["k"]).first()
    assert rep["overall_quality_score"] == 60
    assert rep["overall_summary"] == "Found 4 data quality issue(s) across 4 columns."
    nulls = Q.scan_high_nulls(df).first()
    assert nulls["description"] == "Column 'sparse' is 60.0% null."


def test_column_summary_samples_in_key_order(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b"), (4, "d")], "k long, v string")
    s = {r["column"]: r for r in P.column_summary(df, ["k"], 2).collect()}
    assert s["v"]["sample_values"] == "b|c"
    assert s["v"]["null_pct"] == 25.0


def test_profile_partition_invariance(spark):
    from tests.conftest import SF_SMALL
    from modelkeep.sources.tables import table
    li = table(spark, SF_SMALL, "lineitem")
    one = sorted(map(tuple, column_profile(li.coalesce(1)).collect()))
    many = sorted(map(tuple, column_profile(li.repartition(16)).collect()))
    assert len(one) == len(many)
    for a, b in zip(one, many):
        for x, y in zip(a, b):
            if isinstance(x, float):
                assert abs(x - y) <= 1e-12 * max(1.0, abs(x))  # summation order only
            else:
                assert x == y
