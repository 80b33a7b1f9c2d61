"""The preparation of the model queries: what each pass over the rows costs."""

from pyspark.sql import functions as F

from modelkeep.functions import values as FV
from modelkeep.operators import prep as T


def test_only_texts_that_can_be_numbers_are_cleaned(spark):
    rows = [("$1,234.5",), (" 7 % ",), ("1e3",), ("-.5",), ("1:2",), ("e",), ("",), (None,), ("1\n",), ("1\u0085",), ("５",), ("€ 9",), ("1 2",), ("0x1",)]
    df = spark.createDataFrame(rows, "t string")
    cleaned = FV.strip_formatting(F.col("t"))
    plain = F.when(cleaned.rlike(FV.NUMBER_PATTERN), cleaned.try_cast("double"))
    got = df.select(FV.parse_number(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and [r["a"] for r in got][:4] == [1234.5, 7.0, 1000.0, -0.5]
    assert FV._NUMBER_CHARS in df.select(FV.parse_number(F.col("t")))._jdf.queryExecution().toString()


def test_a_profile_counts_columns_of_a_file_apart(spark, scratch, monkeypatch):
    rows = [(i % 3, float(i % 5) if i % 7 else float("nan"), "x" * (i % 40) if i % 4 else None, "www.a.b" if i % 2 else "t", -0.0 if i % 2 else 0.0) for i in range(300)]
    path = scratch("profile")
    spark.createDataFrame(rows, "a int, b double, c string, d string, e double").write.parquet(path)
    df = spark.read.parquet(path)
    apart = FV.column_profile(df)
    assert "Generate" not in apart._jdf.queryExecution().toString()
    monkeypatch.setattr(FV, "COLUMNS_APART", 0)
    together = FV.column_profile(df)
    key = lambda r: r["column"]
    assert sorted(apart.collect(), key=key) == sorted(together.collect(), key=key) and apart.schema == together.schema


def test_the_split_is_computed_once(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 9 > 0, F.col("id") * 0.5).alias("x"))
    for one, two in zip(T.split_train_test(df, "k"), T.split_written(df, "k")):
        assert sorted(one.collect(), key=str) == sorted(two.collect(), key=str) and one.columns == two.columns
        assert "md5" not in two._jdf.queryExecution().toString()
