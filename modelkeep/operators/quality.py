"""Quality scan: P9-P12.

Issues are rows ``(pos, column, issue_type, severity, description,
recommended_fix)``; the report score is computed from their count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeep.functions.values import column_profile, parse_number, profile_columns, typed
from modelkeep.operators.profile import first_values

# Thresholds and texts of the reference's quality scan.
FORMATTED_SAMPLE = 20
FORMATTED_MIN_RATIO = 0.8
HIGH_CARDINALITY_SHARE = 0.9
HIGH_NULL_PCT = 50.0
ISSUE_ORDER = {"formatted_numeric": 0, "high_cardinality": 1, "high_nulls": 2}
FORMATTED_TEXT = "Column '%s' contains numeric values formatted as strings (e.g. currency, commas)."
FORMATTED_FIX = "Automatically stripped and converted to numeric during training."
CARDINALITY_TEXT = "Column '%s' has %d unique values (%d%% of rows) — likely an ID or free text."
CARDINALITY_FIX = "Mark this column as 'ignore' in feature roles."
NULLS_TEXT = "Column '%s' is %s%% null."
NULLS_FIX = "Consider dropping or imputing this column."
SUMMARY_TEXT = "Found %d data quality issue(s) across %d columns."

ISSUE_SCHEMA = ("pos int, column string, issue_type string, severity string, "
                "description string, recommended_fix string")


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.TimestampType, T.DateType))]


def scan_formatted_numeric(df: DataFrame, key: list[str]) -> DataFrame:
    """String column whose first 20 non-null values (key order) parse as
    numbers at >= 0.8 after stripping."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    positions = {c: i for i, c in enumerate(df.columns)}
    if not cols:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    firsts = first_values(df, key, FORMATTED_SAMPLE, cols)
    ratio = firsts.groupBy("column").agg(
        F.avg(parse_number(F.col("value")).isNotNull().cast("double")).alias("ratio"))
    pos = F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(positions[c]))]),
                       F.col("column"))
    return ratio.where(F.col("ratio") >= FORMATTED_MIN_RATIO).select(
        pos.cast("int").alias("pos"), "column", F.lit("formatted_numeric").alias("issue_type"),
        F.lit("warning").alias("severity"),
        F.format_string(FORMATTED_TEXT, F.col("column")).alias("description"),
        F.lit(FORMATTED_FIX).alias("recommended_fix"))


def scan_high_cardinality(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """P10: text column with distinct count > 0.9 x rows."""
    p = profile if profile is not None else column_profile(df)
    text = _text_columns(df)
    pct = F.bround(F.col("n_unique") / F.col("n_rows") * 100.0, 0).cast("long")
    return p.where(F.col("column").isin(text) &
                   (F.col("n_unique") > F.col("n_rows") * HIGH_CARDINALITY_SHARE)).select(
        F.col("pos").cast("int").alias("pos"), "column",
        F.lit("high_cardinality").alias("issue_type"), F.lit("warning").alias("severity"),
        F.format_string(CARDINALITY_TEXT, F.col("column"), F.col("n_unique"), pct).alias("description"),
        F.lit(CARDINALITY_FIX).alias("recommended_fix"))


def null_counts(df: DataFrame) -> DataFrame:
    """``(column, pos, n_rows, null_count)`` from one aggregate."""
    cols = profile_columns(df)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"), F.count_if(typed(df, c).isNull()).alias("null_count")) for i, c in enumerate(cols)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*cells).alias("cells")).select("n_rows", F.inline("cells")).where("n_rows > 0")


def scan_high_nulls(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Any column more than 50 % null; by itself one count per column,
    without a shuffle of values."""
    p = profile if profile is not None else null_counts(df)
    pct = F.col("null_count") / F.col("n_rows") * 100.0
    return p.where(pct > HIGH_NULL_PCT).select(
        F.col("pos").cast("int").alias("pos"), "column",
        F.lit("high_nulls").alias("issue_type"), F.lit("warning").alias("severity"),
        F.format_string(NULLS_TEXT, F.col("column"),
                        F.bround(pct, 1).cast("double").cast("string")).alias("description"),
        F.lit(NULLS_FIX).alias("recommended_fix"))


def quality_issues(df: DataFrame, key: list[str], profile: DataFrame | None = None) -> DataFrame:
    """P9-P11 in column order, then issue order."""
    p = profile if profile is not None else column_profile(df)
    issues = (scan_formatted_numeric(df, key)
              .unionByName(scan_high_cardinality(df, p))
              .unionByName(scan_high_nulls(df, p)))
    order = F.element_at(F.create_map(*[x for k, v in ISSUE_ORDER.items()
                                        for x in (F.lit(k), F.lit(v))]), F.col("issue_type"))
    return issues.withColumn("issue_order", order.cast("int"))


def quality_report(df: DataFrame, key: list[str], profile: DataFrame | None = None,
                   issues: DataFrame | None = None) -> DataFrame:
    """``(issue_count, overall_quality_score, overall_summary)``, of
    ``issues`` if they are at hand."""
    issues = quality_issues(df, key, profile) if issues is None else issues
    n_cols = len(df.columns)
    return issues.agg(F.count(F.lit(1)).cast("long").alias("issue_count")).select(
        "issue_count",
        F.greatest(F.lit(0), F.lit(100) - F.lit(10) * F.col("issue_count")).cast("long")
         .alias("overall_quality_score"),
        F.format_string(SUMMARY_TEXT, F.col("issue_count"), F.lit(n_cols)).alias("overall_summary"))
