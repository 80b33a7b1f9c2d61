"""Sources and sinks: S1-S8.

Bookkeeping tables (datasets, models, deployments, prediction_log, feedback,
drift_reports, audit_log) are snapshot tables (``snapshots.py``): appends and
updates (R8, R11, R12) are commits, and readers see whole versions only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeep.functions.values import NUMBER_PATTERN, as_text
from modelkeep.sources.csv_records import csv_records
from modelkeep.sources.snapshots import SnapshotTable

# The tokens a pandas CSV reader turns into missing values.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

_INT_PATTERN = r"^[+-]?\d+$"
_BOOL_VALUES = ["True", "False", "true", "false", "TRUE", "FALSE"]

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; filters and projections push into the reader."""
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_file_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text by Spark's own multi-line reader, which gives a file to one task."""
    return spark.read.option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)


def _parsed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of ``path`` as columns of ``schema``; names come from the schema, not from the header."""
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return csv_records(spark, path).select(F.from_csv("record", ddl, {"escape": '"', "mode": "PERMISSIVE"}).alias("__r")).select("__r.*")


def scan_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Header CSV with pandas-like typing.

    Quoted values may hold newlines, and a file is still read by a task per
    split (``csv_records``).  Every column is read as text (PERMISSIVE), the NA
    tokens become NULL, and each column is typed by a vote computed in ONE
    aggregation: all non-null values integers that fit -> bigint, all numbers ->
    double, all true/false -> boolean, else string.  With an explicit schema the
    vote is skipped.  Partition folders (``a=1/``) add their columns; their files
    are read a task each.
    """
    if schema is not None:
        return _parsed_csv(spark, path, schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))
    raw = whole_file_csv(spark, path)
    if len(spark.read.text(path).columns) == 1:  # no columns from folder names
        raw = _parsed_csv(spark, path, raw.schema)
    else:
        raw = raw.select(*[F.col(c).cast("string") for c in raw.columns])
    cols = raw.columns
    cleaned = raw.select(*[F.when(F.col(c).isin(NA_TOKENS), F.lit(None))
                           .otherwise(F.col(c)).alias(c) for c in cols])
    votes = cleaned.agg(*[
        F.struct(
            F.count(c).alias("nn"),
            F.count_if(F.trim(F.col(c)).rlike(_INT_PATTERN) & F.trim(F.col(c)).try_cast("bigint").isNotNull()).alias("ints"),
            F.count_if(F.trim(F.col(c)).rlike(NUMBER_PATTERN)).alias("nums"),
            F.count_if(F.col(c).isin(_BOOL_VALUES)).alias("bools"),
        ).alias(c) for c in cols]).first()
    typed = []
    for c in cols:
        v = votes[c]
        if v["nn"] == 0:
            typed.append(F.lit(None).cast("double").alias(c))
        elif v["ints"] == v["nn"]:
            typed.append(F.trim(F.col(c)).try_cast("bigint").alias(c))
        elif v["nums"] == v["nn"]:
            typed.append(F.trim(F.col(c)).try_cast("double").alias(c))
        elif v["bools"] == v["nn"]:
            typed.append((F.lower(F.col(c)) == "true").alias(c))
        else:
            typed.append(F.col(c).alias(c))
    return cleaned.select(*typed)


def write_csv(df: DataFrame, path: str) -> str:
    """Write a frame as header CSV (one folder of part files)."""
    out = df.select(*[as_text(df, c).alias(c) for c in df.columns])
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def dataset_shape(df: DataFrame) -> DataFrame:
    """S3: ``(row_count, column_count)``; an empty dataset is an error."""
    shape = df.agg(F.count(F.lit(1)).cast("long").alias("row_count")) \
              .withColumn("column_count", F.lit(len(df.columns)).cast("long"))
    return shape


def require_rows(df: DataFrame) -> None:
    """Raise like the reference when a dataset has no rows."""
    if df.isEmpty():
        raise ValueError("Dataset is empty.")


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """First ``n`` rows by an explicit key, every value as text, NULL -> ''.

    ``orderBy().limit()`` plans a TakeOrderedAndProject: a bounded top-n per
    partition, never a full sort.
    """
    top = df.orderBy(*order_by).limit(n)
    return top.select(*[F.coalesce(as_text(top, c), F.lit("")).alias(c) for c in df.columns])


#: Types that the values of one key agree on, by JSON type; mixed numbers are doubles, anything else is text.
_JSON_TYPES = {frozenset({"BIGINT"}): "bigint", frozenset({"DOUBLE"}): "double", frozenset({"BIGINT", "DOUBLE"}): "double", frozenset({"BOOLEAN"}): "boolean"}


def _json_keys(parsed: DataFrame, column: str) -> list[tuple[str, str]]:
    """Every key of the JSON objects in ``column`` with its type, by an
    aggregate with one row per key and type; keys may hold any characters."""
    kind = F.expr("schema_of_variant(value)")
    kind = F.when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "DOUBLE").when(
        kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "BIGINT").when(kind == "BOOLEAN", kind).otherwise("STRING")
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col(column).outer())).where("key IS NOT NULL AND NOT is_variant_null(value)")
    found: dict[str, set[str]] = {}
    for row in each.select("key", kind.alias("kind")).distinct().collect():
        found.setdefault(row["key"], set()).add(row["kind"])
    return [(k, _JSON_TYPES.get(frozenset(kinds), "string")) for k, kinds in sorted(found.items())]


def scan_inputs_json(log: DataFrame, column: str = "input_json",
                     schema: T.StructType | str | None = None,
                     keep: list[str] | None = None) -> DataFrame:
    """Logged JSON objects -> columns; union of keys, missing key -> NULL.

    With the deployment's schema this is one ``from_json``.  Without one the
    keys and their types are one distributed aggregate (numbers stay
    numbers), and the objects are then read with that schema.  Nested values
    stay JSON text.
    """
    keep = keep or []
    if schema is None:
        keys = _json_keys(log.select(F.try_parse_json(F.col(column)).alias("__v")), "__v")
        schema = T.StructType([T.StructField(k, _SPARK_TYPES[t]) for k, t in keys])
    if not isinstance(schema, str) and not schema.fields:
        return log.select(*keep)
    parsed = log.select(*keep, F.from_json(F.col(column), schema).alias("__j"))
    return parsed.select(*keep, "__j.*")


_SPARK_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


def write_table(df: DataFrame, path: str, mode: str = "append", id_col: str | None = "id", token: str | None = None) -> DataFrame:
    """Append records to a bookkeeping table, as one commit; returns them as stored.

    New records get ids of a block that the commit reserves, so two writers
    never give equal ids; a commit replayed with its ``token`` changes nothing.
    ``mode="overwrite"`` puts the records in place of all others.
    """
    t = SnapshotTable(df.sparkSession, path, id_col)
    if mode == "overwrite" and t.version() >= 0:
        return t.update(lambda _: df, token)
    return t.append(df, token)


def read_table(spark: SparkSession, path: str, id_col: str | None = "id", version: int | None = None) -> DataFrame:
    """The records of a bookkeeping table at a version (the last one)."""
    found = SnapshotTable(spark, path, id_col).read(version)
    if found is None:
        raise ValueError(f"{path} has no records.")
    return found


def list_datasets(datasets: DataFrame) -> DataFrame:
    """The catalogue with each entry's ``position``, newest first (ties: newest id first)."""
    from modelkeep.functions.ordered import positions
    return positions(datasets, [F.col("created_at").desc(), F.col("id").desc()])


def save_model(model, meta: dict, directory: str) -> str:
    """Persist a fitted ``PipelineModel`` plus a JSON metadata row."""
    from pyspark.sql import SparkSession as _S
    spark = _S.getActiveSession()
    model.write().overwrite().save(f"{directory}/pipeline")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string") \
        .write.mode("overwrite").json(f"{directory}/meta")
    return directory


def load_model(spark: SparkSession, directory: str):
    """Reload ``(PipelineModel, metadata dict)``."""
    from pyspark.ml import PipelineModel
    pm = PipelineModel.load(f"{directory}/pipeline")
    meta = json.loads(spark.read.json(f"{directory}/meta").first()["meta"])
    return pm, meta
