"""Column kinds, numeric parsing and the shared value-count frames.

Distinct counts, modes, category caps and the whole column profile come
from counting each column's distinct values once: every column is
unpivoted to ``(column, value)`` rows and grouped.  The partial
aggregation on the map side collapses hot values before the shuffle, so a
value holding a third of all rows costs one row per input partition, and
per-value work (regex tests, parsing) runs once per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's behaviour:
# characters stripped before a numeric parse, and the URL pattern.
STRIP_CHARS = r"[₹$£€,\s%]"
URL_PATTERN = r"https?://|www\."
# Strict decimal / scientific literal; guards try_cast so that both engines
# agree ('5d', '1_000', 'inf', 'nan' are rejected).
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# What a text that parses can consist of; others end the test at their first other character.
_NUMBER_CHARS = r"^[₹$£€,\s%0-9.eE+-]*$"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric in the pandas sense: ints, floats, decimals and booleans."""
    return isinstance(dt, _INTEGRAL + _FRACTIONAL + (T.BooleanType,))


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) or \
        dt.typeName() in ("vector", "udt")


def pandas_dtype(dt: T.DataType, has_nulls: bool | Column = False):
    """The dtype name pandas would report for a CSV column of this type."""
    if isinstance(dt, T.BooleanType):
        return F.lit("bool")
    if isinstance(dt, _INTEGRAL):
        if isinstance(has_nulls, Column):
            return F.when(has_nulls, F.lit("float64")).otherwise(F.lit("int64"))
        return F.lit("float64" if has_nulls else "int64")
    if isinstance(dt, _FRACTIONAL):
        return F.lit("float64")
    return F.lit("object")


def typed(df: DataFrame, name: str) -> Column:
    """Column reference where float NaN reads as NULL."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(None).cast(dt)).otherwise(c)
    return c


def as_text(df: DataFrame, name: str) -> Column:
    """String form of a column, the way the profile sees values."""
    dt = df.schema[name].dataType
    c = typed(df, name)
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def strip_formatting(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, STRIP_CHARS, ""))


def parse_number(text: Column) -> Column:
    """Formatted numeric string -> double, NULL when it does not parse."""
    cleaned = strip_formatting(text)
    return F.when(text.rlike(_NUMBER_CHARS), F.when(cleaned.rlike(NUMBER_PATTERN), cleaned.try_cast("double")))


def spread(df: DataFrame) -> DataFrame:
    """A scan of a single split (one small file, or one row group) dealt to
    all cores before heavy per-row work; anything else is returned as it is.

    Only a plan whose every node works row by row over one scan is asked for
    its partitions, so this starts no job, and at most one split is ever shuffled.
    """
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() not in _ROW_BY_ROW:
            return df
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df


#: Plan nodes that neither move rows between partitions nor read a stored result.
_ROW_BY_ROW = {"Project", "Filter", "Generate", "LogicalRelation"}


#: Columns that are counted each for itself where that reads nothing twice.
COLUMNS_APART = 24


def _is_plain_scan(df: DataFrame) -> bool:
    """Only projections over one file scan, which reads the columns asked for."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() == "Project":
        node = node.children().apply(0)
    return node.getClass().getSimpleName() == "LogicalRelation"


ROWS_PER_TASK = 50_000
MOST_ROWS_PER_TASK = 500_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Partition a frame of known row count for iterative work (model fits
    run one job per tree level / iteration, so a task per core only pays
    off with enough rows per task).  Target: one partition per
    ``ROWS_PER_TASK`` rows, at most one per core unless each then has more than
    ``MOST_ROWS_PER_TASK``; large frames that already have more partitions than
    that are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    target = max(1, min(cores, -(-rows // ROWS_PER_TASK)), -(-rows // MOST_ROWS_PER_TASK))
    current = df.rdd.getNumPartitions()
    if current < target:
        return df.repartition(target)
    if current > target and rows < ROWS_PER_TASK * current:
        return df.coalesce(target)
    return df


def profile_columns(df: DataFrame) -> list[str]:
    """Columns a profile looks at: everything except nested/binary/vector."""
    return [f.name for f in df.schema.fields if not is_nested(f.dataType)]


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Unpivot to ``(column, value)`` with values as text; NULLs kept."""
    cols = columns if columns is not None else profile_columns(df)
    texts = spread(df.select(*cols)).select(*[as_text(df, c).alias(c) for c in cols])
    return texts.unpivot([], cols, "column", "value")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` for every column and value, NULL included."""
    return (long_values(df, columns)
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def distinct_counts(vc: DataFrame) -> DataFrame:
    """``(column, n_unique)`` from a ``value_counts`` frame (NULL excluded)."""
    return (vc.where(F.col("value").isNotNull())
            .groupBy("column").agg(F.count(F.lit(1)).alias("n_unique")))


def typed_value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, num, txt, n)``: counts per distinct value, numeric columns
    as double (no text cast), everything else as text; NULL included."""
    cols = columns if columns is not None else profile_columns(df)
    cells = []
    for c in cols:
        numeric = is_numeric_type(df.schema[c].dataType)
        cells.append(F.struct(
            F.lit(c).alias("column"),
            (typed(df, c).cast("double") if numeric else F.lit(None).cast("double")).alias("num"),
            (F.lit(None).cast("string") if numeric else as_text(df, c)).alias("txt")))
    return (spread(df.select(*cols)).select(F.inline(F.array(*cells)))
            .groupBy("column", "num", "txt").agg(F.count(F.lit(1)).alias("n")))


def text_key(text: Column) -> Column:
    """A text as a key of at most 33 bytes: itself, or 128 bits of its digest."""
    short = F.concat(F.lit("="), text).cast("binary")
    return F.when(F.octet_length(text) <= 32, short).when(text.isNotNull(), F.concat(F.lit("#").cast("binary"), F.unhex(F.md5(text))))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column from one scan and one shuffle (of a few columns straight
    from a file, each is read and counted for itself: the same bytes, and no
    row is copied once per column).

    ``(column, pos, numeric, n_rows, non_null, null_count, n_unique, min,
    max, mean, url_ratio, dtype)``.  Every statistic is derived from counts
    per distinct value: min/max/mean from numeric values weighted by their
    counts, distinct texts from keys of at most 33 bytes (a longer text's
    128-bit digest), so megabyte texts shuffle no more than short ones; whether
    a text is a URL is asked where it is.
    """
    cols = columns if columns is not None else profile_columns(df)
    cells = {}
    for c in cols:
        numeric = is_numeric_type(df.schema[c].dataType)
        txt = F.lit(None).cast("string") if numeric else as_text(df, c)
        cells[c] = [F.lit(c).alias("column"), (typed(df, c).cast("double") if numeric else F.lit(None).cast("double")).alias("num"),
                    text_key(txt).alias("key"), txt.rlike(URL_PATTERN).alias("url")]
    rows, names = spread(df.select(*cols)), ["column", "num", "key", "url"]
    if 0 < len(cols) <= COLUMNS_APART and _is_plain_scan(rows):
        vc = None
        for c, cell in cells.items():
            own = rows.select(*cell).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
            vc = own if vc is None else vc.unionAll(own)
    else:
        vc = rows.select(F.inline(F.array(*[F.struct(*cell) for cell in cells.values()]))).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    present = F.col("num").isNotNull() | F.col("key").isNotNull()
    per = vc.groupBy("column").agg(
        F.sum("n").cast("long").alias("n_rows"),
        F.sum(F.when(present, F.col("n")).otherwise(0)).cast("long").alias("non_null"),
        F.count_if(present).cast("long").alias("n_unique"),
        F.min("num").alias("min"), F.max("num").alias("max"),
        (F.sum(F.col("num") * F.col("n")) / F.sum(F.when(F.col("num").isNotNull(), F.col("n"))))
        .alias("mean"),
        (F.sum(F.when(F.col("key").isNotNull(), F.col("url").cast("double") * F.col("n")))
         / F.sum(F.when(F.col("key").isNotNull(), F.col("n")))).alias("url_ratio"))
    pos = F.element_at(F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))]),
                       F.col("column"))
    numeric = F.col("column").isin([c for c in cols if is_numeric_type(df.schema[c].dataType)] or [""])
    out = per.select(
        "column", pos.cast("int").alias("pos"), numeric.alias("numeric"), "n_rows", "non_null",
        (F.col("n_rows") - F.col("non_null")).alias("null_count"), "n_unique",
        F.when(numeric, F.col("min")).alias("min"), F.when(numeric, F.col("max")).alias("max"),
        F.when(numeric, F.col("mean")).alias("mean"),
        F.when(~numeric, F.col("url_ratio")).alias("url_ratio"))
    dtype_expr = None
    for c in cols:
        e = pandas_dtype(df.schema[c].dataType, F.col("null_count") > 0)
        dtype_expr = (F.when(F.col("column") == c, e) if dtype_expr is None
                      else dtype_expr.when(F.col("column") == c, e))
    return out.withColumn("dtype", dtype_expr if dtype_expr is not None else F.lit("object"))
