"""Exact ordered computations without pulling a group into one task.

Running sums, exact medians, ECDFs and ranks all need an order inside a
group.  A plain ``Window.partitionBy(group).orderBy(x)`` sends every row of a
group to one task, which breaks once one group holds a third of the data.

The input is written once, and the size of its largest group measured on that.
When every group fits comfortably in a task (``max_rows_per_bucket``), a
plain window is used.  Otherwise each group is cut into ranges:

1. ``percentile_approx`` cuts each group's order key into ``B`` ranges
   (bounded buffer per group, partial aggregation on the map side);
2. totals per (group, bucket) are tiny; their running offsets come from a
   window over at most ``B`` rows per group;
3. the exact running sum inside a (group, bucket) is a window over one
   bucket, plus its offset.

Every bucket key is a monotone function of the first order column, so ties
stay inside one bucket and the result equals the single-window answer.
"""

from __future__ import annotations

import math
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelkeep.session import scratch_path

MAX_ROWS_PER_BUCKET = 2_000_000


def _order_cols(order: list[str | Column], descending: bool) -> list[Column]:
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    return [c.desc() if descending else c.asc() for c in cols]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and
    the same rows in the same partitions after an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_file_order(df: DataFrame) -> DataFrame:
    """A written frame read with its files by name: a folder lists them in any
    order, and sums of floats and draws by partition would differ between runs."""
    files = sorted(df.inputFiles())
    return df.sparkSession.read.schema(df.schema).parquet(*[unquote(f) for f in files]) if len(files) > 1 else df


def positions(df: DataFrame, order: list[Column], groups: list[str] = [], name: str = "position") -> DataFrame:
    """1-based position of every row by the whole ``order``, within ``groups``.

    Rows are range-partitioned by all order columns, rows tied on all of them
    by a row number, and sorted within partitions, so neither a large group nor
    rows that share the first column are ever one task.  A row's place in its
    partition plus the rows of its group in the partitions before (a row per
    group and partition) is its position.
    """
    tie = F.monotonically_increasing_id()
    whole = [*[F.col(g) for g in groups], *order, F.col("__tie")]
    dealt = written(df.withColumn("__tie", tie).repartitionByRange(*whole).sortWithinPartitions(*whole).drop("__tie").withColumn("__at", tie), "positions")
    part = F.shiftright("__at", 33)
    runs = dealt.groupBy(*groups, part.alias("__p")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(before.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)], F.col("__p").alias("__q"), "__first",
                       F.coalesce(before, F.lit(0)).alias("__before"))
    same = part == F.col("__q")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"__g{k}"))
    met = dealt.join(runs, same)
    return met.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("long").alias(name))


def sums_before(df: DataFrame, groups: list[str], order: list[str], weights: list[str], suffix: str = "_below") -> DataFrame:
    """Add ``<w><suffix>`` = sum of ``w`` over the rows of the group that come
    before each row in ``order``; no two rows of a group may tie on it.

    Rows are range-partitioned by group and order, so one large group is cut into
    as many tasks as all small ones together, whatever its size; what the
    partitions before hold of a group (a row per group and partition) is added
    to the sums inside the partition.  ``df`` is run once.
    """
    dealt = written(df.repartitionByRange(*groups, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*groups, "__p").agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "__p", *[F.coalesce(F.sum(f"__t_{w}").over(earlier), F.lit(0)).alias(f"__o_{w}") for w in weights])
    inside = Window.partitionBy(*groups, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(offsets, [*groups, "__p"])
    return met.select(*df.columns, *[(F.coalesce(F.sum(w).over(inside), F.lit(0)) + F.col(f"__o_{w}")).alias(f"{w}{suffix}") for w in weights])


def bucket_count(df: DataFrame, groups: list[str], max_rows_per_bucket: int) -> int:
    """Buckets needed so that no (group, bucket) exceeds the row budget."""
    largest = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    return max(1, math.ceil(largest / max_rows_per_bucket))


def running_sums(df: DataFrame, groups: list[str], order: list[str],
                 weights: list[str], *, descending: bool = False,
                 max_rows_per_bucket: int = MAX_ROWS_PER_BUCKET,
                 buckets: int | None = None, inclusive: bool = True,
                 suffix: str = "_cum", few_groups: bool = True,
                 with_next: bool = False, with_totals: bool = False) -> DataFrame:
    """Add ``<w><suffix>`` = sum of ``w`` over rows ordered before (and, when
    ``inclusive``, including) each row, within ``groups``.

    The first ``order`` column must be numeric; further order columns break
    ties.  Rows tied on every order column get distinct positions (ROWS
    frame), so callers aggregate duplicates first when ties must share a
    value.  ``with_next`` adds ``<order[0]>_next`` (the following row's key,
    NULL for the last row of a group); ``with_totals`` adds ``<w>_total``.

    ``few_groups``: the group count is bounded by the schema (columns,
    features, classes), so the per-group split row is broadcast and a hot
    group never skews a join.  Pass ``False`` for data-sized group counts;
    the split join then shuffles and AQE splits skewed partitions.
    """
    if not groups:
        out = running_sums(df.withColumn("__g", F.lit(0)), ["__g"], order, weights,
                           descending=descending, max_rows_per_bucket=max_rows_per_bucket,
                           buckets=buckets, inclusive=inclusive, suffix=suffix,
                           few_groups=True, with_next=with_next, with_totals=with_totals)
        return out.drop("__g")
    key = order[0]
    frame_end = Window.currentRow if inclusive else -1
    if buckets is None:
        df = written(df, "ordered")
    n_buckets = buckets if buckets is not None else bucket_count(df, groups, max_rows_per_bucket)

    if n_buckets <= 1:
        w = Window.partitionBy(*groups).orderBy(*_order_cols(order, descending))
        out = df
        for wt in weights:
            out = out.withColumn(f"{wt}{suffix}", F.coalesce(
                F.sum(wt).over(w.rowsBetween(Window.unboundedPreceding, frame_end)), F.lit(0)))
            if with_totals:
                out = out.withColumn(f"{wt}_total", F.sum(wt).over(Window.partitionBy(*groups)))
        if with_next:
            out = out.withColumn(f"{key}_next", F.lead(F.col(key).cast("double")).over(w))
        return out

    fractions = [i / n_buckets for i in range(1, n_buckets)]
    keyed = df.withColumn("__k", F.col(key).cast("double"))
    splits = keyed.groupBy(*groups).agg(
        F.percentile_approx("__k", fractions, max(10000, 4 * n_buckets)).alias("__splits"))
    if few_groups:
        splits = F.broadcast(splits)  # one row of B doubles per group
    b = keyed.join(splits, groups, "left")
    pos = F.size(F.filter(F.col("__splits"), lambda s: s < F.col("__k")))
    b = b.withColumn("__b", -pos if descending else pos).drop("__splits")

    totals = b.groupBy(*groups, "__b").agg(
        *[F.sum(wt).alias(f"__t_{wt}") for wt in weights], F.min("__k").alias("__first"))
    w_off = Window.partitionBy(*groups).orderBy("__b")
    offsets = totals.select(
        *groups, "__b",
        *[F.coalesce(F.sum(f"__t_{wt}").over(w_off.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"__o_{wt}") for wt in weights],
        *[F.sum(f"__t_{wt}").over(Window.partitionBy(*groups)).alias(f"__s_{wt}") for wt in weights],
        F.lead("__first").over(w_off).alias("__after"))

    w_in = Window.partitionBy(*groups, "__b").orderBy(*_order_cols(order, descending))
    out = b.join(offsets, [*groups, "__b"], "inner")
    for wt in weights:
        out = out.withColumn(f"{wt}{suffix}", F.col(f"__o_{wt}") + F.coalesce(
            F.sum(wt).over(w_in.rowsBetween(Window.unboundedPreceding, frame_end)), F.lit(0)))
        if with_totals:
            out = out.withColumn(f"{wt}_total", F.col(f"__s_{wt}"))
    if with_next:
        out = out.withColumn(f"{key}_next", F.coalesce(F.lead("__k").over(w_in), F.col("__after")))
    return out.drop("__k", "__b", "__after", *[f"__o_{wt}" for wt in weights],
                    *[f"__s_{wt}" for wt in weights])


def exact_median(counts: DataFrame, groups: list[str], value: str = "value",
                 n: str = "n", few_groups: bool = True,
                 max_rows_per_bucket: int = MAX_ROWS_PER_BUCKET) -> DataFrame:
    """Exact median per group from distinct ``(groups, value, n)`` counts.

    Mean of the two middle values for an even total (the interpolating
    median of both engines).  NULL values must be filtered by the caller.
    """
    if not groups:
        out = exact_median(counts.withColumn("__g", F.lit(0)), ["__g"], value, n,
                           True, max_rows_per_bucket)
        return out.drop("__g")
    cum = running_sums(counts, groups, [value], [n], few_groups=few_groups,
                       max_rows_per_bucket=max_rows_per_bucket, with_totals=True)
    total = F.col(f"{n}_total")
    lo = F.floor((total + 1) / 2)
    hi = F.ceil((total + 1) / 2)
    start = F.col(f"{n}_cum") - F.col(n)

    def covers(r):
        return (start < r) & (r <= F.col(f"{n}_cum"))

    picked = cum.where(covers(lo) | covers(hi))
    return picked.groupBy(*groups).agg(
        ((F.max(F.when(covers(lo), F.col(value).cast("double")))
          + F.max(F.when(covers(hi), F.col(value).cast("double")))) / 2).alias("median"))


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, median)`` for numeric columns, exact, NULL/NaN skipped."""
    from modelkeep.functions.values import typed
    longf = (df.select(*[typed(df, c).cast("double").alias(c) for c in columns])
             .unpivot([], columns, "column", "value")
             .where(F.col("value").isNotNull()))
    counts = longf.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return exact_median(counts, ["column"])


def dense_positions(df: DataFrame, groups: list[str], order: list[str], *,
                    descending: bool = False, name: str = "rank",
                    few_groups: bool = True,
                    max_rows_per_bucket: int = MAX_ROWS_PER_BUCKET) -> DataFrame:
    """1-based position of every row in ``order`` within ``groups``.

    Same result as ``row_number()`` over the window; a group larger than
    the row budget is ranked in ranges instead of in one task.
    """
    out = running_sums(df.withColumn("__one", F.lit(1)), groups, order, ["__one"],
                       descending=descending, few_groups=few_groups,
                       max_rows_per_bucket=max_rows_per_bucket)
    return out.withColumnRenamed("__one_cum", name).drop("__one")
