"""The first values of many columns at once, in bounded memory.

``first_of_each`` is an aggregate whose buffer holds ``k`` values a column: every
task keeps the first ``k`` of each column of its own rows while it scans, and
these buffers are merged.  Rows are neither unpivoted nor sorted, and what is
shuffled is at most ``k`` values per column and task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buffers are merged in so many groups a column first, so that no task merges those of all tasks.
MERGE_GROUPS = 1024


def _first(table: pa.Table, keys: list[str], k: int) -> pa.Table:
    """The first ``k`` rows by ``keys``, then ``value``; nulls first."""
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (*keys, "value")], null_placement="at_start")[:k])


def _ranks(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in key order, and the rank of each: rows with equal keys share one."""
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in keys], null_placement="at_start")
    changed = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in keys:
        column = table.column(c).combine_chunks().take(order)
        a, b = column.slice(0, len(changed)), column.slice(1)
        same = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.and_(pc.is_null(a), pc.is_null(b)), pc.equal(a, b))
        changed |= ~same.to_numpy(zero_copy_only=False).astype(bool)
    return order.to_numpy(), np.concatenate([[0], np.cumsum(changed)])


def _buffers(keys: list[str], k: int):
    """Rows ``(keys, v0, v1, ..)`` to ``(slot, keys, value)``, at most ``k`` a slot."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            order, rank = _ranks(table, keys)
            for slot in range(len(table.column_names) - len(keys)):
                value = table.column(len(keys) + slot)
                present = np.flatnonzero(pc.is_valid(value).to_numpy()[order])
                if len(present) > k:  # all rows that tie with the k-th stay
                    present = present[rank[present] <= rank[present[k - 1]]]
                if not len(present):
                    continue
                new = table.select(keys).append_column("value", value).take(pa.array(order[present]))
                held[slot] = _first(pa.concat_tables([held[slot], new]) if slot in held else new, keys, k)
        for slot, kept in held.items():
            yield from kept.add_column(0, "slot", pa.array([slot] * kept.num_rows, pa.int32())).combine_chunks().to_batches()

    return scan


def _orderable(df: DataFrame, key: list[str]) -> list:
    """Key columns that Arrow orders as Spark does: of a number that may be NaN, whether it is, then the number."""
    out = []
    for c in key:
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            out += [F.when(F.col(c).isNotNull(), F.isnan(c).cast("int")), F.when(~F.isnan(c), F.col(c))]
        elif isinstance(df.schema[c].dataType, T.BooleanType):
            out.append(F.col(c).cast("int"))
        else:
            out.append(F.col(c))
    return out


def first_of_each(df: DataFrame, key: list[str], values: dict, k: int) -> DataFrame:
    """``(column, rn, value)``: for every named text column in ``values`` the
    first ``k`` that aren't null, by ``key`` (nulls first), ties by value."""
    names = list(values)
    parts = _orderable(df, key)
    rows = df.select(*[c.alias(f"k{i}") for i, c in enumerate(parts)], *[values[c].alias(f"v{i}") for i, c in enumerate(names)])
    keys = rows.columns[:len(parts)]
    schema = T.StructType([T.StructField("slot", T.IntegerType()), *rows.schema.fields[:len(parts)], T.StructField("value", T.StringType())])
    buffers = rows.mapInArrow(_buffers(keys, k), schema)
    firsts = F.slice(F.array_sort(F.collect_list(F.struct(*keys, "value"))), 1, k)
    merged = buffers.groupBy("slot", (F.spark_partition_id() % MERGE_GROUPS).alias("__m")).agg(firsts.alias("__f"))
    merged = merged.groupBy("slot").agg(F.slice(F.array_sort(F.flatten(F.collect_list("__f"))), 1, k).alias("__f"))
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("slot") + 1)
    return merged.select(name.alias("column"), F.posexplode("__f")).select("column", (F.col("pos") + 1).alias("rn"), F.col("col")["value"].alias("value"))
