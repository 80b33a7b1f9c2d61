"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeep.session import scratch_path

#: Ids that are null come after all others where an order of documents is needed.
LAST_ID = (1 << 63) - 1


def settle(spark: SparkSession) -> None:
    """Session settings the operators rely on.

    Arrow batches hold few rows, as a row may be a very long text; shuffle
    files go when the query that wrote them ends, so an operator of several
    staged queries needs the disk of its largest one only.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read
    again: cuts the lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]) -> Callable:
    """``function`` over each Arrow batch, for mapInArrow; empty batches are passed over."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = function(batch)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
    return run


def grouped(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in larger ones, of about ``limit`` bytes of one column."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def discard(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` long and ``text``
    string (null: empty), whatever else the table has."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def fold(id_column: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def apart(column: Column) -> Column:
    """A 64-bit integer column as Spark takes for a new one.  A grouped table
    joined on it gets an exchange of its own, which is cheap (one row a key)
    and lets the adaptive join split the other side's hot keys."""
    return column.bitwiseXOR(F.lit(0).cast("long"))


def hex_sha256(data: bytes | bytearray | memoryview) -> str:
    return hashlib.sha256(data).hexdigest()
