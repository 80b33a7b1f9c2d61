"""Records of quoted CSV files, read by as many tasks as the files have splits.

A quoted value may hold newlines, so whether a line begins a record depends on
everything before it in its file.  A line is a function on two states, "at the
start of a record" and "inside a quoted value"; so is a split:

1. every split works out where it ends from either state, without knowing in
   which one it begins (``split_ends``, a row per split);
2. a window over these rows composes them in file order, which gives the state
   that each split begins in;
3. every split is read again from its true state.  Records inside a split come
   out as they are; the pieces of a record that crosses splits are joined by a
   group of their own, one group per record.

A row per split is all that a file puts into one task, and what is broadcast
are the splits that begin inside a value: never more than the splits that the
driver holds to plan the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A quote opens a value only where the value begins; two quotes in it are one; after the closing one all up to the comma is literal.
_OPENS = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]|"")*+\Z', re.DOTALL)
_CLOSES = re.compile(r'(?:[^"]|"")*+"[^,]*+', re.DOTALL)


def after(line: str, inside: bool) -> bool:
    """Whether a value is open after ``line``, if one is (``inside``) or isn't before it."""
    if inside:
        closed = _CLOSES.match(line)
        if closed is None:
            return True
        line = line[closed.end() + 1:]
    return _OPENS.match(line) is not None


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """``(file, split, lines)`` for each stretch of one split in a batch."""
    file, split = (batch.column(i).to_numpy() for i in (1, 2))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(file[a]), int(split[a]), batch.column(0).slice(a, b - a)


def _quoted(lines: pa.Array) -> list[int]:
    """The lines with a quote: any other leaves the state as it is."""
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()


def split_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, split, from_start, from_inside, closes)``: the state at the end
    of each split from either state, and whether a value that is open at its
    start closes in it."""
    at, state = None, [False, True, False]

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(("file", "split", "from_start", "from_inside", "closes"), (*at, *state)))])

    for batch in batches:
        for file, split, lines in _runs(batch):
            if (file, split) != at:
                if at is not None:
                    yield row()
                at, state = (file, split), [False, True, False]
            for i in _quoted(lines):
                line, same = lines[i].as_py(), state[0] == state[1]
                state[0] = after(line, state[0])
                state[1] = state[0] if same else after(line, state[1])
                state[2] |= not state[1]
    if at is not None:
        yield row()


_ENDS = "file long, split long, from_start boolean, from_inside boolean, closes boolean"


def open_splits(ends: DataFrame) -> DataFrame:
    """``(file, split, opener)`` of the splits that begin inside a value; the
    value's record begins in the split ``opener``.

    A split either sets the state (both ends alike), turns it or keeps it.  So
    the state before a split is what the last setting one left, turned by the
    number of turning ones since."""
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((F.col("from_start") & ~F.col("from_inside")).cast("int")).over(before), F.lit(0))
    counted = ends.withColumn("__turns", turns)
    sets = F.when(F.col("from_start") == F.col("from_inside"), F.struct(F.col("from_start").cast("int").alias("to"), F.col("__turns").alias("turns")))
    last = F.last(sets, ignorenulls=True).over(before)
    inside = (F.coalesce(last["to"], F.lit(0)) + F.col("__turns") - F.coalesce(last["turns"], F.lit(0))) % 2 == 1
    begun = counted.withColumn("__inside", inside)
    opener = F.last(F.when(~F.col("__inside") | F.col("closes"), F.col("split")), ignorenulls=True).over(before)
    return begun.withColumn("opener", opener).where("__inside").select("file", "split", "opener")


_PIECES = "file long, opener long, split long, record string"


def _record_reader(openers):
    """Lines to ``(file, opener, split, record)``: whole records have a null
    ``opener``, pieces of a record that crosses splits that of their record."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, opener, inside, header, held = None, None, False, False, []

        def last() -> pa.RecordBatch:
            """What is held at the end of a split: a piece if its value is open, or if it began in another split."""
            piece = at[1] if inside and opener is None else opener
            if header and inside:
                raise ValueError("The header of a CSV file is longer than a split.")
            rows = [(at[0], piece, at[1], "\n".join(held))] if held and not header else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            for file, split, lines in _runs(batch):
                if (file, split) != at:
                    if at is not None:
                        yield last()
                    at, held = (file, split), []
                    opener = openers.value.get(at)
                    inside, header = opener is not None, split == 0
                begins = np.full(len(lines), not inside)
                for i in _quoted(lines):
                    inside = after(lines[i].as_py(), inside)
                    begins[i + 1:] = not inside
                first = np.flatnonzero(begins).tolist()
                text = lines.to_pylist()
                held += text[:first[0]] if first else text
                if not first:
                    continue
                done, owner = (["\n".join(held)], [opener]) if held else ([], [])
                opener = None
                done += ["\n".join(text[a:b]) if b > a + 1 else text[a] for a, b in zip(first, first[1:])]
                owner += [None] * (len(done) - len(owner))
                held = text[first[-1]:]
                if header:  # the first record with anything in it
                    named = next((i for i, r in enumerate(done) if r.strip("\r")), None)
                    header = named is None
                    done, owner = ([], []) if header else (done[named + 1:], owner[named + 1:])
                n = len(done)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.array(owner, pa.int64()), pa.array([split] * n, pa.int64()), pa.array(done, pa.string())], names)
        if at is not None:
            yield last()

    names, types = ["file", "opener", "split", "record"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return read


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, split)``: the lines of all files, in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: every record but the headers (each file's first record), as
    text, lines joined by ``\\n``; empty records are left out.  An unclosed
    value runs to the end of its file.  A header must fit in a split."""
    lines = csv_lines(spark, path)
    found = open_splits(lines.mapInArrow(split_ends, _ENDS)).collect()
    openers = spark.sparkContext.broadcast({(r["file"], r["split"]): r["opener"] for r in found})
    pieces = lines.mapInArrow(_record_reader(openers), _PIECES)
    records = pieces.where(F.col("opener").isNull()).select("record")
    if found:
        parts = F.array_sort(F.collect_list(F.struct("split", "record")))
        crossing = pieces.where(F.col("opener").isNotNull()).groupBy("file", "opener").agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"))
        records = records.unionAll(crossing.select("record"))
    return records.select(F.regexp_replace("record", r"\r\z", "").alias("record")).where("record <> ''")
