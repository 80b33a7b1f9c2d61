"""SimHash near-duplicates: pigeonhole blocks, block joins, Hamming check.

A fingerprint of 64 bits is cut into ``distance + 3`` blocks.  Two
fingerprints that differ in at most ``distance`` bits agree in at least 3 of
the blocks, so each combination of 3 blocks is a join key of about 32 bits and
every close pair shares one.  Keys are made for distinct fingerprints only:
exact copies and all texts with equal fingerprints have collapsed before.

A key's group is not paired row by row.  It is cut into parts of about
``PART`` fingerprints (by hash, as many as its measured size asks for), each
pair of parts is one grid cell, and a cell compares its fingerprints as one
bit matrix and returns only links that join something new (a spanning
forest): at most one link fewer than it has fingerprints, and none are lost
for the classes.  So a key that a third of all fingerprints share spreads over
many tasks of bounded size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeep.llm import words as W
from modelkeep.llm.common import apart, fresh, id_and_text, per_batch, settle, staged
from modelkeep.llm.components import components

#: Fingerprints of a part; a cell compares two parts, by rows of one against all of the other.
PART = 2048


def fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    """The fingerprint of one text's words; 0 without words."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends, at = np.zeros(len(words), np.int64), -1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[:n]
    ends = ends[-n:]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    h = np.fromiter((digest(view[b:e], seed) for b, e in zip(begins.tolist(), ends.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): each whole text's SimHash as a signed 64-bit integer.

    A-Z are lower-cased; words are runs of other characters than ASCII
    white space; a bit is 1 if more than half of the shingles' XXH64 have it.
    Null and empty texts have fingerprint 0.
    """
    def run(batch):
        ids, out = batch.column(0), []
        for _, _, data, bounds in W.slices(batch.column(1)):
            lowered = W.LOWER[data]
            for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                out.append(fingerprint(lowered[b:e].tobytes().split(), shingle, seed))
        fp = np.array(out, np.uint64).view(np.int64)
        return pa.record_batch([ids, pa.array(fp, pa.int64())], names=["doc_id", "fp"])
    return id_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), "doc_id long, fp long")


def block_keys(distance: int) -> list[int]:
    """Bit masks, one for each combination of 3 of the ``distance + 3`` blocks."""
    blocks = distance + 3
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(masks, 3)]


def forest(left: np.ndarray, right: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links of at most ``distance`` bits between two parts (``right`` None:
    inside one) that each join two sets not joined before."""
    nodes = left if right is None else np.concatenate([left, right])
    other = nodes if right is None else right
    shift = 0 if right is None else len(left)
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(len(left)):
        near = np.flatnonzero(np.bitwise_count(other ^ left[i]) <= distance) + shift
        mine = root(i)
        near = near[parent[near] != mine]  # those of the same set already seen are passed over at once
        for j in near.tolist():
            other_root = root(j)
            if other_root != mine:
                parent[other_root] = mine
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` of at most
    ``distance`` bits, enough of them to join every class of linked ones."""
    masks = block_keys(distance)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).cast("byte").alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("x")
    ).select("fp", "x.block", "x.key")
    sizes = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("block").alias("of"), apart(F.col("key")).alias("shared"), "n")
    shared = keyed.join(sizes, (F.col("block") == F.col("of")) & (F.col("key") == F.col("shared")))
    parts = F.ceil(F.col("n") / PART).cast("int")
    shared = shared.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp", "block"), F.col("parts")).cast("int"))
    # A part meets every part: the cell (i, j), i <= j, gets part i as its left and part j as its right side.
    cells = shared.select("block", "key", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")).select(
        "block", "key", "fp", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part")
    packed = cells.groupBy("block", "key", "i", "j").agg(
        F.collect_list(F.when(F.col("part") == F.col("i"), F.col("fp"))).alias("left"),
        F.collect_list(F.when((F.col("part") == F.col("j")) & (F.col("i") != F.col("j")), F.col("fp"))).alias("right"))

    def run(batch):
        a, b = [], []
        for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(one) == 2 and not two:
                found = [(one[0], one[1])] if ((one[0] ^ one[1]) & ((1 << 64) - 1)).bit_count() <= distance else []
            else:
                found = forest(np.array(one, np.int64), np.array(two, np.int64) if two else None, distance) if one else []
            a += [x for x, _ in found]
            b += [x for _, x in found]
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return packed.select("left", "right").mapInArrow(per_batch(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id in the class of texts linked, through
    any number of links, by fingerprints that differ in at most ``distance``
    bits.  A null doc_id keeps its row and never names a class unless all its
    ids are null; repeated rows are rows; an empty table gives no rows.
    """
    spark = docs.sparkSession
    settle(spark)
    fps = staged(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), distance))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id")).select(apart(F.col("root")).alias("of"), "component_id")
    of = staged(named.join(smallest, F.col("root") == F.col("of")).select("fp", "root", "component_id"), "classes")
    return fps.join(of, "fp").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document with the
    smallest id, once; of several rows with that id the one with the smallest
    fingerprint, and any one row if all ids of a class are null.

    Only rows of repeated ids are told apart by their fingerprints, so a text
    stays whose id also names another text.  Null and empty texts are one
    class; an empty table gives no rows.
    """
    found = staged(near_duplicates(docs, id_col, text_col, shingle, distance, seed), "members")
    named = found.where(F.col("doc_id") == F.col("component_id")).groupBy("root", "doc_id").agg(F.min("fp").alias("fp"))
    rows = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    key, fps, many, at = (fresh(docs, name) for name in ("kept_id", "kept_fps", "kept_rows", "kept_fp"))
    kept = named.groupBy("doc_id").agg(F.collect_set("fp").alias(fps)).join(rows, "doc_id")
    kept = kept.select(apart(F.col("doc_id")).alias(key), fps, (F.col("rows") > 1).alias(many))
    met = docs.join(kept, F.col(f"`{id_col}`").cast("long") == F.col(key))
    single = met.where(~F.col(many)).select(*docs.columns)
    fp = fingerprint_column(text_col, shingle, seed)
    several = met.where(many).withColumn(at, fp).where(F.array_contains(F.col(fps), F.col(at))).dropDuplicates([key, at]).select(*docs.columns)
    nameless = docs.where(F.col(f"`{id_col}`").cast("long").isNull()).withColumn(at, fp)
    classes = found.where("component_id is null").groupBy("root").agg(F.min("fp").alias(at))
    nameless = nameless.join(classes.select(at), at, "left_semi").dropDuplicates([at]).select(*docs.columns)
    return single.unionByName(several).unionByName(nameless)


def fingerprint_column(text_col: str, shingle: int, seed: int):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("long")
    def of(text: pa.Array) -> pa.Array:
        out = []
        for _, _, data, bounds in W.slices(text):
            lowered = W.LOWER[data]
            out += [fingerprint(lowered[b:e].tobytes().split(), shingle, seed) for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        return pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())
    return of(F.col(f"`{text_col}`").cast("string"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint (16 hexadecimal digits) and class."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, shingle=3, distance=3, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
