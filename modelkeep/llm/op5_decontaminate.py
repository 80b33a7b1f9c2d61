"""Benchmark decontamination as a prefix-filtered set join.

A window of an item is a set of short word shingles that a document must
contain whole, so one shingle of it - the necessary prefix at containment
1 - is enough to find every document that can hold it.  Shingles are ordered
by rarity, counted over all documents; each window joins on its rarest one.
What the join yields must pass the positional and length bounds (the window
fits into the document around the shingle) and then equals the document's
words exactly, word by word.

Documents send only shingles that a bitmap of fixed size (``BITMAP_BITS``)
knows from the benchmark.  A bit set by chance costs a row that the join
drops; with a very large benchmark the bitmap fills and the join carries more
rows, but the result stays the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeep.llm import words as W
from modelkeep.llm.common import fresh, id_and_text, per_batch, settle, staged

#: 8 MB, whatever the benchmark's size.
BITMAP_BITS = 1 << 26
_BLOCK = 1 << 16

SHINGLE = 3


def _sized(data, bounds, sizes):
    """Words of texts and, for each shingle size, the hash of each shingle and where it starts."""
    data = W.LOWER[data]
    begin, end, first = W.spans(data, bounds, W.LETTERS)
    h = W.hashes(data, begin, end)
    found = {}
    for size in sizes:
        at = np.flatnonzero(W.starts(first, size))
        found[size] = (W.windows(h, size)[at].view(np.int64), at)
    return data, begin, end, first, found


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(item_id, start, words, shingle, size, at): each window of each item
    with each of its shingles, ``at`` words from the window's start.

    A window is ``window`` consecutive words; an item of fewer words, but not
    none, is one window.  Null texts have no words, rows with a null id give no
    rows, repeated rows repeat theirs.
    """
    def run(batch):
        for lo, hi, data, bounds in W.slices(batch.column(1)):
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            data, begin, end, first, found = _sized(data, bounds, range(1, SHINGLE + 1))
            raw, at_of = data.tobytes(), {}
            for size, (h, at) in found.items():
                at_of[size] = dict(zip(at.tolist(), h.tolist()))
            rows = []
            for k, item in enumerate(ids):
                a, b = int(first[k]), int(first[k + 1])
                if a == b or item is None:
                    continue
                length = min(window, b - a)
                size = min(SHINGLE, length)
                own = [raw[x:y].decode("utf-8", "replace") for x, y in zip(begin[a:b].tolist(), end[a:b].tolist())]
                for start in range(b - a - length + 1):
                    text = " ".join(own[start:start + length])
                    rows += [(item, start, length, text, at_of[size][a + start + j], size, j) for j in range(length - size + 1)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
    schema = pa.schema([("item_id", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("words", pa.string()),
                        ("shingle", pa.int64()), ("size", pa.int32()), ("at", pa.int32())])
    own = items.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(per_batch(run), "item_id string, start int, length int, words string, shingle long, size int, at int")


def bitmap(shingles: DataFrame) -> np.ndarray:
    """One bit for each value of ``shingle``, in ``BITMAP_BITS`` bits; made in
    blocks by the executors, of which the driver joins a fixed number."""
    bit = F.pmod(F.col("shingle"), F.lit(BITMAP_BITS))
    blocks = shingles.select((bit / _BLOCK).cast("int").alias("block"), (bit % _BLOCK).cast("int").alias("bit")).groupBy("block").agg(
        F.collect_set("bit").alias("bits"))

    def run(batch):
        out = []
        for bits in batch.column(1).to_pylist():
            own = np.zeros(_BLOCK, bool)
            own[bits] = True
            out.append(np.packbits(own).tobytes())
        return pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["block", "bytes"])
    whole = np.zeros((BITMAP_BITS // _BLOCK, _BLOCK // 8), np.uint8)
    for block, own in blocks.mapInArrow(per_batch(run), "block int, bytes binary").collect():
        whole[block] = np.frombuffer(own, np.uint8)
    return whole.ravel()


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.int64(BITMAP_BITS - 1)
    return (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def shingle_counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """(shingle, n): how often each shingle that ``bits`` knows stands in ``docs`` (doc_id, text)."""
    def run(batch):
        for _, _, data, bounds in W.slices(batch.column(0)):
            found = _sized(data, bounds, sizes)[-1]
            hits = np.concatenate([h[_known(bits.value, h)] for h, _ in found.values()])
            own, n = np.unique(hits, return_counts=True)
            yield pa.record_batch([pa.array(own, pa.int64()), pa.array(n, pa.int64())], names=["shingle", "n"])
    return docs.select("text").mapInArrow(per_batch(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def shingle_places(docs: DataFrame, bits, sizes: list[int], window: int) -> DataFrame:
    """(doc_id, text_hash, n_words, shingle, size, place, from, around): each
    place of a known shingle, with the words that a window over it can hold."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int32()), ("shingle", pa.int64()), ("size", pa.int32()),
                        ("place", pa.int32()), ("from", pa.int32()), ("around", pa.list_(pa.string()))])

    def run(batch):
        for lo, hi, data, bounds in W.slices(batch.column(2)):
            ids, hashes = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 1))
            data, begin, end, first, found = _sized(data, bounds, sizes)
            raw, rows = data.tobytes(), []
            for size, (h, at) in found.items():
                reach = window - size if size == SHINGLE else 0
                hit = np.flatnonzero(_known(bits.value, h))
                doc = np.searchsorted(first, at[hit], "right") - 1
                for place, shingle, k in zip(at[hit].tolist(), h[hit].tolist(), doc.tolist()):
                    a, b = int(first[k]), int(first[k + 1])
                    x, y = max(a, place - reach), min(b, place + size + reach)
                    around = [raw[p:q].decode("utf-8", "replace") for p, q in zip(begin[x:y].tolist(), end[x:y].tolist())]
                    rows.append((ids[k], hashes[k], b - a, shingle, size, place - a, x - a, around))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return docs.select("doc_id", "text_hash", "text").mapInArrow(
        per_batch(run), "doc_id long, text_hash long, n_words int, shingle long, size int, place int, `from` int, around array<string>")


def occurrences(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, text_hash, start, length, item_id): each place in ``docs``
    (doc_id, text_hash, text) where a window of an item stands.  Repeated items
    count once, repeated documents each; without windows there are no rows."""
    spark = docs.sparkSession
    # Rows of the benchmark may repeat; `found` below counts each shingle of a window once.
    candidates = staged(item_windows(items, window=window).distinct(), "item-windows")
    sizes = [r[0] for r in candidates.select("size").distinct().collect()]
    if not sizes:
        return spark.createDataFrame([], "doc_id long, text_hash long, start int, length int, item_id string")
    known = spark.sparkContext.broadcast(bitmap(candidates.select("shingle").distinct()))
    counts = staged(shingle_counts(docs, known, sizes), "shingle-counts")
    rarest = candidates.join(counts, "shingle").groupBy("item_id", "start", "length", "words").agg(
        F.min(F.struct("n", "shingle", "at")).alias("r"), F.count("*").alias("found"), F.first("size").alias("size"))
    # A window of which some shingle stands in no document stands in none.
    rarest = staged(rarest.where(F.col("found") == F.col("length") - F.col("size") + 1).select(
        "item_id", "length", "words", F.col("r.shingle").alias("shingle"), F.col("r.at").alias("at"), "size"), "prefixes")
    prefixes = spark.sparkContext.broadcast(bitmap(rarest.select("shingle").distinct()))
    wanted = rarest.groupBy("words", "length", "shingle", "at", "size").agg(F.collect_set("item_id").alias("items"))
    places = shingle_places(docs, prefixes, sizes, window)
    start = F.col("place") - F.col("at")
    inside = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = F.array_join(F.slice("around", F.greatest(start - F.col("from"), F.lit(0)) + 1, F.col("length")), " ") == F.col("words")
    return (places.join(wanted, ["shingle", "size"]).where(inside & same)
            .select("doc_id", "text_hash", start.alias("start"), "length", F.explode("items").alias("item_id")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_words, n_hit
    (words inside an occurrence of an item's window), n_items, items (sorted
    as strings), contaminated (n_hit > 0 and share * n_hit >= n_words).

    Null texts have no words, null item ids take no part, item ids of any type
    count as texts; rows with one id and
    different texts are judged each on its own; empty tables give no rows, or
    documents without hits.
    """
    settle(docs.sparkSession)
    own = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    bench = items.select(F.col(f"`{item_id_col}`").cast("string").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    found = staged(occurrences(own, bench, window).distinct(), "occurrences")
    after = F.col("start") + F.col("length")
    # Overlapping occurrences count once: each adds its words beyond all that begin before it.
    merged = F.aggregate(F.array_sort(F.collect_set(F.struct("start", after.alias("after")))),
                         F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                         lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["after"] - F.greatest(x["start"], acc["to"]))).alias("n"),
                                                 F.greatest(acc["to"], x["after"]).alias("to")), lambda acc: acc["n"])
    of = found.groupBy("doc_id", "text_hash").agg(merged.cast("long").alias("n_hit"),
                                                  F.array_sort(F.collect_set("item_id")).alias("items"))
    of = of.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "n_hit", "items")

    def count(batch):
        n = np.concatenate([np.diff(W.spans(W.LOWER[d], b, W.LETTERS)[2]) for _, _, d, b in W.slices(batch.column(2))])
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "text_hash", "n_words"])
    counted = own.select("doc_id", "text_hash", "text").mapInArrow(per_batch(count), "doc_id long, text_hash long, n_words long")
    joined = counted.join(of, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "text_hash", "n_words", hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
                         ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, items, id_col, text_col, **options).where("contaminated").select("doc_id", "text_hash").distinct()
    a, b = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    bad = bad.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.join(bad, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(text) == F.col(b)), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and items, and whether it is contaminated."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, share=20)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: DuckDB: the same windows as joined strings, by plain joins.
OP5_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS t
  FROM item, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 12))) AS s) WHERE len(w) > 0),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM doc, size, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS s) WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.s, a.n, w.item_id FROM place a JOIN win w ON a.t = w.t AND a.n = w.n),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN its USING (doc_id)
"""
