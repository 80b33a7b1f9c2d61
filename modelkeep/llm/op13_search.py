"""Ranked lexical search by bags.

Only the terms of an item can add to a document's score, so a document counts
as its bag: how often each term of the items' vocabulary stands in it, and its
length figure m.  Documents with one bag have one score for every item.

1. Documents are read once: each becomes its bag, restricted to the
   vocabulary, with the number of all its terms.  A word is looked up by its
   hash and verified by its bytes.
2. Collection figures (documents, terms, documents of a term) are sums over the
   bags.
3. Equal bags with one m are a class: Spark's grouping hashes the bag and
   verifies it byte by byte.  A class keeps its ``k`` smallest ids, as no other
   member can be among the best ``k`` of an item.
4. Classes are scored once, in blocks: a term's items times its classes.  A
   task keeps the best ``k`` classes of each item, by score and smallest id.
5. The best ``k`` classes of an item give their members by ascending id.

Items are taken in parts of at most ``PART`` distinct (item, term) pairs (or one
item) and ``ITEMS`` items; a part's index is broadcast, and documents are read
once for each part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelkeep.llm import words as W
from modelkeep.llm.common import LAST_ID, apart, id_and_text, per_batch, settle, staged

#: (item, term) pairs that are broadcast at once; about 100 MB of terms at most.
PART = 1 << 20

#: Items of a part, which bounds what a task keeps: ``k`` classes an item.
ITEMS = 1 << 14

#: Cells (items x classes) of a block: 64 MB.
BLOCK = 1 << 23


def terms_of(data: np.ndarray, bounds: np.ndarray):
    """Lower-cased bytes and the begin, end and first place of the terms of each text."""
    data = W.LOWER[data]
    return (data, *W.spans(data, bounds, W.LETTERS))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, times): the terms of each row of ``items`` (item, text)."""
    def run(batch):
        for lo, hi, data, bounds in W.slices(batch.column(1)):
            data, begin, end, first = terms_of(data, bounds)
            raw = data.tobytes()
            words = pa.array([raw[b:e] for b, e in zip(begin.tolist(), end.tolist())], pa.binary())
            rows = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), np.diff(first))))
            yield pa.record_batch([rows, words], names=["item", "term"])
    return items.select("item", "text").mapInArrow(per_batch(run), "item long, term binary").groupBy("item", "term").agg(F.count("*").alias("times"))


def bags(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, bag) of each row of ``docs`` (doc_id, text): all its terms,
    and the vocabulary's: pairs of 32-bit id and 32-bit count, by id."""
    def run(batch):
        own = vocabulary.value
        for lo, hi, data, bounds in W.slices(batch.column(1)):
            data, begin, end, first = terms_of(data, bounds)
            n = np.diff(first)
            id_ = own.find(data, begin, end)
            hit = np.flatnonzero(id_ >= 0)
            doc = np.repeat(np.arange(hi - lo), n)[hit]
            pair, times = np.unique(doc * max(own.size, 1) + id_[hit], return_counts=True)
            packed = np.column_stack([pair % max(own.size, 1), times]).astype("<i4").tobytes()
            cuts = 8 * np.searchsorted(pair, np.arange(hi - lo + 1) * max(own.size, 1))
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(packed)])
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), made.cast(pa.binary())], names=["doc_id", "n", "bag"])
    return docs.select("doc_id", "text").mapInArrow(per_batch(run), "doc_id long, n long, bag binary")


def _unpacked(bag: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each pair of an array of bags."""
    bag = bag.cast(pa.large_binary())
    bounds = np.frombuffer(bag.buffers()[1], np.int64)[bag.offset:bag.offset + len(bag) + 1]
    data = bag.buffers()[2]
    pairs = np.frombuffer(data, "<i4")[bounds[0] // 4:bounds[-1] // 4].reshape(-1, 2) if data is not None and bounds[-1] else np.zeros((0, 2), "<i4")
    return np.repeat(np.arange(len(bag)), np.diff(bounds) // 8), pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def document_frequencies(bagged: DataFrame) -> DataFrame:
    """(term, df): in how many of the rows each term stands."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = np.bincount(_unpacked(batch.column(0))[1], minlength=len(total))
                own[:len(total)] += total
                total = own
        term = np.flatnonzero(total)
        yield pa.record_batch([pa.array(term, pa.int32()), pa.array(total[term], pa.int64())], names=["term", "df"])
    return bagged.select("bag").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def classes(bagged: DataFrame, documents: int, terms: int, k: int) -> DataFrame:
    """(class, bag, m, members): documents of equal bag and m once, with their ``k`` smallest ids."""
    m = F.expr(f"cast(75 + (cast(25 as decimal(38, 0)) * n * {documents}) div {max(terms, 1)} as long)")
    held = bagged.where(F.length("bag") > 0).select("bag", m.alias("m"), "doc_id")
    ranked = held.withColumn("r", F.row_number().over(Window.partitionBy("bag", "m").orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("r") <= k)
    members = F.transform(F.array_sort(F.collect_list(F.struct("r", "doc_id"))), lambda x: x["doc_id"])
    return ranked.groupBy("bag", "m").agg(members.alias("members")).withColumn("class", F.monotonically_increasing_id())


class Index:
    """Items by term: for term t, places ``cuts[t]`` to ``cuts[t + 1]`` hold
    its items and their weights (times how often they hold it)."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray):
        order = np.lexsort((item, term))
        self.keys, self.item = np.unique(item[order], return_inverse=True)
        self.weight = times[order] * weight[term[order]]
        self.cuts = np.searchsorted(term[order], np.arange(len(weight) + 1))


class Best:
    """The best ``k`` classes of each item so far: by score, then by smallest id."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = np.zeros((4, 0), np.int64)  # item, score, smallest id, class

    def add(self, scores: np.ndarray, first_id: np.ndarray, class_: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.least[:, None])
        rows = np.concatenate([self.rows, np.stack([item, scores[item, at], first_id[at], class_[at]])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        heads = np.flatnonzero(np.diff(rows[0], prepend=-1))
        rank = np.arange(rows.shape[1]) - np.repeat(heads, np.diff(np.append(heads, rows.shape[1])))
        self.rows = rows[:, rank < self.k]
        last = rows[:, rank == self.k - 1]
        self.least[last[0]] = last[1]


def block_scores(index: Index, items: int, row: np.ndarray, term: np.ndarray, times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores (items x classes) of a block of classes, in 64-bit integers."""
    scores = np.zeros((items, len(m)), np.int64)
    part = (1_000_000_000 * times) // (1000 * times + 12 * m[row])
    order = np.argsort(term, kind="stable")
    term, row, part = term[order], row[order], part[order]
    cuts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        t = term[lo]
        a, b = index.cuts[t], index.cuts[t + 1]
        scores[index.item[a:b, None], row[lo:hi]] += index.weight[a:b, None] * part[lo:hi]
    return scores


def best_classes(found: DataFrame, index, k: int) -> DataFrame:
    """(item, score, first_id, class): for each item the best ``k`` classes of
    each task, over ``found`` (class, bag, m, members)."""
    def run(batches):
        own = index.value
        best, held, count = Best(len(own.keys), k), [], 0
        block = max(64, min(1024, BLOCK // max(1, len(own.keys))))

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            first = table["first_id"].to_numpy()
            row, term, times = _unpacked(table["bag"].combine_chunks() if table["bag"].num_chunks != 1 else table["bag"].chunk(0))
            best.add(block_scores(own, len(own.keys), row, term, times, table["m"].to_numpy()), first, table["class"].to_numpy())
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
                if count >= block:
                    flush()
                    held, count = [], 0
        if held:
            flush()
        item, score, first, class_ = best.rows
        yield pa.record_batch([pa.array(own.keys[item], pa.int64()), pa.array(score), pa.array(first), pa.array(class_)],
                              names=["item", "score", "first_id", "class"])
    first_id = F.coalesce(F.element_at("members", 1), F.lit(LAST_ID)).alias("first_id")
    return found.select("class", "bag", "m", first_id).mapInArrow(run, "item long, score long, first_id long, class long")


def _part(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score) for the items of ``pairs`` (item, term, times), at most ``PART`` rows or one item's."""
    spark = docs.sparkSession
    table = pairs.toArrow()
    vocabulary = table["term"].unique().sort().to_pylist() if table.num_rows else []
    id_of = {t: j for j, t in enumerate(vocabulary)}
    bagged = staged(bags(docs, spark.sparkContext.broadcast(W.Vocabulary(vocabulary))), "bags")
    documents, terms = (int(x or 0) for x in bagged.agg(F.count_if(F.col("n") > 0), F.sum("n")).first())
    weight = np.zeros(len(vocabulary), np.int64)
    for term, df in document_frequencies(bagged).collect():  # a row for each term of the part
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    term = np.array([id_of[t] for t in table["term"].to_pylist()], np.int64)
    index = spark.sparkContext.broadcast(Index(table["item"].to_numpy().astype(np.int64), term, table["times"].to_numpy().astype(np.int64), weight))
    found = staged(classes(bagged, documents, terms, k), "classes")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "first_id", "class")
    best = best_classes(found, index, k).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    best = best.select("item", "score", apart(F.col("class")).alias("of"))
    return best.join(found.select("class", "members"), F.col("class") == F.col("of")).select("item", F.explode("members").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item,
    equal scores by ascending id.

    Null texts have no terms.  Null ids come after all others; each row of
    ``docs`` is a document and each row of ``items`` an item, repeated ones and
    those with null ids too.  Items without terms, and empty tables, give no rows.
    """
    spark = docs.sparkSession
    settle(spark)
    own = id_and_text(docs, id_col, text_col)
    asked = staged(items.select(F.col(f"`{item_id_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    pairs = staged(item_terms(asked), "item-terms")
    parts = 1
    while True:
        part = F.pmod(F.xxhash64("item"), F.lit(parts))
        sizes = pairs.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_distinct("item").alias("own")).where(
            f"(n > {PART} and own > 1) or own > {ITEMS}")
        if sizes.isEmpty():
            break
        parts *= 2
    found = None
    for one in range(parts):
        made = _part(own, pairs if parts == 1 else pairs.where(part == one), k)
        found = made if found is None else found.unionAll(staged(made, "found"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select(apart(F.col("item")).alias("of"), "item_id")
    return ranked.join(names, F.col("item") == F.col("of")).select("item_id", "rank", "doc_id", "score")


def op13_search(spark, sf_dir: str) -> DataFrame:
    """Each benchmark item's 20 best documents."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


#: DuckDB: every posting of every item's terms.
OP13_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (
  SELECT row_number() OVER () AS i, item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
total AS (SELECT CAST(count(*) FILTER (WHERE len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(w) AS t FROM doc) GROUP BY d, t),
df AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY t, n_docs),
q AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(w) AS t FROM item) GROUP BY i, t),
m AS (SELECT d, doc_id, 100 - 25 + (25 * len(w) * n_docs) // n_terms AS m FROM doc, total WHERE len(w) > 0),
scored AS (
  SELECT i, d, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN df USING (t) JOIN tf USING (t) JOIN m USING (d) GROUP BY i, d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN item USING (i) WHERE rank <= 20
"""
