"""Long repeated passages by compaction of a token de Bruijn graph.

An edge of the graph is a window of ``window`` consecutive words.  Edges are
taken together into paths before anything is shuffled: the smallest hash among
a window's ``anchor``-word runs is its anchor, and windows in a row over one
anchor place form one path.  Equal windows have equal anchors, so a window can
only repeat inside paths with an anchor that stands more than once.

1. Anchors are counted; a join keeps the paths over anchors that repeat.
2. Equal paths (the anchor and a 128-bit hash of their windows) are compacted to
   their first place.  A later place of a path that does not branch from
   another repeats as a whole: a span and its source.
3. Where paths over one anchor differ, the graph branches.  The first place of
   each such path is opened into its windows again, and a join finds those
   whose words also begin earlier.
4. Spans go back to their documents, where the source coordinates say which
   words to remove.

The keys of paths and windows are 128 bits of a cryptographic digest (BLAKE2b)
of the words at the places themselves, so equal keys say that the words at a
span and at its source coordinates are equal; the fast hashes only choose
anchors.  A document of a repeated or null id is told from others by 128 bits of its
text's digest; rows with one id and one text are one document.  Counts
and minima are partially aggregated, so a passage in a third of all documents
is no hot group, and joins can be split by the adaptive skew join.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from modelkeep.llm import words as W
from modelkeep.llm.common import LAST_ID, apart, fresh, per_batch, settle, staged


def _anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``window`` words: its smallest ``anchor``-run's hash, and the first place of that."""
    least, at = W.windows(h, anchor), None
    at, have, want = np.arange(len(least)), 1, window - anchor + 1
    while have < want:  # minima of twice as many places, or of as many as are still wanted
        step = min(have, want - have)
        n = len(least) - step
        if n <= 0:
            return least[:0], at[:0]
        right = least[step:] < least[:n]
        least, at, have = np.where(right, least[step:], least[:n]), np.where(right, at[step:], at[:n]), have + step
    return least, at


def _paths(data: np.ndarray, bounds: np.ndarray, window: int, anchor: int, hashed: bool):
    """The paths of a slice of texts: document, first window, windows, anchor and (``hashed``) two path hashes."""
    begin, end, first = W.spans(data, bounds, W.NOT_SPACE)
    h = W.hashes(data, begin, end)
    least, at = _anchors(h, window, anchor)
    ok = np.flatnonzero(W.starts(first, window))
    if not len(ok):
        return None
    own = at[ok]
    new = np.ones(len(ok), bool)
    new[1:] = own[1:] != own[:-1]
    head = np.flatnonzero(new)
    doc = np.searchsorted(first, ok[head], "right") - 1
    n = np.diff(np.append(head, len(ok)))
    out = [doc, ok[head] - first[doc], n, least[ok[head]].view(np.int64)]
    if hashed:
        # All of a path's words, and so its windows: at most 2 * window - anchor words.
        out += _digests(data, bounds, end - begin, ok[head], n + window - 1)
    return out


def _digests(data: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, first: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Two halves of a digest of each run of ``words`` words from the word ``first``."""
    raw = data.tobytes()
    texts = (b" ".join(raw[a:b].split()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    joined = memoryview(b" ".join([t for t in texts if t]))
    after = np.cumsum(lengths + 1) - 1
    begin = (after - lengths)[first].tolist()
    end = after[first + words - 1].tolist()
    made = b"".join([blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(begin, end)])
    both = np.frombuffer(made, np.int64).reshape(-1, 2)
    return [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (the id; null after all others), text_hash and text of each row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("doc"), _text_key(text).alias("text_hash"), text.alias("text"))


def _text_key(text):
    return F.unhex(F.md5(text))


def _anchor_counts(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batch):
        for _, _, data, bounds in W.slices(batch.column(0)):
            found = _paths(data, bounds, window, anchor, False)
            if found:
                own, n = np.unique(found[3], return_counts=True)
                yield pa.record_batch([pa.array(own), pa.array(n, pa.int64())], names=["anchor", "n"])
    return docs.select("text").mapInArrow(per_batch(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _path_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batch):
        for lo, hi, data, bounds in W.slices(batch.column(2)):
            found = _paths(data, bounds, window, anchor, True)
            if found:
                row, start, n, own, one, two = found
                rows = pa.array(row)
                yield pa.record_batch([pa.array(own), pa.array(one), pa.array(two), batch.column(0).slice(lo, hi - lo).take(rows),
                                       batch.column(1).slice(lo, hi - lo).take(rows), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                                      names=["anchor", "one", "two", "doc", "text_hash", "start", "n"])
    return docs.select("doc", "text_hash", "text").mapInArrow(per_batch(run), "anchor long, one long, two long, doc long, text_hash binary, start int, n int")


def _window_rows(opened: DataFrame, window: int) -> DataFrame:
    """(one, two, doc, text_hash, start): the windows of the paths listed with each text of ``opened``."""
    def run(batch):
        for lo, hi, data, bounds in W.slices(batch.column(2)):
            begin, end, first = W.spans(data, bounds, W.NOT_SPACE)
            paths = batch.column(3).slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), np.diff(paths.offsets.to_numpy()) if len(paths) else 0)
            flat = paths.flatten()
            start, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            total = int(n.sum())
            within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            rows, at = np.repeat(row, n), np.repeat(start, n) + within
            take = pa.array(rows)
            one, two = _digests(data, bounds, end - begin, first[rows] + at, np.full(total, window))
            yield pa.record_batch([pa.array(one), pa.array(two), batch.column(0).slice(lo, hi - lo).take(take),
                                   batch.column(1).slice(lo, hi - lo).take(take), pa.array(at, pa.int32())],
                                  names=["one", "two", "doc", "text_hash", "start"])
    return opened.mapInArrow(per_batch(run), "one long, two long, doc long, text_hash binary, start int")


def repeated_spans(docs: DataFrame, window: int = 20, anchor: int = 8) -> DataFrame:
    """(doc, text_hash, start, length, source, source_hash, source_start): runs
    of words of ``docs`` (doc, text_hash, text) whose every window also begins
    earlier, with where it does."""
    place = F.struct("doc", "text_hash", "start")
    seen = _anchor_counts(docs, window, anchor).where("n > 1").select(apart(F.col("anchor")).alias("repeated"))
    paths = staged(_path_rows(docs, window, anchor).join(seen, F.col("anchor") == F.col("repeated")).drop("repeated"), "paths")
    key = ["anchor", "one", "two", "n"]
    firsts = staged(paths.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("places")), "compacted")
    many = firsts.where("places > 1").select(apart(F.col("anchor")).alias("a"), F.col("one").alias("o"), F.col("two").alias("t"), F.col("n").alias("m"), "first")
    same = (F.col("anchor") == F.col("a")) & (F.col("one") == F.col("o")) & (F.col("two") == F.col("t")) & (F.col("n") == F.col("m"))
    source = (F.col("first.doc").alias("source"), F.col("first.text_hash").alias("source_hash"), F.col("first.start").alias("source_start"))
    later = paths.join(many, same).where(place != F.col("first")).select(
        "doc", "text_hash", "start", (F.col("n") + window - 1).alias("length"), *source)
    branching = firsts.groupBy("anchor").agg(F.count("*").alias("paths")).where("paths > 1").select(apart(F.col("anchor")).alias("b"))
    opened = firsts.join(branching, F.col("anchor") == F.col("b")).select("first.*", "n")
    listed = opened.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("paths")).select(
        apart(F.col("doc")).alias("d"), F.col("text_hash").alias("th"), "paths")
    with_text = docs.join(listed, (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("th"))).select("doc", "text_hash", "text", "paths")
    edges = staged(_window_rows(with_text, window), "edges")
    first = edges.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    first = first.select(apart(F.col("one")).alias("o"), F.col("two").alias("t"), "first")
    branches = edges.join(first, (F.col("one") == F.col("o")) & (F.col("two") == F.col("t"))).where(place != F.col("first")).select(
        "doc", "text_hash", "start", F.lit(window).alias("length"), *source)
    return later.unionByName(branches)


def _keep_words(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The words of each text outside its spans, each of which is start * 2^32 + length."""
    kept, n_words, n_removed = [], [], []
    for own, at in zip(text, spans):
        words = own.as_py().encode().split()
        n_words.append(len(words))
        if at.is_valid and len(at.values):
            span = at.values.to_numpy()
            begin, end = span >> 32, (span >> 32) + (span & 0xFFFFFFFF)
            gone = np.bincount(begin, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
            words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
        n_removed.append(n_words[-1] - len(words))
        kept.append(b" ".join(words).decode())
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                      names=["n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, anchor: int = 8) -> DataFrame:
    """``docs`` with three more columns: n_words, n_removed and kept, the words
    (joined by one space) that no window covers which also begins earlier: in a
    smaller id, or before in the same document.  Taken names get a ``_``.

    Null texts have no words.  Null ids come after all others; rows with one
    id and one text are the same document, rows with one id and different
    texts are documents in the order of their hashes.  An empty table gives no
    rows.
    """
    settle(docs.sparkSession)
    own = _documents(docs, id_col, text_col)
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("length")
    spans = repeated_spans(own, window, anchor).groupBy("doc", "text_hash").agg(F.collect_set(packed).alias("spans"))
    d, t, s, k = (fresh(docs, name) for name in ("span_doc", "span_hash", "spans", "kept_words"))
    spans = spans.select(apart(F.col("doc")).alias(d), F.col("text_hash").alias(t), F.col("spans").alias(s))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    joined = docs.join(spans, (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)) == F.col(d)) & (_text_key(text) == F.col(t)), "left")
    keep_words = arrow_udf(_keep_words, "n_words long, n_removed long, kept string")
    kept = joined.withColumn(k, keep_words(text, F.col(s)))
    return kept.select(*docs.columns, F.col(f"{k}.n_words").alias(fresh(docs, "n_words")), F.col(f"{k}.n_removed").alias(fresh(docs, "n_removed")),
                       F.col(f"{k}.kept").alias(fresh(docs, "kept")))


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    """Every document's words, words removed, and the digest of those kept."""
    done = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), window=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB: every window as its joined words, by its first place.
OP8_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS t
  FROM doc, LATERAL (SELECT unnest(generate_series(1, len(w) - 19)) AS s) WHERE len(w) >= 20),
earliest AS (SELECT t, min((doc_id, s)) AS f FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(s, s + 19)) AS p FROM win JOIN earliest USING (t) WHERE (doc_id, s) <> f)),
kept AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc),
of AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM kept k ANTI JOIN gone g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(o.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM doc d LEFT JOIN of o USING (doc_id)
"""
