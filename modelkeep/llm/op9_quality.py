"""Document quality by hierarchical empirical Bayes.

The evidence of a document is the log odds of a classifier on its text's
statistics.  To that come a site's and a section's (host and path level) own
rates of good documents, as far as their labelled documents speak for
themselves: a host's rate shrinks towards the global one, a path's towards its
host's.  How strongly, is estimated from how much the rates differ between
hosts (and between paths of a host) beyond chance, by moments.  Sites with few
or no labels so get the prior's rate.

Site rates are grouped aggregates of labels; only the classifier is fitted to
a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelkeep.llm import words as W
from modelkeep.llm.common import fold, per_batch, settle, staged
from modelkeep.llm.logistic import regression

#: Labelled documents the classifier is fitted to, about, at most.
SAMPLE = 20_000

FEATURES = ("log_words", "word_length", "distinct", "commonest", "run", "upper", "digits", "signs", "bars", "shouts", "lines")

_CLASS = np.zeros(256, np.int64)  # 0: other
for _k, _chars in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b"#$%&*@^~<>{}[]\\=_", b"|", b"!?", b"\n", [0x20, 0x09, 0x0D]), 1):
    _CLASS[list(_chars)] = _k


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row for each text of a slice.  Shares are square roots, so that a
    small part of junk already shows."""
    n = len(bounds) - 1
    begin, end, first = W.spans(data, bounds, W.NOT_SPACE)
    h = W.hashes(W.LOWER[data], begin, end)
    n_words = np.diff(first)
    text = np.repeat(np.arange(n), np.diff(bounds))
    classes = np.bincount(text * 16 + _CLASS[data], minlength=16 * n).reshape(n, 16)
    size = np.maximum(1, np.diff(bounds))
    word_text = np.repeat(np.arange(n), n_words)
    order = np.lexsort((h, word_text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (word_text[order][1:] != word_text[order][:-1])
    heads = np.flatnonzero(new)
    distinct = np.bincount(word_text[order][heads], minlength=n)
    commonest = np.zeros(n)
    np.maximum.at(commonest, word_text[order][heads], np.diff(np.append(heads, len(h))))
    again = np.bincount(word_text[1:][(h[1:] == h[:-1]) & (word_text[1:] == word_text[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    most = np.maximum(1, n_words)
    share = lambda x, y: np.sqrt(x / y)
    return np.column_stack([np.log1p(n_words), size / most / 10.0, distinct / most, share(commonest, most), share(again, most), share(classes[:, 2], size),
                            *(share(classes[:, k], size) for k in (3, 4, 5, 6, 7))])


def _feature_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and x, the features of ``text``."""
    kinds = dict(docs.dtypes)

    def run(batch):
        for lo, hi, data, bounds in W.slices(batch.column(0)):
            x = features(data, bounds)
            yield pa.record_batch([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), pa.array(list(x), pa.list_(pa.float64()))], names=[*columns, "x"])
    return docs.select("text", *columns).mapInArrow(per_batch(run), ", ".join(f"{c} {kinds[c]}" for c in columns) + ", x array<double>")


def _strength(groups: DataFrame, good: str, n: str, mean: str) -> float:
    """Documents that a prior counts for: how little the groups' rates differ
    from ``mean`` beyond what chance explains."""
    good, n, mean = F.col(good), F.col(n), F.col(mean)
    row = groups.where(n > 1).agg(F.sum(n * F.pow(good / n - mean, 2)).alias("between"), F.sum(mean * (1 - mean)).alias("chance"),
                                  F.sum(n * mean * (1 - mean)).alias("weight"), F.count("*").alias("groups")).first()
    if not row["groups"] or not row["weight"]:
        return 100.0
    # E between = sum of m(1-m) * (1 + (n-1) rho); rho is 1 / (strength + 1).
    rho = (row["between"] - row["chance"]) / max(1e-9, row["weight"] - row["chance"])
    return min(1e6, max(1.0, 1.0 / rho - 1.0)) if rho > 1e-6 else 1e6


def quality(docs: DataFrame, labels: DataFrame, train: Column, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", bound: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, evidence (the classifier's
    log odds), host_rate and path_rate (shrunk shares of good documents),
    score (0 to 1) and predicted (1 if score >= 0.5).

    ``train`` is a condition on ``docs``' id column, ``host`` and ``path`` are
    expressions on ``docs``.  Null texts are empty, null hosts and paths are
    the site ``""``; labels of one id are averaged, null ids and labels take
    no part.  Without both kinds of labels the evidence is 0; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    settle(spark)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                      F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
                      F.coalesce(train, F.lit(False)).alias("train"))
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("labelled"), F.col(f"`{label_col}`").cast("double").alias("good")).where(
        "labelled is not null and good is not null").groupBy("labelled").agg((F.avg("good") >= 0.5).cast("int").alias("good"))
    named = staged(named, "quality-labels")
    part = min(1.0, bound / max(1, named.count()))
    few = named.where(F.pmod(F.xxhash64("labelled"), F.lit(1 << 20)) < int(part * (1 << 20)))
    rows = _feature_rows(own.where("train").join(F.broadcast(few), F.col("doc_id") == F.col("labelled")).select("text", "good"), "good").toArrow()
    y = rows["good"].to_numpy().astype(float) if rows.num_rows else np.zeros(0)
    weights = np.zeros(len(FEATURES) + 1)
    if 0 < y.sum() < len(y):
        x = np.array(rows["x"].to_pylist())
        middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        w = regression((x - middle) / spread, y)
        weights = np.append(w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum())

    def run(batch):
        ids, host_, path_ = batch.column(0), batch.column(1), batch.column(2)
        for lo, hi, data, bounds in W.slices(batch.column(3)):
            z = np.clip(features(data, bounds) @ weights[:-1] + weights[-1], -30, 30)
            yield pa.record_batch([c.slice(lo, hi - lo) for c in (ids, host_, path_)] + [pa.array(z)], names=["doc_id", "host", "path", "evidence"])
    evidence = own.select("doc_id", "host", "path", "text").mapInArrow(per_batch(run), "doc_id long, host string, path string, evidence double")
    # Rates per path of all labelled training documents; repeated rows of one id count once.
    sites = own.where("train").select("doc_id", "host", "path").distinct().join(named, F.col("doc_id") == F.col("labelled"))
    paths = staged(sites.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    good, n = paths.agg(F.sum("good"), F.sum("n")).first()
    mean = ((good or 0) + 1.0) / ((n or 0) + 2.0)
    hosts = staged(hosts.withColumn("mean", F.lit(mean)), "hosts")
    strong = _strength(hosts, "host_good", "host_n", "mean")
    hosts = hosts.select(F.concat("host", F.lit("")).alias("of_host"), ((F.col("host_good") + strong * F.col("mean")) / (F.col("host_n") + strong)).alias("host_rate"))
    within = staged(paths.join(hosts, F.col("host") == F.col("of_host")).drop("of_host"), "paths-in-hosts")
    inner = _strength(within, "good", "n", "host_rate")
    path_rates = within.select(F.col("host").alias("path_host"), F.col("path").alias("of_path"),
                               ((F.col("good") + inner * F.col("host_rate")) / (F.col("n") + inner)).alias("path_rate"))
    met = evidence.join(hosts, F.col("host") == F.col("of_host"), "left").join(
        path_rates, (F.col("host") == F.col("path_host")) & (F.col("path") == F.col("of_path")), "left")
    host_rate = F.coalesce("host_rate", F.lit(mean))
    path_rate = F.coalesce("path_rate", host_rate)
    odds = lambda p: F.log(p / (1 - p))
    score = 1 / (1 + F.exp(-(F.col("evidence") + odds(path_rate) - odds(F.lit(mean)))))
    return met.select("doc_id", "evidence", host_rate.alias("host_rate"), path_rate.alias("path_rate"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality; source stands for the host, the source's
    language section for the path.  Labels of crc32(doc_id) mod 5 = 0 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id")) > 0, F.col("source"), F.col("lang"))
    return done.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "evidence", "host_rate", "path_rate")
