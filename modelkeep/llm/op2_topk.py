"""Exact top-k by inner product: columnar branch-and-bound.

Every query first meets the head, a bounded number of the candidates with the
largest norms, in its own task.  Its k-th best score there is a floor: by
Cauchy's inequality no candidate of a norm below floor / |query| can be among
its k best.  The other candidates stand in bands of norms, a band in blocks of
bounded size; queries of a like reach stand together in blocks too.  Queries
and candidates meet in the cells of a grid, and neither is copied to a cell
that the bound rules out.

Inside a cell the candidates stand in vertical layout, one array per
dimension.  A query's scores grow by one block of dimensions at a time; after
each block the candidates that can't reach its floor or its k-th best score
any more, by Cauchy's bound on the remaining mass, are dropped and the rest
compacted.  Ties survive, as the bound drops only what must score less.  Each
cell returns at most k rows a query, none below its floor, and a window with a
limit keeps the k best of all cells.
"""

from __future__ import annotations

import bisect
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelkeep.llm.common import settle, staged

#: Queries and candidates of a cell, about, at most, and the bytes of either; the least number of cells, so that a small table spreads too.
QUERIES, CANDIDATES, CELL_BYTES, CELLS = 8192, 65536, 1 << 26, 48

#: Candidates that every query meets first, at most, and their bytes.
HEAD, HEAD_BYTES = 4096, 1 << 23

#: A band of norms reaches from one power of this to the next.  Norms are 0 or from 1 to
#: 2^62 times the root of the dimensions, so there are about 2,600 bands at most.
BAND = 1.02

#: Candidates that go through the dimensions together, and dimensions of a block.
CHUNK, BLOCK = 4096, 16

#: Sums of products below this are exact in double precision.
_EXACT = float(1 << 52)


#: Scores and components beyond 64 bits count as the nearest number of 64 bits.
_MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v, row, norm): floor(scale * x) of every component, as
    integers, of every row, a number of the row and a bound of its norm; ids
    may be null or repeated.

    Vectors that are null or hold null or non-finite components or none at
    all take no part.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    whole = vectors.where(F.size(x) > 0).where(F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))))
    large = float(1 << 62)
    value = lambda c: F.floor(F.greatest(F.lit(-large), F.least(F.lit(large), c * scale))).cast("long")
    square = lambda total, c: total + c.cast("double") * c.cast("double")
    return whole.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, value).alias("v"), F.monotonically_increasing_id().alias("row")).withColumn(
        "norm", F.sqrt(F.aggregate("v", F.lit(0.0), square)) * (1 + 1e-9))


def band_of(norm: Column) -> Column:
    """The band of a norm; of norms below 1, so of 0, the lowest, -1."""
    return F.when(norm < 1, F.lit(-1)).otherwise(F.floor(F.log(norm) / math.log(BAND)).cast("int"))


class _Columns:
    """A chunk of candidates, one array per dimension, with the mass left after each block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.exact = ids, rows
        self.columns = np.ascontiguousarray(rows.T.astype(np.float64))
        squares = self.columns ** 2
        cuts = range(0, len(self.columns), BLOCK)
        self.left = [np.sqrt(squares[at:].sum(axis=0)) * (1 + 1e-9) for at in [*cuts, len(self.columns)]]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by the smaller id."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def chunks_of(ids: np.ndarray, rows: np.ndarray) -> list[_Columns]:
    return [_Columns(ids[at:at + CHUNK], rows[at:at + CHUNK]) for at in range(0, len(ids), CHUNK)]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, floors=None, chunks: list[_Columns] | None = None):
    """For each query row its k best candidate rows but itself: (query row, rows, scores).

    Rows are known by numbers, which also order equal scores.  A query's
    candidates below its number in ``floors`` (or None) are left out;
    ``chunks`` may hold the candidates in vertical layout already.
    """
    floors = [None] * len(query_ids) if floors is None else floors
    dims = queries.shape[1]
    # Values so large that doubles could round: whole numbers of any size.
    biggest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * dims
    if biggest >= _EXACT:
        for own, q, least in zip(query_ids, queries.astype(object), floors):
            other = np.flatnonzero(ids != own)
            scores = [max(-_MOST - 1, min(_MOST, int(s))) for s in rows[other].astype(object) @ q]
            top = sorted((x for x in zip(scores, ids[other].tolist()) if least is None or x[0] >= least), key=lambda x: (-x[0], x[1]))[:k]
            yield own, np.array([i for _, i in top], np.int64), [s for s, _ in top]
        return
    chunks = chunks_of(ids, rows) if chunks is None else chunks
    real = queries.astype(np.float64)
    cuts = list(range(0, dims, BLOCK))
    left = np.stack([np.sqrt((real[:, at:] ** 2).sum(axis=1)) for at in [*cuts, dims]], axis=1) * (1 + 1e-9)
    for n, own in enumerate(query_ids):
        q, top_ids, top = real[n], np.zeros(0, np.int64), np.zeros(0)
        given = -math.inf if floors[n] is None else float(floors[n])
        for chunk in chunks:
            alive = np.flatnonzero(chunk.ids != own)
            scores = np.zeros(len(alive))
            floor = max(given, top[-1]) if len(top) == k else given
            for b, at in enumerate(cuts):
                block = chunk.columns[at:at + BLOCK]
                scores = scores + q[at:at + BLOCK] @ (block if len(alive) == block.shape[1] else block[:, alive])
                slack = left[n, b + 1] * chunk.left[b + 1][alive]
                if floor == -math.inf and len(alive) > 4 * k:
                    # The k-th best that the candidates at hand are sure to reach.
                    sure = scores - slack
                    floor = np.partition(sure, len(sure) - k)[len(sure) - k]
                keep = scores + slack >= floor - 1e-6
                if not keep.all():
                    alive, scores = alive[keep], scores[keep]
                if not len(alive):
                    break
            merged_ids, merged = np.concatenate([top_ids, chunk.ids[alive]]), np.concatenate([top, scores])
            best = _best(merged_ids, merged, k)
            top_ids, top = merged_ids[best], merged[best]
        yield own, top_ids, [int(s) for s in top]


class _Block:
    """Candidates in the order of ties (by id, null ids last, then row), laid out once."""

    def __init__(self, ids: list, rows: list[int], values: np.ndarray):
        order = sorted(range(len(rows)), key=lambda n: (ids[n] is None, ids[n] or 0, rows[n]))
        self.ids, self.rows, self.values = [ids[n] for n in order], [rows[n] for n in order], values[order].astype(np.int64)
        self.number = {r: n for n, r in enumerate(self.rows)}
        self.chunks = chunks_of(np.arange(len(order)), self.values)

    def best(self, rows: list[int], values: np.ndarray, k: int, floors=None):
        """For each query its k best: (its place, [(row, id, score)])."""
        mine = np.array([self.number.get(r, -1 - n) for n, r in enumerate(rows)], np.int64)
        found = search(mine, values.astype(np.int64), np.arange(len(self.rows)), self.values, k, floors, self.chunks)
        for n, (_, places, scores) in enumerate(found):
            yield n, [(self.rows[p], self.ids[p], s) for p, s in zip(places.tolist(), scores)]


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


_FOUND = "array<struct<row: long, vec_id: long, score: long>>"


def _after_head(asked: DataFrame, head: list, k: int) -> DataFrame:
    """``asked`` with found, the k best of ``head`` for each query, and floor,
    the k-th score (null: fewer)."""
    kinds = dict(asked.dtypes)
    parts: dict[int, list] = {}
    for r in head:
        parts.setdefault(len(r["v"]), []).append(r)
    parts = {dims: ([r["vec_id"] for r in some], [r["row"] for r in some], np.array([r["v"] for r in some], np.int64)) for dims, some in parts.items()}
    shape = pa.list_(pa.struct([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    def run(batches):
        blocks = {dims: _Block(*some) for dims, some in parts.items()}
        for batch in batches:
            found, rows = [[] for _ in range(batch.num_rows)], batch["row"].to_pylist()
            sizes = batch["dims"].to_numpy()
            for dims in set(sizes.tolist()) & set(blocks):
                at = np.flatnonzero(sizes == dims)
                for n, best in blocks[dims].best([rows[x] for x in at], _matrix(batch["v"].take(pa.array(at))), k):
                    found[at[n]] = [{"row": r, "vec_id": i, "score": s} for r, i, s in best]
            floor = [x[-1]["score"] if len(x) == k else None for x in found]
            yield pa.record_batch([*batch.columns, pa.array(found, shape), pa.array(floor, pa.int64())], names=[*batch.schema.names, "found", "floor"])
    return asked.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + f", found {_FOUND}, floor long")


def _bins(counts: dict[int, int], size: int, bands: list[int]) -> list[list]:
    """Neighbouring ``bands`` together while they hold at most ``size``: [bands, number of their blocks]."""
    bins: list[list] = []
    held = size + 1
    for band in bands:
        if held + counts[band] > size:
            bins.append([[], 1])
            held = 0
        held += counts[band]
        bins[-1][0].append(band)
        bins[-1][1] = max(1, -(-held // size))
    return bins


def grid(wanting: dict[int, int], offered: dict[int, int], many: int, wide: int) -> list[tuple]:
    """(side, band, first block, blocks, blocks of the other side that it meets)
    for the queries (side i: their number by the least band they need) and the
    candidates (side j: by band), in blocks of ``many`` and ``wide``.

    Queries that reach furthest and candidates of the largest norms stand
    first, so that what a block meets are the first blocks of the other side.
    Neighbouring bands share a block; it needs what its first band needs, and
    offers what its first band offers.
    """
    bins = {"i": _bins(wanting, many, sorted(wanting)), "j": _bins(offered, wide, sorted(offered, reverse=True))}
    begin = {side: list(itertools.accumulate((blocks for _, blocks in some), initial=0)) for side, some in bins.items()}
    out = []
    for side, other in ("ij", "ji"):
        firsts = [bands[0] if other == "i" else -bands[0] for bands, _ in bins[other]]
        for n, (bands, blocks) in enumerate(bins[side]):
            met = bisect.bisect_right(firsts, bands[0] if other == "i" else -bands[0])
            out += [(side, band, begin[side][n], blocks, begin[other][met]) for band in bands]
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` that meets
    ``queries`` (a condition on ``vec_id``) the k rows with the highest integer
    inner products but itself, ties by the smaller id; fewer, if there are
    fewer.

    Each row is a query or candidate of its own, also where ids repeat; null
    ids come after all others among ties and ask nothing.  Vectors of different
    lengths are never paired.  An empty table gives no rows.  Components beyond
    2^62 and scores beyond 64 bits count as the nearest such number.
    """
    spark = vectors.sparkSession
    settle(spark)
    rows = staged(quantised(vectors, id_col, vector_col, scale), "vectors").withColumn("dims", F.size("v"))
    n_rows, n_queries, dims, most = rows.agg(F.count("*"), F.count_if(queries), F.max("dims"), F.max(F.greatest(-F.array_min("v"), F.array_max("v")))).first()
    per_row = 8 * (dims or 1)
    if (most or 0) < 1 << 15:
        rows = rows.withColumn("v", F.col("v").cast("array<short>"))
    # A query's own row is one of the head too, so k + 1 rows are the least that can give a floor.
    first = rows.orderBy(F.col("norm").desc(), "row").limit(min(HEAD, HEAD_BYTES // per_row)).select("vec_id", "v", "row", "norm").collect()
    spread_out = max(1, min(spark.sparkContext.defaultParallelism * 4, math.ceil(n_queries / 64)))
    asked = _after_head(rows.where(queries).repartition(spread_out, "row"), first, k)
    need = F.when(F.col("floor") > 0, F.col("floor") / F.col("norm") * (1 - 1e-6)).otherwise(0.0)
    asked = staged(asked.withColumn("band", band_of(need)), "asked")
    rest = rows.withColumn("band", band_of(F.col("norm")))
    if first:
        last = first[-1]
        rest = rest.where((F.col("norm") < last["norm"]) | ((F.col("norm") == last["norm"]) & (F.col("row") > last["row"])))
    # One number a band, on either side: bounded by the bands.
    wanting = {r["band"]: r["count"] for r in asked.groupBy("band").count().collect()}
    offered = {r["band"]: r["count"] for r in rest.groupBy("band").count().collect()}
    n_rest, fit = sum(offered.values()), max(1, CELL_BYTES // per_row)
    wide = min(CANDIDATES, fit, max(CHUNK, math.ceil(n_rest * math.ceil(n_queries / QUERIES) / CELLS)))
    many = min(QUERIES, fit, max(64, math.ceil(n_queries * math.ceil(n_rest / wide) / CELLS)))
    place_of = spark.createDataFrame(grid(wanting, offered, many, wide), "side string, of_band int, at int, blocks int, meets int").where("meets > 0")

    def placed(df, side, other):
        """``df`` copied to its cells: its own block, and all blocks that it must meet."""
        own = F.broadcast(place_of.where(F.col("side") == side))
        block = F.col("at") + F.pmod(F.xxhash64("row", F.lit(ord(side))), F.col("blocks")).cast("int")
        return df.join(own, F.col("band") == F.col("of_band")).withColumn(side, block).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    left = placed(asked, "i", "j").select("i", "j", "dims", "row", "vec_id", "v", "floor")
    right = placed(rest, "j", "i").select("i", "j", "dims", "row", "vec_id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            block = _Block(right["vec_id"].to_pylist(), right["row"].to_pylist(), _matrix(right["v"]))
            rows_, ids_ = left["row"].to_pylist(), left["vec_id"].to_pylist()
            for n, best in block.best(rows_, _matrix(left["v"]), k, left["floor"].to_pylist()):
                for row, vec_id, score in best:
                    for column, value in zip(out, (rows_[n], ids_[n], row, vec_id, score)):
                        column.append(value)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_row", "query_id", "row", "vec_id", "score"])
    cells = left.groupBy("i", "j", "dims").cogroup(right.groupBy("i", "j", "dims")).applyInArrow(
        run, "query_row long, query_id long, row long, vec_id long, score long")
    known = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.inline("found"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return cells.unionByName(known).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vector with an id divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20, scale=64)


#: DuckDB: all pairs of a query and a candidate.
OP2_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 20
"""
