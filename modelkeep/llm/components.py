"""Connected components of an edge table, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeep.llm.common import apart, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond"): each node's neighbours are linked to
    its smallest neighbour until all edges lead to a root, in O(log^2 n)
    rounds.  A node's minimum is a partially aggregated groupBy and goes back
    to its edges by a join, so a node with very many edges is split by the
    adaptive skew join and never gathered.  Each round's edges are staged in
    the shared folder; only their count and checksum reach the driver.
    """
    e = staged(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct(), "edges")
    before = None
    while True:
        both = e.select("hi", "lo").unionAll(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(apart(F.col("hi")).alias("u"), F.least("hi", "m").alias("m"))
        large = (both.join(least, F.col("hi") == F.col("u")).where("lo > hi and lo > m")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())
        large = staged(large, "large")
        down = large.groupBy("hi").agg(F.min("lo").alias("m")).select(apart(F.col("hi")).alias("u"), "m")
        small = (large.join(down, F.col("hi") == F.col("u")).where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionAll(down.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct())
        e = staged(small, "small")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    roots = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
