"""Merkle manifest of a dataset as a postorder append log.

A tree has runs of ``FANOUT`` nodes: each run's digest is a node of the next
level, and the last run of a level may be shorter, even one node.  Leaves are
numbered by distributed ranks and dealt to aligned builders: a builder takes
the ``SPAN`` leaves of one complete subtree (the last one: fewer) and appends
every node when it is complete, so a log holds the nodes in postorder.  The
builders' last nodes are the leaves of the next round of builders, until one is
left, so no builder ever sees more than ``SPAN`` nodes.

Where a node stands in the log follows from the sizes of the subtrees that are
complete before it: before leaf i these hold i leaves and i // FANOUT^j nodes
of each level j, so node k of a level stands at
``e + sum(e // FANOUT^j) + level`` with its last leaf
e = min((k + 1) * FANOUT^level, n) - 1.  A proof reads its siblings at these
places, from the leaves' log up to the log of the last round.

Each group (source) has a tree, and the groups' roots are the leaves of one
more tree, in the order of the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelkeep.llm.common import apart, per_batch, settle, staged

FANOUT = 16

#: Levels that one builder completes, and the leaves it takes for that.
LEVELS = 3
SPAN = FANOUT ** LEVELS

_LOG = "tree string, block long, count long, n long, first long, nodes binary, keys array<string>, changed array<binary>"


# ------------------------------------------------------------ places in a log
def position(level: int, index: int, n: int) -> int:
    """The place of a node in the log of a tree of ``n`` leaves."""
    last = min((index + 1) * FANOUT ** level, n) - 1
    at, above = last + level, last // FANOUT
    while above:
        at += above
        above //= FANOUT
    return at


def height(n: int) -> int:
    """The levels above the leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // FANOUT), level + 1
    return level


def siblings(level: int, index: int, n: int) -> tuple[list[int], list[int]]:
    """Places of a node's siblings, to its left and to its right."""
    first = index - index % FANOUT
    after = min(first + FANOUT, -(-n // FANOUT ** level))
    return [position(level, k, n) for k in range(first, index)], [position(level, k, n) for k in range(index + 1, after)]


# ------------------------------------------------------------------- builders
def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def append_log(leaves: Sequence[str], levels: int) -> list[str]:
    """The nodes of one aligned subtree, each when it is complete."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(levels + 1)]

    def append(level: int, node: str) -> None:
        log.append(node)
        waiting[level].append(node)
        if level < levels and len(waiting[level]) == FANOUT:
            close(level)

    def close(level: int) -> None:
        run, waiting[level] = waiting[level], []
        append(level + 1, digest("".join(run)))

    for leaf in leaves:
        append(0, leaf)
    for level in range(levels):
        if waiting[level]:
            close(level)
    return log


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` (tree, ...) with ``i``, their place in their tree from 0, and
    ``n``, the tree's rows.

    Rows are range-partitioned by their whole order, ties spread by a row
    number, so a tree with a third of all rows is many partitions; a partition's
    places start where its forerunners' counts end.
    """
    tie = F.monotonically_increasing_id()
    whole = [F.col("tree"), *order, F.col("tie")]
    dealt = staged(rows.withColumn("tie", tie).repartitionByRange(*whole).sortWithinPartitions(*whole).drop("tie").withColumn("at", tie), "dealt")
    part = F.shiftright("at", 33)
    runs = dealt.groupBy("tree", part.alias("part")).agg(F.min("at").alias("begin"), F.count("*").alias("own"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("own").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("tree").alias("of"), apart(F.col("part")).alias("part"), "begin", before.alias("before"), F.sum("own").over(tree).alias("n"))
    return dealt.join(runs, (F.col("tree") == F.col("of")) & (part == F.col("part"))).withColumn(
        "i", F.col("at") - F.col("begin") + F.col("before")).drop("at", "of", "part", "begin", "before")


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("i")
    count, n, i = (table.column(c)[0].as_py() for c in ("count", "n", "i"))
    leaves = [x.hex() for x in table.column("digest").to_pylist()]
    nodes = append_log(leaves, LEVELS if count > SPAN else height(count))
    return pa.table({"tree": table.column("tree").slice(0, 1), "block": [i // SPAN], "count": [count], "n": [n], "first": [position(0, i, n)],
                     "nodes": [bytes.fromhex("".join(nodes))], "keys": [table.column("key").to_pylist()], "changed": [table.column("changed").to_pylist()]},
                    schema=_SCHEMA)


_SCHEMA = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("count", pa.int64()), ("n", pa.int64()), ("first", pa.int64()),
                     ("nodes", pa.binary()), ("keys", pa.list_(pa.string())), ("changed", pa.list_(pa.binary()))])


def append_logs(leaves: DataFrame) -> list[DataFrame]:
    """The logs of all trees over ``leaves`` (tree, i, n, digest, key, changed),
    one table for each round of builders, staged.

    Each row is what one builder appended: ``nodes`` (32 bytes each), from
    place ``first`` of the round's log; ``count`` are the leaves of the tree in
    that round.  ``key`` and ``changed`` of the leaves are kept beside them.
    """
    rows, logs = leaves.withColumn("count", F.col("n")), []
    while True:
        log = staged(rows.withColumn("block", F.floor(F.col("i") / SPAN)).groupBy("tree", "block").applyInArrow(_build, _LOG), f"log-{len(logs)}")
        logs.append(log)
        more = log.where(F.col("count") > SPAN)
        if more.isEmpty():
            return logs
        rounds = F.ceil(F.col("count") / SPAN).cast("long")
        rows = more.select("tree", F.col("block").alias("i"), rounds.alias("n"), F.substring("nodes", -32, 32).alias("digest"),
                           F.lit(None).cast("string").alias("key"), F.lit(None).cast("binary").alias("changed"), rounds.alias("count"))


def tops(logs: list[DataFrame]) -> DataFrame:
    """(tree, digest): each tree's last node."""
    found = [log.where(F.col("count") <= SPAN).select("tree", F.substring("nodes", -32, 32).alias("digest")) for log in logs]
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


# ---------------------------------------------------------------------- proofs
Step = tuple[str, str, "Step | None"]


def _steps(above: list[str]) -> Step | None:
    """left, right, left, right, ... upwards as a chain."""
    chain = None
    for k in range(len(above) - 2, -1, -2):
        chain = (above[k], above[k + 1], chain)
    return chain


def paths(nodes: bytes, members: int, levels: int, above: Step | None) -> Iterator[tuple[str, Step | None]]:
    """Each leaf of one builder's log and its siblings, upwards: their digests
    are read at the places that ``position`` works out."""
    hexed = nodes.hex()

    def read(place: int) -> str:
        return hexed[64 * place:64 * place + 64]

    chains: list[Step | None] = [above]
    for level in range(levels - 1, -1, -1):
        below = []
        for k in range(-(-members // FANOUT ** level)):
            left, right = siblings(level, k, members)
            below.append(("".join(map(read, left)), "".join(map(read, right)), chains[k // FANOUT]))
        chains = below
    return ((read(position(0, k, members)), chain) for k, chain in enumerate(chains))


def fold(leaf: str, chain: Step | None) -> str:
    """The root that a leaf and its siblings give."""
    while chain:
        leaf = digest(chain[0] + leaf + chain[1])
        chain = chain[2]
    return leaf


def proof(chain: Step | None) -> list[str]:
    """left, right, left, right, ... upwards."""
    out = []
    while chain:
        out += chain[:2]
        chain = chain[2]
    return out


_UP = "tree string, block long, above array<string>, subroot string, root string"
_UP_TYPES = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]


def _descend(logs: list[DataFrame], above: DataFrame, fields: str, types: list, leaf_row) -> DataFrame:
    """One row for every leaf of ``logs``: leaf_row(key, changed, leaf, chain of
    siblings, subroot, root).  ``above`` (tree, above, subroot, root) goes on
    from each tree's root."""
    children = None
    top = above.select(F.col("tree").alias("of"), "above", "subroot", "root")
    for round_, log in reversed(list(enumerate(logs))):
        own = log.where(F.col("count") <= SPAN).join(top, F.col("tree") == F.col("of")).drop("of")
        if children is not None:
            c = children.select(F.col("tree").alias("of"), F.col("block").alias("at"), "above", "subroot", "root")
            own = own.unionByName(log.where(F.col("count") > SPAN).join(c, (F.col("tree") == F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at"))
        made_fields, made_types = (fields, types) if round_ == 0 else (_UP, _UP_TYPES)

        def run(batch, leaves=round_ == 0, types=made_types, names=[f.split(" ")[0] for f in made_fields.split(", ")]):
            for row in range(batch.num_rows):
                tree, block, count, nodes, keys, changed, up, subroot, root = (batch.column(k)[row].as_py() for k in range(9))
                found = paths(nodes, len(keys), LEVELS if count > SPAN else height(count), _steps(up))
                rows = [leaf_row(keys[k], changed[k], leaf, chain, subroot, root) if leaves else (tree, block * SPAN + k, proof(chain), subroot, root)
                        for k, (leaf, chain) in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        made = own.select("tree", "block", "count", "nodes", "keys", "changed", "above", "subroot", "root").mapInArrow(per_batch(run), made_fields)
        children = made if round_ == 0 else staged(made, f"above-{round_}")
    return children


class Manifest:
    """The logs of a table's trees: ``logs`` of the groups' trees, ``top`` of the
    tree over the groups' roots."""

    def __init__(self, leaves: DataFrame, *order: Column):
        """``leaves``: (tree, digest binary, key string, changed binary, and what ``order`` needs)."""
        self.logs = append_logs(numbered(leaves, *order).select("tree", "i", "n", "digest", "key", "changed"))
        roots = tops(self.logs).select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.lit(None).cast("binary").alias("changed"))
        self.top = append_logs(numbered(roots, F.col("key")).select("tree", "i", "n", "digest", "key", "changed"))

    def root(self) -> DataFrame:
        """(digest): the root of the whole table; no row without leaves."""
        return tops(self.top).select(F.lower(F.hex("digest")).alias("root"))

    def _above(self) -> DataFrame:
        none = F.array().cast("array<string>")
        start = tops(self.top).select("tree", none.alias("above"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root"))
        return staged(_descend(self.top, start, "tree string, above array<string>, subroot string, root string",
                               [pa.string(), pa.list_(pa.string()), pa.string(), pa.string()],
                               lambda key, changed, leaf, chain, subroot, root: (key, proof(chain), leaf, root)), "above")

    def proofs(self) -> DataFrame:
        """(key, leaf, siblings, subroot, root): for each leaf the digests to
        its left and to its right, level by level, each as one text."""
        return _descend(self.logs, self._above(), "key string, leaf string, siblings array<string>, subroot string, root string",
                        [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()],
                        lambda key, changed, leaf, chain, subroot, root: (key, leaf, proof(chain), subroot, root))

    def verified(self) -> DataFrame:
        """(key, leaf, subroot, root, proof_sha256, folded_root): each leaf's
        proof, and the root that follows from it and from ``changed``, or the
        leaf itself where that is null."""
        def row(key, changed, leaf, chain, subroot, root):
            return key, leaf, subroot, root, digest("".join(proof(chain))), fold(changed.hex() if changed else leaf, chain)
        return _descend(self.logs, self._above(), "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string",
                        [pa.string()] * 6, row)


def field(column: Column) -> Column:
    """A value as its UTF-8 byte count, ``:`` and itself; null as ``-``."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
             columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None) -> Manifest:
    """The manifest of ``docs``: a leaf for each row, of its ``columns``; other
    columns take no part.

    Leaves ascend by id, null ids last; rows with one id by their digests, so
    repeated rows are leaves next to each other with one digest.  Null groups
    are one group, before all others.  Where ``tampered`` holds, A-Z of the text
    are lower-cased in the leaf that ``Manifest.verified`` folds.  An empty
    table has no trees and no rows.
    """
    settle(docs.sparkSession)
    of = {c: F.col(f"`{c}`") for c in {*columns, id_col, group_col, text_col}}
    lowered = leaf_digest(*[F.translate(of[c].cast("string"), _UPPER, _LOWER) if c == text_col else of[c] for c in columns])
    changed = F.lit(None).cast("binary") if tampered is None else F.when(tampered, lowered)
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), of[group_col].cast("string")), F.lit("")).alias("tree"), of[id_col].cast("long").alias("id"),
                         leaf_digest(*[of[c] for c in columns]).alias("digest"), changed.alias("changed"))
    leaves = staged(leaves.withColumn("key", F.col("id").cast("string")), "leaves")
    return Manifest(leaves, F.col("id").asc_nulls_last(), F.col("digest"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether its leaf (tampered,
    where 5 divides crc32 of the id) still gives the root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest(docs, tampered=tampered).verified()
    return found.select(F.col("key").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


#: DuckDB: the levels by recursion; crc32 bit by bit.
OP12_SQL = r"""
WITH RECURSIVE part AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, k: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))) AS crc
  FROM documents),
leaf AS (
  SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, h) - 1 AS i, * FROM (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
      CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(small) || ':' || small, '-')) END AS changed FROM part)),
node(tree, l, i, h, n) AS (
  SELECT coalesce('=' || source, ''), 0, i, h, count(*) OVER (PARTITION BY source) FROM leaf
  UNION ALL
  SELECT tree, l + 1, i // 16, string_digest, count(*) OVER (PARTITION BY tree) FROM (
    SELECT tree, l, i // 16 * 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS string_digest FROM node WHERE n > 1 GROUP BY tree, l, i // 16 * 16)),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM node WHERE n = 1),
high(l, i, h, n) AS (
  SELECT 0, i, subroot, count(*) OVER () FROM sub
  UNION ALL
  SELECT l + 1, i // 16, d, count(*) OVER () FROM (
    SELECT l, i // 16 * 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS d FROM high WHERE n > 1 GROUP BY l, i // 16 * 16)),
low_way(doc_id, tree, own, l, i, h, proof) AS (
  SELECT doc_id, coalesce('=' || source, ''), i, 0, i, coalesce(changed, h), '' FROM leaf
  UNION ALL
  SELECT w.doc_id, w.tree, w.own, w.l + 1, w.i // 16, sha256(string_agg(CASE WHEN k.i = w.i THEN w.h ELSE k.h END, '' ORDER BY k.i)),
    w.proof || coalesce(string_agg(CASE WHEN k.i <> w.i THEN k.h END, '' ORDER BY k.i), '')
  FROM low_way w JOIN node k ON k.tree = w.tree AND k.l = w.l AND k.i // 16 = w.i // 16
  WHERE k.n > 1 GROUP BY w.doc_id, w.tree, w.own, w.l, w.i, w.h, w.proof),
low_end AS (SELECT * FROM low_way QUALIFY row_number() OVER (PARTITION BY tree, own ORDER BY l DESC) = 1),
high_way(tree, own, l, i, h, proof) AS (
  SELECT e.tree, e.own, 0, s.i, e.h, e.proof FROM low_end e JOIN sub s USING (tree)
  UNION ALL
  SELECT w.tree, w.own, w.l + 1, w.i // 16, sha256(string_agg(CASE WHEN k.i = w.i THEN w.h ELSE k.h END, '' ORDER BY k.i)),
    w.proof || coalesce(string_agg(CASE WHEN k.i <> w.i THEN k.h END, '' ORDER BY k.i), '')
  FROM high_way w JOIN high k ON k.l = w.l AND k.i // 16 = w.i // 16 WHERE k.n > 1 GROUP BY w.tree, w.own, w.l, w.i, w.h, w.proof),
high_end AS (SELECT * FROM high_way QUALIFY row_number() OVER (PARTITION BY tree, own ORDER BY l DESC) = 1)
SELECT f.doc_id, f.h AS leaf, s.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM leaf f JOIN high_end e ON e.tree = coalesce('=' || f.source, '') AND e.own = f.i JOIN sub s ON s.tree = e.tree JOIN high r ON r.n = 1
"""
