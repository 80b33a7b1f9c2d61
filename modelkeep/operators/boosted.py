"""Boosted trees grown from the cells that the rows fall into (M4, M5).

A boosted fit sees a feature only by its bin.  Rows in the same bins get the
same prediction in every round, so their number, sum and sum of squares (for
two classes: their number in each class) say all that a round asks of them.
One pass over the rows, distributed, leaves these cells, and one task grows all
rounds from them, where Spark ML runs a job per tree level and round over all
rows.  Bins, gains, order of splits, stopping, pruning and step sizes are those
of Spark ML's ``GradientBoostedTrees``; the result is its model, in its format.

Rows that a round leaves out (``subsamplingRate``) are drawn as Spark ML draws
them, from a generator per partition, so these fits keep a few bytes of each row.
Fits of more rows or cells than a task should keep are Spark ML's own.
"""

from __future__ import annotations

import functools
import json
import math
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeep.session import scratch_path

MOST_CELLS = 1 << 22            # cells times features that one task works on
MOST_DRAWN_ROWS = 1 << 22       # rows of a fit that leaves out some in each round
MOST_SUMS = 1 << 22             # bins of all nodes of a level
DRAWS_AT_ONCE = 1 << 22
ROWS_FOR_SPLITS = 10_000        # Spark ML's sample for the bins' edges, or maxBins^2
EPSILON = 2.0 ** -52
KEY_CELLS = 1 << 62             # values of one key column
NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, "
         "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")
_TREE_PARAMS = ("cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth",
                "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed")


# ------------------------------------------------------- Spark's generator
def _murmur(data: bytes, seed: int) -> int:
    h = seed
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at:at + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def start_of(seed: int) -> int:
    """State of Spark's ``XORShiftRandom`` after ``setSeed(seed)``."""
    data = (seed & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint64(21))
    x = x ^ (x >> np.uint64(35))
    return x ^ (x << np.uint64(4))


def first_int(seed: int) -> int:
    """``new XORShiftRandom(seed).nextInt()``."""
    low = int(_step(np.array([start_of(seed)], np.uint64))[0]) & 0xFFFFFFFF
    return low - (low >> 31 << 32)


@functools.lru_cache
def _jump(steps: int) -> np.ndarray:
    """What ``steps`` steps make of each bit of a state."""
    image = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for _ in range(steps):
        image = _step(image)
    return image


def draws(seeds: list[int], n: int, run: int = 512) -> np.ndarray:
    """The first ``n`` ``nextDouble()`` of a generator for each seed.  A step is
    linear over bits, so generators ``run`` numbers apart go on side by side."""
    lanes = max(1, -(-n // run))
    state = np.empty((len(seeds), lanes), np.uint64)
    state[:, 0] = [start_of(s) for s in seeds]
    for lane in range(1, lanes):
        bits = (state[:, lane - 1, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        state[:, lane] = np.bitwise_xor.reduce(bits * _jump(2 * run), axis=1)
    out = np.empty((len(seeds), lanes, min(run, max(n, 1))))
    for at in range(out.shape[2]):
        state = _step(state)
        high = (state & np.uint64((1 << 26) - 1)) << np.uint64(27)
        state = _step(state)
        out[:, :, at] = (high + (state & np.uint64((1 << 27) - 1))) * 2.0 ** -53
    return out.reshape(len(seeds), -1)[:, :n]


# ------------------------------------------------------------------- bins
def thresholds(values: np.ndarray, most: int, expected: float) -> np.ndarray:
    """Bin edges of one feature from its sampled values, at most ``most``;
    ``expected`` is how many the sample should hold, zeros included."""
    found, counts = np.unique(values[values != 0.0], return_counts=True)
    if not len(found):
        return np.empty(0)
    nonzero = int(counts.sum())
    counts = counts.astype(float)
    if expected - nonzero > EPSILON * nonzero * 100:
        at = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, expected - nonzero)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= most:
        return middles
    stride = expected / (most + 1)
    edges, target, counts = [], stride, counts.tolist()
    current = counts[0]
    for at in range(1, len(found)):
        before, current = current, current + counts[at]
        if abs(before - target) < abs(current - target):
            edges.append(middles[at - 1])
            target += stride
    return np.array(edges)


def _sampled(rows: DataFrame, share: float, seed: int) -> np.ndarray:
    """Feature values of the rows that Spark ML reads to place the edges."""
    spark, each = rows.sparkSession, rows.select("features")
    if share < 1.0:
        part = each._jdf.queryExecution().toRdd().sample(False, share, first_int(seed))
        each = DataFrame(spark._jsparkSession.internalCreateDataFrame(part, each._jdf.schema(), False), spark)
    column = each.where("features IS NOT NULL").select(vector_to_array("features")).toArrow().column(0).combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _bin(value: str, edges: list[float], lo: int = 0) -> str:
    """SQL: number of edges below a value, by halving."""
    if not edges:
        return str(lo)
    mid = len(edges) // 2
    return f"CASE WHEN {value} <= {edges[mid]!r}D THEN {_bin(value, edges[:mid], lo)} ELSE {_bin(value, edges[mid + 1:], lo + mid + 1)} END"


def _key_columns(edges: list[np.ndarray]) -> list[list[int]]:
    """Features whose bins share a key column."""
    groups, size = [[]], 1
    for j, e in enumerate(edges):
        if not len(e):
            continue
        if size * (len(e) + 1) > KEY_CELLS:
            groups.append([])
            size = 1
        groups[-1].append(j)
        size *= len(e) + 1
    return groups


def _keyed(rows: DataFrame, edges: list[np.ndarray], two_classes: bool, *columns) -> DataFrame:
    """Each row's cell, its label and whether Spark ML would refuse it.  As SQL
    text: hundreds of columns of a search, built one call each, keep the driver busy."""
    values = rows.select(vector_to_array("features").alias("f"), F.col("label").cast("double").alias("label"), *columns)

    def key(group):
        packed = "0L"
        for j in group:
            packed = f"({packed} * {len(edges[j]) + 1} + {_bin(f'f[{j}]', edges[j].tolist())})"
        return packed
    zero = " + ".join(["label * 0", *[f"get(f, {j}) * 0" for j in range(len(edges))]])
    good = f"{zero} = 0" + (" AND label IN (0, 1)" if two_classes else "")
    return values.selectExpr(*[f"{key(g)} AS key_{i}" for i, g in enumerate(_key_columns(edges))], "label", f"NOT coalesce({good}, FALSE) AS bad",
                             *[c for c in values.columns if c not in ("f", "label")])


# ---------------------------------------------------------------- growing
class _Grower:
    """Trees over cells: ``bins`` is a row of bins for each cell."""

    def __init__(self, keys: np.ndarray, edges: list[np.ndarray], depth: int, least: int, least_gain: float):
        self.edges, self.depth, self.least, self.least_gain = edges, depth, least, least_gain
        self.features = [j for j, e in enumerate(edges) if len(e)]
        self.bins = np.zeros((len(keys), len(self.features)), np.int64)
        place = {j: i for i, j in enumerate(self.features)}
        for i, group in enumerate(_key_columns(edges)):
            rest = keys[:, i].copy()
            for j in reversed(group):
                rest, self.bins[:, place[j]] = np.divmod(rest, len(edges[j]) + 1)
        # Features with as many bins stand side by side in the sums; ``order``
        # brings their splits back into the features' order.
        widths = np.array([len(edges[j]) + 1 for j in self.features], np.int64)
        self.groups, offset, at = [], np.zeros(len(widths), np.int64), 0
        feature, split = [], []
        for width in np.unique(widths):
            members = np.flatnonzero(widths == width)
            offset[members] = at + np.arange(len(members)) * width
            self.groups.append((at, len(members), int(width)))
            feature.append(np.repeat(members, width - 1))
            split.append(np.tile(np.arange(width - 1), len(members)))
            at += len(members) * int(width)
        self.total = at
        self.flat = self.bins + offset
        if self.features:
            feature, split = np.concatenate(feature), np.concatenate(split)
            self.order = np.lexsort((split, feature))
            self.feature, self.split = feature[self.order], split[self.order]

    def _left(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums left of each split, and of the whole node as its feature adds them up."""
        left, whole = [], []
        for at, many, width in self.groups:
            cum = sums[:, at:at + many * width].reshape(-1, many, width).cumsum(axis=2)
            left.append(cum[:, :, :-1].reshape(len(sums), -1))
            whole.append(np.repeat(cum[:, :, -1], width - 1, axis=1))
        return np.concatenate(left, axis=1)[:, self.order], np.concatenate(whole, axis=1)[:, self.order]

    def tree(self, stats: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """The nodes of one tree for the cells' ``stats`` (3 rows: number, sum,
        sum of squares) and its prediction for each cell."""
        cells = stats.shape[1]
        nodes: list[list] = [[None, -1.0, None, None, None]]      # stats, gain, left, right, (feature, threshold)
        nodes[0][0] = tuple(stats.sum(axis=1))
        leaf = np.zeros(cells, np.int64)
        here, at = np.arange(cells), np.zeros(cells, np.int64)   # cells still to be split and their node's place in ``active``
        active, level = [0], 0
        while active and level < self.depth and self.features:
            k, p = len(active), self.flat.shape[1]
            index = (at[:, None] * self.total + self.flat[here]).ravel()
            sums = [self._left(np.bincount(index, np.repeat(x[here], p), k * self.total).reshape(k, -1)) for x in stats]
            (n, s, q), (wn, ws, wq) = (np.array([x[i] for x in sums]) for i in (0, 1))
            rn, rs, rq = wn - n, ws - s, wq - q
            own = np.array([nodes[i][0] for i in active]) if level else np.stack([wn[:, 0], ws[:, 0], wq[:, 0]], axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                spread = lambda n, s, q: np.where(n == 0, 0.0, (q - s * s / n) / n)
                li, ri = spread(n, s, q), spread(rn, rs, rq)
                gain = spread(*own.T)[:, None] - n / (n + rn) * li - rn / (n + rn) * ri
            gain[~((n >= self.least) & (rn >= self.least) & (gain >= self.least_gain))] = -np.inf
            best = gain.argmax(axis=1)
            rows = np.arange(k)
            top, children, grown = gain[rows, best], np.full((k, 2), -1), []
            for i in np.flatnonzero(top > 0):
                node, b = nodes[active[i]], best[i]
                j = int(self.feature[b])
                node[1:] = [float(top[i]), len(nodes), len(nodes) + 1, (self.features[j], float(self.edges[self.features[j]][self.split[b]]))]
                for side, of, impurity in ((0, (n, s, q), li), (1, (rn, rs, rq), ri)):
                    nodes.append([tuple(float(x[i, b]) for x in of), -1.0, None, None, None])
                    children[i, side] = len(nodes) - 1
                    if level + 1 < self.depth and abs(impurity[i, b]) >= EPSILON:
                        grown.append(len(nodes) - 1)
            going = top[at] > 0
            here, at = here[going], at[going]
            right = self.bins[here, self.feature[best[at]]] > self.split[best[at]]
            to = children[at, right.astype(np.int64)]
            leaf[here] = to
            place = np.full(len(nodes), -1)
            place[grown] = np.arange(len(grown))
            going = place[to] >= 0
            here, at = here[going], place[to[going]]
            active, level = grown, level + 1
        predicted = np.array([x[0][1] / x[0][0] if x[0][0] else 0.0 for x in nodes])
        return _numbered(nodes, predicted), predicted[leaf]


def _numbered(nodes: list[list], predicted: np.ndarray) -> list[tuple]:
    """Nodes in preorder; two leaves that predict the same are their parent."""
    for node in reversed(nodes):
        if node[2] is not None and nodes[node[2]][2] is None and nodes[node[3]][2] is None and predicted[node[2]] == predicted[node[3]]:
            left, right = nodes[node[2]][0], nodes[node[3]][0]
            node[1:], node[0] = [-1.0, None, None, None], node[0] or tuple(a + b for a, b in zip(left, right))
    out, todo = [], [(0, -1, 0)]
    while todo:
        i, parent, side = todo.pop()
        (n, s, q), gain, left, right, split = nodes[i]
        if parent >= 0:
            out[parent][6 + side] = len(out)
        out.append([len(out), float(predicted[i]), (q - s * s / n) / n if n else 0.0, [float(n), float(s), float(q)], int(round(n)), gain, -1, -1, split])
        if left is not None:
            todo += [(right, len(out) - 1, 1), (left, len(out) - 1, 0)]
    return out


def _rounds(items: np.ndarray, n: np.ndarray, rows: np.ndarray | None, share: float, seed: int, rounds: int):
    """How many rows of each item every round sees.  ``rows``: (position, item)
    of each row, the partition in the position's upper bits."""
    if rows is None:
        for _ in range(rounds):
            yield n
        return
    position, item = rows
    order = np.argsort(position, kind="stable")
    part, item = position[order] >> 33, item[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    at_once = max(1, DRAWS_AT_ONCE // max(1, len(part)))
    for first in range(0, rounds, at_once):
        some = range(first, min(rounds, first + at_once))
        kept = [draws([seed + m + int(part[a]) + 1 for m in some], b - a) < share for a, b in zip(starts, [*starts[1:], len(part)])]
        kept = np.concatenate(kept, axis=1)
        for mine in kept:
            yield np.bincount(item[mine], minlength=len(items)).astype(float)


def boost(keys: np.ndarray, edges: list[np.ndarray], items: np.ndarray, y: np.ndarray, n: np.ndarray, scatter: np.ndarray, rows, two_classes: bool,
          depth: int, least: int, least_gain: float, rounds: int, step: float, share: float, seed: int):
    """Nodes of every round's tree.  ``items`` are the cells of the groups of
    rows with one ``y`` (their mean, ``scatter`` the squares around it)."""
    grower, cells = _Grower(keys, edges, depth, least, least_gain), len(keys)
    predicted = np.zeros(cells)
    for m, seen in enumerate(_rounds(items, n, rows, share, seed, rounds)):
        if m == 0:
            r, scale = y, 1.0
        elif two_classes:
            with np.errstate(over="ignore"):
                r, scale = 4.0 * y / (1.0 + np.exp(2.0 * y * predicted[items])), 0.0
        else:
            r, scale = 2.0 * (y - predicted[items]), 4.0
        stats = np.stack([np.bincount(items, x, cells) for x in (seen, seen * r, seen * r * r + scale * scatter)])
        nodes, of_cell = grower.tree(stats)
        predicted += of_cell if m == 0 else step * of_cell
        yield m, nodes


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``keys`` and which of them each row is."""
    if keys.shape[1] == 1:
        found, which = np.unique(keys[:, 0], return_inverse=True)
        return found[:, None], which
    found, which = np.unique(keys, axis=0, return_inverse=True)
    return found, which.ravel()


def _grown(batches, edges, two_classes, settings):
    """The task: cells (or rows, with their position) in, nodes out."""
    table = pa.Table.from_batches(list(batches))
    if pc.any(table.column("bad")).as_py():
        return
    many = sum(c.startswith("key_") for c in table.column_names)
    keys = np.stack([table.column(f"key_{i}").to_numpy() for i in range(many)], axis=1)
    y = table.column("label").to_numpy().astype(float)
    keys, cell = _distinct(keys)
    rows, y = None, 2.0 * y - 1.0 if two_classes else y
    if "at" in table.column_names:
        labels, of = np.unique(y, return_inverse=True)
        both, item = np.unique(cell * len(labels) + of, return_inverse=True)
        rows = (table.column("at").to_numpy(), item)
        cell, y = both // len(labels), labels[both % len(labels)]
        n, scatter = np.bincount(rows[1], minlength=len(cell)).astype(float), np.zeros(len(cell))
    else:
        n, scatter = table.column("n").to_numpy().astype(float), table.column("scatter").to_numpy().astype(float)
        order = np.lexsort((y, cell))
        cell, y, n, scatter = cell[order], y[order], n[order], scatter[order]
    split = lambda s: {"featureIndex": s[0] if s else -1, "leftCategoriesOrThreshold": [s[1]] if s else [], "numCategories": -1}
    names = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild")
    number = pa.float64()
    kind = pa.struct([("id", pa.int32()), ("prediction", number), ("impurity", number), ("impurityStats", pa.list_(number)), ("rawCount", pa.int64()),
                      ("gain", number), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                      ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(number)), ("numCategories", pa.int32())]))])
    for m, nodes in boost(keys, edges, cell, y, n, scatter, rows, two_classes, **settings):
        data = [{**dict(zip(names, node)), "split": split(node[8])} for node in nodes]
        yield pa.record_batch([pa.array([m] * len(data), pa.int32()), pa.array(data, kind)], names=["treeID", "nodeData"])


# -------------------------------------------------------------------- fit
@functools.cache
def quick(model: type) -> type:
    """A model class whose trees are wrapped when asked for.  PySpark wraps
    each tree whenever it lists the model's params, two seconds of the driver's
    Python for 150 of them, and all fits of a search share that."""
    return type(model.__name__, (model,), {"__module__": model.__module__, "__doc__": model.__doc__, "trees": property(model.trees.func)})


def _as_here(estimator, train: DataFrame) -> bool:
    """Whether the estimator asks for nothing beyond what is done here."""
    if not isinstance(estimator, (GBTClassifier, GBTRegressor)):
        return False
    unset = all(not estimator.isDefined(p) or not estimator.getOrDefault(p) for p in ("weightCol", "validationIndicatorCol", "minWeightFractionPerNode"))
    plain = estimator.getFeatureSubsetStrategy() == "all" and estimator.getLossType() in ("squared", "logistic")
    attrs = train.schema[estimator.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
    return unset and plain and not set(attrs) - {"numeric"}


def fit(estimator, train: DataFrame):
    """The fitted model of a ``GBTClassifier`` or ``GBTRegressor``, or None
    where Spark ML has to fit it (or to say what is wrong with the rows)."""
    if not _as_here(estimator, train):
        return None
    spark, two_classes = train.sparkSession, isinstance(estimator, GBTClassifier)
    rows = train.select(F.col(estimator.getFeaturesCol()).alias("features"), F.col(estimator.getLabelCol()).alias("label"))
    n, share = rows.count(), estimator.getSubsamplingRate()
    if not n or (share < 1.0 and n > MOST_DRAWN_ROWS):
        return None
    seed, most = estimator.getSeed(), min(estimator.getMaxBins(), n)
    wanted = max(most * most, ROWS_FOR_SPLITS)
    part = wanted / n if wanted < n else 1.0
    sample = _sampled(rows, part, seed)
    width = sample.shape[1]
    if not width:
        return None
    edges = [thresholds(sample[:, j], most - 1, part * n) for j in range(width)]
    if sum(len(e) + 1 for e in edges) << min(max(estimator.getMaxDepth() - 1, 0), 30) > MOST_SUMS:
        return None
    keyed = _keyed(rows, edges, two_classes, *([F.monotonically_increasing_id().alias("at")] if share < 1.0 else []))
    keys = [c for c in keyed.columns if c.startswith("key_")]
    used = max(1, sum(len(e) > 0 for e in edges))
    if min(n, math.prod(len(e) + 1 for e in edges)) * used > MOST_CELLS and keyed.agg(F.approx_count_distinct(F.struct(*keys), 0.02)).first()[0] * used > MOST_CELLS:
        return None
    if share == 1.0:
        within = [*keys, "label"] if two_classes else keys
        scatter = F.lit(0.0) if two_classes else F.var_pop("label") * F.count("label")
        mean = [] if two_classes else [F.avg("label").alias("label")]
        keyed = keyed.groupBy(*within).agg(*mean, F.count(F.lit(1)).alias("n"), scatter.alias("scatter"), F.bool_or("bad").alias("bad"))
    settings = {"depth": estimator.getMaxDepth(), "least": estimator.getMinInstancesPerNode(), "least_gain": estimator.getMinInfoGain(),
                "rounds": estimator.getMaxIter(), "step": estimator.getStepSize(), "share": share, "seed": seed}
    path = scratch_path(spark, "boosted")
    keyed.repartition(1).mapInArrow(lambda batches: _grown(batches, edges, two_classes, settings), NODES).write.parquet(f"{path}/data")
    if spark.read.schema(NODES).parquet(f"{path}/data").isEmpty():
        return None
    return _loaded(spark, estimator, path, width, two_classes)


def _loaded(spark, estimator, path: str, width: int, two_classes: bool):
    """The model of the nodes in ``path``, through Spark ML's own reader."""
    kept = lambda params, names=None: {p.name: v for p, v in params.items() if names is None or p.name in names}
    about = lambda kind, uid, names=None: {"class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                                          "uid": uid, "paramMap": kept(estimator._paramMap, names), "defaultParamMap": kept(estimator._defaultParamMap, names)}
    rounds = estimator.getMaxIter()
    kind = GBTClassificationModel if two_classes else GBTRegressionModel
    whole = json.dumps({**about(kind.__module__.replace("pyspark.ml.", "") + "." + kind.__name__, estimator.uid), "numFeatures": width, "numTrees": rounds})
    trees = [(m, json.dumps(about("regression.DecisionTreeRegressionModel", f"dtr_{estimator.uid}_{m}", _TREE_PARAMS)), 1.0 if m == 0 else estimator.getStepSize())
             for m in range(rounds)]
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    model = quick(kind)(kind.read()._jread.load(path))
    model._transfer_params_from_java()
    return model
