"""Feature preparation: T1-T12 and the Spark ML stages behind them.

The fitted values of every stage are small (one number per numeric
column, at most 50 categories per categorical column) and live in the
stage's params, so the stages persist with ``DefaultParamsWritable`` and
run inside ``Pipeline``/``CrossValidator`` (refit per fold, like the
reference's preprocessor).  Statistics are exact: medians come from the
ordered-sum helper, modes and category caps from ``value_counts``.
"""

from __future__ import annotations

import itertools

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
                             DefaultParamsWriter)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelkeep.functions.ordered import column_medians, in_file_order, positions, written
from modelkeep.functions.values import typed, value_counts
from modelkeep.session import scratch_path

# Fixed values from the reference's preprocessing and split.
ONEHOT_CAP = 50
TEST_SHARE = 0.2
SPLIT_SEED = 42
MAX_CV_CLASSES = 30
MAX_FOLDS = 3


# ----------------------------------------------------------------- T1 - T5
def feature_lists(profile: DataFrame) -> tuple[list[str], list[str]]:
    """Numerical and categorical feature names (role != ignore) in column
    order, from an enriched profile (P13).  One row per column."""
    rows = profile.where(F.coalesce(F.col("role"), F.lit("feature")) != "ignore") \
        .select("column", "pos", "type").orderBy("pos").collect()
    num = [r["column"] for r in rows if r["type"] == "numerical"]
    cat = [r["column"] for r in rows if r["type"] == "categorical"]
    return num, cat


def select_features(df: DataFrame, numerical: list[str], categorical: list[str]) -> DataFrame:
    """Numerical then categorical columns."""
    return df.select(*numerical, *categorical)


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is NULL (or NaN) are dropped."""
    return df.where(typed(df, target).isNotNull())


def split_bucket(key, seed: int = SPLIT_SEED):
    """0..99 from md5(``seed:key``): the same in any engine and partitioning."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def split_train_test(df: DataFrame, key: str | list[str], test: float = TEST_SHARE,
                     seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Deterministic 80/20 split on a row key (not stratified)."""
    k = F.col(key) if isinstance(key, str) else F.concat_ws(":", *[F.col(c).cast("string") for c in key])
    marked = df.withColumn("__bucket", split_bucket(k, seed))
    cut = int(round(test * 100))
    return (marked.where(F.col("__bucket") >= cut).drop("__bucket"),
            marked.where(F.col("__bucket") < cut).drop("__bucket"))


def split_written(df: DataFrame, key: str, test: float = TEST_SHARE, seed: int = SPLIT_SEED, whole: bool = False, with_key: bool = True) -> tuple[DataFrame, ...]:
    """:func:`split_train_test` of rows that many passes will read: they and
    their side of the split are computed once and written.  ``whole`` returns
    all rows besides; without ``with_key`` the key isn't kept."""
    held_out = split_bucket(F.col(key), seed) < int(round(test * 100))
    marked = df.withColumn("__held_out", held_out)
    marked = in_file_order(written(marked if with_key else marked.drop(key), "split"))
    sides = (marked.where(~F.col("__held_out")), marked.where("__held_out"), *([marked] if whole else []))
    return tuple(side.drop("__held_out") for side in sides)


def encode_labels(train: DataFrame, target: str) -> DataFrame:
    """T4: ``(label, idx)``: distinct training labels as text, sorted, 0..n-1.

    The dictionary is a table with distributed ranks, however many labels
    there are; :func:`with_label_index` joins it to rows.
    """
    labels = train.select(_label_text(train, target).alias("label")).where(F.col("label").isNotNull()).distinct()
    return positions(labels, [F.col("label")]).select("label", (F.col("position") - 1).cast("int").alias("idx"))


def with_label_index(df: DataFrame, target: str, labels: DataFrame, name: str = "label") -> DataFrame:
    """``df`` with its target's index in the dictionary ``labels`` (NULL where
    it isn't there), by a join."""
    of = labels.select(F.col("label").alias("__l"), F.col("idx").alias(name))
    return df.join(of, _label_text(df, target) == F.col("__l"), "left").drop("__l")


def with_label_text(df: DataFrame, index: str, labels: DataFrame, name: str = "prediction") -> DataFrame:
    """F3 against the dictionary: the label of each index, an unknown one as it is, by a join."""
    of = labels.select(F.col("idx").alias("__i"), F.col("label").alias("__l"))
    met = df.join(of, F.col(index).cast("int") == F.col("__i"), "left")
    return met.withColumn(name, F.coalesce("__l", F.col(index).cast("long").cast("string"))).drop("__i", "__l")


def _label_text(df: DataFrame, target: str):
    dt = df.schema[target].dataType.typeName()
    c = typed(df, target)
    if dt == "boolean":
        return F.when(c, "true").when(~c, "false")
    return c.cast("string")


def filter_seen_classes(test: DataFrame, labels: DataFrame, train: DataFrame,
                        target: str) -> DataFrame:
    """T5: test rows whose class is in the label map; none left -> train."""
    seen = test.join(labels.select(F.col("label").alias("__l")),
                     _label_text(test, target) == F.col("__l"), "left_semi")
    return train if seen.isEmpty() else seen


def class_counts(train: DataFrame, target: str) -> DataFrame:
    """``(label, n)``: the class histogram."""
    return train.groupBy(_label_text(train, target).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def cv_folds(train: DataFrame, target: str, problem: str) -> DataFrame:
    """``(n_classes, min_class_count, folds)``; folds < 2 means no CV."""
    if problem == "classification":
        h = class_counts(train, target)
        agg = h.agg(F.count(F.lit(1)).cast("long").alias("n_classes"),
                    F.min("n").cast("long").alias("min_class_count"))
        folds = F.when(F.col("n_classes") > MAX_CV_CLASSES, F.lit(0)) \
            .otherwise(F.least(F.lit(MAX_FOLDS), F.coalesce(F.col("min_class_count"), F.lit(0))))
        return agg.select("n_classes", "min_class_count", folds.cast("long").alias("folds"))
    agg = train.agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
    return agg.select(F.lit(None).cast("long").alias("n_classes"),
                      F.lit(None).cast("long").alias("min_class_count"),
                      F.least(F.lit(MAX_FOLDS), F.col("n_rows")).cast("long").alias("folds"))


def union_feedback(train: DataFrame, feedback_rows: DataFrame, target: str) -> DataFrame:
    """Append labelled production inputs (target := actual value),
    columns aligned by name, missing -> NULL; the actual is cast to the
    target's type (the reference lets coercion rescue a mixed column)."""
    dt = train.schema[target].dataType
    fb = feedback_rows.withColumn(
        target, F.col(target).cast("string").try_cast(dt) if dt.typeName() != "string"
        else F.col(target).cast("string"))
    extra = [c for c in fb.columns if c not in train.columns]
    return train.unionByName(fb.drop(*extra), allowMissingColumns=True)


# --------------------------------------------------------- ML stages T6-T9
class _Stage(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    pass


class MedianImputer(Estimator, _Stage):
    """Numeric NULLs -> exact training median (mean of the two middles)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MedianImputerModel":
        cols = self.getInputCols()
        found = {r["column"]: r["median"] for r in column_medians(df, cols).collect()} if cols else {}
        return MedianImputerModel(inputCols=cols, fills=[float(found.get(c) or 0.0) for c in cols])


class MedianImputerModel(Model, _Stage):
    fills = Param(Params._dummy(), "fills", "fill value per input column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, fills=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, fills = self.getInputCols(), self.getOrDefault(self.fills)
        return df.withColumns({c: F.coalesce(typed(df, c).cast("double"), F.lit(v))
                               for c, v in zip(cols, fills)})


class ModeImputer(Estimator, _Stage):
    """Categorical NULLs -> most frequent training value (ties: the
    smallest value)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        cols = self.getInputCols()
        modes = {}
        if cols:
            vc = value_counts(df, cols).where(F.col("value").isNotNull())
            best = vc.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
            modes = {r["column"]: r["mode"] for r in best.collect()}
        return ModeImputerModel(inputCols=cols, fills=[modes.get(c) or "" for c in cols])


class ModeImputerModel(Model, _Stage):
    fills = Param(Params._dummy(), "fills", "fill value per input column", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols=None, fills=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        from modelkeep.functions.values import as_text
        cols, fills = self.getInputCols(), self.getOrDefault(self.fills)
        return df.withColumns({c: F.coalesce(as_text(df, c), F.lit(v)) for c, v in zip(cols, fills)})


class PopulationScaler(Estimator, _Stage):
    """(x - mean) / population std; a std of 0 divides by 1."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        if not cols:
            return PopulationScalerModel(inputCols=[], means=[], scales=[])
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        scales = [float(row[f"s{i}"] or 0.0) or 1.0 for i in range(len(cols))]
        return PopulationScalerModel(inputCols=cols, means=means, scales=scales)


class PopulationScalerModel(Model, _Stage):
    means = Param(Params._dummy(), "means", "training means", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "training population std (0 -> 1)",
                   TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, means=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        means, scales = self.getOrDefault(self.means), self.getOrDefault(self.scales)
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                               for c, m, s in zip(cols, means, scales)})


def capped_categories(train: DataFrame, cols: list[str], cap: int = ONEHOT_CAP) -> DataFrame:
    """T9 fit as a frame: ``(column, category, n, frequent, slot)``.

    Over ``cap`` categories, the ``cap - 1`` most frequent stay (ties: the
    larger category stays) and the rest share one infrequent slot, which
    comes last; frequent categories take slots in lexicographic order.
    The top-k is ``row_number() <= cap`` (a WindowGroupLimit: each
    partition ships at most ``cap`` rows per column), so a column with
    millions of categories is never ranked in one task.
    """
    vc = value_counts(train, cols).where(F.col("value").isNotNull()) \
        .withColumnRenamed("value", "category")
    n_cats = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_cats"))
    by_freq = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("category").desc())
    top = (vc.withColumn("rn", F.row_number().over(by_freq)).where(F.col("rn") <= cap)
           .join(F.broadcast(n_cats), "column")  # one row per column
           .where((F.col("n_cats") <= cap) | (F.col("rn") <= cap - 1)))
    slots = top.select("column", "category", (F.row_number().over(
        Window.partitionBy("column").orderBy("category")) - 1).alias("slot"))
    width = slots.groupBy("column").agg(F.count(F.lit(1)).alias("n_frequent"))
    return (vc.join(slots, ["column", "category"], "left")
            .join(F.broadcast(width), "column", "left")
            .select("column", "category", F.col("n").cast("long").alias("n"),
                    F.col("slot").isNotNull().alias("frequent"),
                    F.coalesce("slot", "n_frequent").cast("int").alias("slot")))


class _OneHotWriter(DefaultParamsWriter):
    """Params, and the rare categories as a Parquet table beside them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        rare = self.instance.rare_categories(self.sparkSession)
        rare.write.mode("overwrite").parquet(f"{path}/rare")


class _OneHotReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        model._set(rareTable=f"{path}/rare")
        return model


class CappedOneHot(Estimator, _Stage):
    """One-hot with at most ``cap`` outputs per column; unknown -> all 0."""

    cap = Param(Params._dummy(), "cap", "max outputs per column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, cap=ONEHOT_CAP):
        super().__init__()
        self._setDefault(cap=ONEHOT_CAP)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "CappedOneHotModel":
        cols = self.getInputCols()
        cap = self.getOrDefault(self.cap)
        cats: dict[str, list[str]] = {c: [] for c in cols}
        has_rare: set[str] = set()
        path = ""
        if cols:
            fitted = capped_categories(df, cols, cap).persist()
            for r in fitted.where("frequent").orderBy("column", "slot").collect():
                cats[r["column"]].append(r["category"])
            rare = fitted.where(~F.col("frequent"))
            has_rare = {r["column"] for r in rare.select("column").distinct().collect()}
            if has_rare:
                # Any number of rare names stays a table; only "is there one" reaches the driver.
                path = scratch_path(df.sparkSession, "onehot-rare")
                rare.select("column", "category").write.parquet(path)
            fitted.unpersist()
        return CappedOneHotModel(inputCols=cols, categories=[cats[c] for c in cols],
                                 withRare=[c in has_rare for c in cols], rareTable=path)


class CappedOneHotModel(Model, _Stage):
    """Frequent categories in the params; rare ones in a Parquet table that a
    left join asks, so a value never seen stays all 0 however many there are."""

    categories = Param(Params._dummy(), "categories", "frequent categories per column",
                       TypeConverters.identity)
    withRare = Param(Params._dummy(), "withRare", "which columns have rare categories",
                     TypeConverters.identity)
    rareTable = Param(Params._dummy(), "rareTable", "Parquet table (column, category) of rare categories",
                      TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, categories=None, withRare=None, rareTable=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def write(self):
        return _OneHotWriter(self)

    @classmethod
    def read(cls):
        return _OneHotReader(cls)

    def rare_categories(self, spark) -> DataFrame:
        if not any(self.getOrDefault(self.withRare)):
            return spark.createDataFrame([], "column string, category string")
        return spark.read.schema("column string, category string").parquet(self.getOrDefault(self.rareTable))

    def _transform(self, df: DataFrame) -> DataFrame:
        from modelkeep.functions.values import as_text
        new = {}
        out = df
        rare = self.rare_categories(df.sparkSession)
        for i, (c, cats, has_rare) in enumerate(zip(
                self.getInputCols(), self.getOrDefault(self.categories), self.getOrDefault(self.withRare))):
            v = as_text(df, c)
            for j, cat in enumerate(cats):
                new[f"__oh{i}_{j}"] = (v == F.lit(cat)).cast("double")
            if has_rare:
                own = rare.where(F.col("column") == c).select(F.col("category").alias(f"__rare{i}"))
                out = out.join(own, v == F.col(f"__rare{i}"), "left")
                new[f"__oh{i}_rare"] = F.col(f"__rare{i}").isNotNull().cast("double")
        done = out.withColumns({k: F.coalesce(e, F.lit(0.0)) for k, e in new.items()})
        return done.drop(*[x for x in done.columns if x.startswith("__rare")])


class OneHotAssembler(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric columns then every one-hot slot into ``features``.

    Needs the fitted one-hot width, so it is an Estimator placed after the
    one-hot stage; its model is a plain ``VectorAssembler``.
    """

    numericCols = Param(Params._dummy(), "numericCols", "numeric inputs", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, numericCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features", numericCols=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        onehot = sorted([c for c in df.columns if c.startswith("__oh")],
                        key=lambda s: (int(s[4:].split("_")[0]), _slot_key(s)))
        return VectorAssembler(inputCols=list(self.getOrDefault(self.numericCols)) + onehot,
                               outputCol=self.getOrDefault(self.outputCol))


def _slot_key(name: str) -> int:
    tail = name.split("_")[-1]
    return 10 ** 9 if tail == "rare" else int(tail)


def feature_pipeline(numerical: list[str], categorical: list[str], cap: int = ONEHOT_CAP) -> Pipeline:
    """T6-T10 as one Pipeline: median impute + population scale numeric,
    mode impute + capped one-hot categorical, assemble ``features``."""
    return Pipeline(stages=[
        MedianImputer(inputCols=numerical),
        PopulationScaler(inputCols=numerical),
        ModeImputer(inputCols=categorical),
        CappedOneHot(inputCols=categorical, cap=cap),
        OneHotAssembler(numericCols=numerical),
    ])


def grid_settings(grid: dict[str, list], n: int, seed: int = SPLIT_SEED) -> list[dict]:
    """Up to ``n`` distinct settings drawn from the full grid (seeded)."""
    import random
    keys = sorted(grid)
    product = [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]
    if len(product) <= n:
        return product
    return random.Random(seed).sample(product, n)
