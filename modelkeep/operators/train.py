"""Model fitting: M1-M10 with Spark ML.

The preparation is refit inside each cross-validation fold, once: its
assembled frames (``prepare_folds``) are shared by all settings of all
candidates.  Folds are stratified by class and deterministic under
recomputation.  The random search draws 3 settings (seeded) and fits them in
parallel; the winner is refit on the whole training split, evaluated on the
test split, and the best candidate is refit on every labelled row.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression, OneVsRest,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelkeep.functions.ordered import in_file_order, written
from modelkeep.functions.values import parse_number, sized
from modelkeep.operators import boosted
from modelkeep.operators import evaluate as E
from modelkeep.operators.prep import (SPLIT_SEED, cv_folds, encode_labels, feature_pipeline,
                                      grid_settings, split_train_test, split_written, _label_text)
from modelkeep.operators.profile import coerce_report

# Candidate grids and defaults of the reference's search.
N_SETTINGS = 3
FOREST_DEPTH = 30               # "no limit": the deepest tree Spark grows
LEAF_DEPTH = 8                  # of boosted trees without a limit, which boosting keeps small
LEAF_MIN_INSTANCES = 20
LEAF_SUBSAMPLE = 0.8
CV_PARALLELISM = 4
CANDIDATE_THREADS = 4
GRIDS = {
    "logistic": {"C": [0.01, 0.1, 1.0, 10.0]},
    "linear": {},
    "forest": {"numTrees": [50, 100, 150], "maxDepth": [None, 5, 10], "minSplit": [2, 5]},
    "boosted_level": {"rounds": [50, 100, 150], "maxDepth": [3, 5, 7], "learningRate": [0.01, 0.1, 0.2]},
    "boosted_leaf": {"rounds": [50, 100, 150], "maxDepth": [-1, 5, 10], "learningRate": [0.01, 0.1, 0.2]},
}
DEFAULTS = {
    "logistic": {"C": 1.0},
    "linear": {},
    "forest": {"numTrees": 100, "maxDepth": None, "minSplit": 2},
    "boosted_level": {"rounds": 100, "maxDepth": 6, "learningRate": 0.3},
    "boosted_leaf": {"rounds": 100, "maxDepth": -1, "learningRate": 0.1},
}
CANDIDATES = {
    "classification": [("Logistic Regression", "logistic"), ("Random Forest", "forest"),
                       ("Boosted Trees", "boosted_level"), ("Boosted Trees (leaf)", "boosted_leaf")],
    "regression": [("Linear Regression", "linear"), ("Random Forest", "forest"),
                   ("Boosted Trees", "boosted_level"), ("Boosted Trees (leaf)", "boosted_leaf")],
}


def _min_instances(split):
    return 1 if int(split) <= 2 else 2


def make_estimator(kind: str, problem: str, setting: dict, n_train: int, n_classes: int = 2,
                   forest_depth: int = FOREST_DEPTH, leaf_depth: int = LEAF_DEPTH):
    """M1-M5: the Spark ML estimator for one candidate setting.

    ``forest_depth`` and ``leaf_depth`` stand for "no limit" in forests and in
    boosted trees grown by leaves; ``n_train`` is the number of rows it will
    be fitted to.
    """
    s = {**DEFAULTS[kind], **setting}
    cls = problem == "classification"
    if kind == "logistic":
        # sklearn's C: loss = C * sum(logloss) + ||w||^2 / 2  ->  regParam = 1 / (C n)
        return LogisticRegression(maxIter=1000, regParam=1.0 / (float(s["C"]) * max(n_train, 1)),
                                  elasticNetParam=0.0, standardization=False)
    if kind == "linear":
        return LinearRegression(regParam=0.0, elasticNetParam=0.0, standardization=False)
    if kind == "forest":
        args = dict(numTrees=int(s["numTrees"]), maxDepth=forest_depth if s["maxDepth"] is None else int(s["maxDepth"]),
                    minInstancesPerNode=_min_instances(s["minSplit"]), seed=SPLIT_SEED)
        return RandomForestClassifier(**args) if cls else RandomForestRegressor(featureSubsetStrategy="all", **args)
    depth = int(s["maxDepth"])
    args = dict(maxIter=int(s["rounds"]), stepSize=float(s["learningRate"]), seed=SPLIT_SEED)
    if kind == "boosted_leaf":
        args.update(maxDepth=leaf_depth if depth < 0 else depth,
                    minInstancesPerNode=LEAF_MIN_INSTANCES, subsamplingRate=LEAF_SUBSAMPLE)
    else:
        args.update(maxDepth=depth)
    if not cls:
        return GBTRegressor(**args)
    if n_classes > 2:
        return OneVsRest(classifier=GBTClassifier(**args))
    return GBTClassifier(**args)


#: A fit of trees keeps its rows as objects: bytes of a row, and of each of its
#: features and of its counts in the trees' samples.  A partition of more bytes
#: than PART_BYTES is read whole by one task of every level, so its rows are dealt out.
ROW_BYTES = 250
CELL_BYTES = 4
PART_BYTES = 256 << 20
_TREES = (RandomForestClassifier, RandomForestRegressor, GBTClassifier, GBTRegressor, OneVsRest)
_MODELS = dict(zip(_TREES, (RandomForestClassificationModel, RandomForestRegressionModel, GBTClassificationModel, GBTRegressionModel)))
_INPUTS = ("featuresCol", "labelCol", "weightCol", "validationIndicatorCol")


def _width(train: DataFrame, features: str) -> int:
    """Number of features, from the assembler's metadata or else the first row."""
    known = train.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if known is None:
        row = train.select(features).first()
        known = row[0].size if row and row[0] is not None else 0
    return known


def in_parts(estimator, train: DataFrame) -> DataFrame:
    """The columns that an ensemble of trees is fitted to, in partitions of at
    most about ``PART_BYTES`` as the fit keeps them; as they are where they fit."""
    named = [estimator.getOrDefault(p) for p in _INPUTS if estimator.hasParam(p) and estimator.isDefined(p)]
    rows = train.select(*[c for c in dict.fromkeys(named) if c])
    trees = estimator.getNumTrees() if estimator.hasParam("numTrees") else 1
    each = ROW_BYTES + CELL_BYTES * (trees + _width(rows, estimator.getFeaturesCol()))
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    if not total or most * each <= PART_BYTES:
        return rows
    return rows.repartition(max(-(-total * each // PART_BYTES), rows.rdd.getNumPartitions()))


def fitted(estimator, train: DataFrame):
    """``estimator`` fitted to an assembled frame: boosted trees from the cells
    of its bins where a task can keep them, other trees to parts of bounded size."""
    if not isinstance(estimator, _TREES):
        return estimator.fit(train)
    parts = in_parts(estimator, train)
    drawn = estimator.hasParam("subsamplingRate") and estimator.getSubsamplingRate() < 1.0
    grown = boosted.fit(estimator, parts if drawn else train)
    if grown is not None or type(estimator) not in _MODELS:
        return estimator.fit(parts) if grown is None else grown
    return estimator._copyValues(boosted.quick(_MODELS[type(estimator)])(estimator._fit_java(parts)))


def fitted_stages(prep: Pipeline, estimator, rows: DataFrame) -> PipelineModel:
    """``prep`` and then ``estimator`` as one fitted pipeline."""
    done = prep.fit(rows)
    return PipelineModel(stages=[*done.stages, fitted(estimator, done.transform(rows))])


def fit_logistic(train: DataFrame, setting: dict | None = None, features="features"):
    """M1 on an assembled frame (``features``, ``label``)."""
    return make_estimator("logistic", "classification", setting or {}, train.count()).fit(train)


def fit_linear(train: DataFrame):
    """M2: ordinary least squares."""
    return make_estimator("linear", "regression", {}, 0).fit(train)


def fit_forest(train: DataFrame, problem: str, setting: dict | None = None):
    """M3."""
    return fitted(make_estimator("forest", problem, setting or {}, 0), train)


def fit_boosted_level(train: DataFrame, problem: str, setting: dict | None = None, n_classes: int = 2):
    """M4."""
    return fitted(make_estimator("boosted_level", problem, setting or {}, 0, n_classes), train)


def fit_boosted_leaf(train: DataFrame, problem: str, setting: dict | None = None, n_classes: int = 2):
    """M5 (Spark grows trees level-wise; leaf-wise growth is approximated)."""
    return fitted(make_estimator("boosted_leaf", problem, setting or {}, 0, n_classes), train)


def _kept(df: DataFrame) -> DataFrame:
    """A frame that many fits will read, in partitions by its size.  Written
    and read again, so that their plans are no longer than a scan: planning
    hundreds of jobs over nested cached frames took longer than their tasks."""
    df = in_file_order(written(df, "kept"))
    out = sized(df, df.count())
    return out if out is df or out.rdd.getNumPartitions() < df.rdd.getNumPartitions() else in_file_order(written(out, "kept"))


def label_column(df: DataFrame, target: str, classes: list[str] | None):
    """Index of the class in ``classes`` (sorted text), or the numeric target."""
    if classes is None:
        return F.col(target).cast("double")
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), _label_text(df, target))
    return F.when(pos > 0, (pos - 1).cast("double"))


ROWS_PER_FOLD_BUCKET = 100_000


def with_folds(train: DataFrame, key: str, folds: int, rows: int, by: str | None = None) -> DataFrame:
    """``train`` with ``fold`` 0..folds-1, balanced within each value of ``by``.

    Rows of a class are counted in the order of their key's hash and dealt
    out in turn.  The count is a window inside hash buckets plus each bucket's
    offset, so a class with most of the rows is numbered by many tasks.
    """
    group = F.col(by) if by else F.lit(0)
    buckets = max(1, -(-rows // ROWS_PER_FOLD_BUCKET))
    h = F.xxhash64(F.col(key).cast("string"), F.lit(SPLIT_SEED))
    marked = train.withColumns({"__class": group, "__bucket": F.pmod(h, F.lit(buckets)).cast("int"), "__hash": h})
    sizes = marked.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("__class").alias("__c"), F.col("__bucket").alias("__b"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__class", "__bucket").orderBy("__hash", F.col(key).cast("string"))
    numbered = marked.withColumn("__at", F.row_number().over(inside)).join(
        offsets, F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__bucket") == F.col("__b")))
    return numbered.withColumn("fold", F.pmod(F.col("__at") + F.col("__before"), F.lit(folds)).cast("int")).select(*train.columns, "fold")


def evaluator(problem: str):
    if problem == "classification":
        return MulticlassClassificationEvaluator(metricName="f1", labelCol="label", predictionCol="prediction")
    return RegressionEvaluator(metricName="r2", labelCol="label", predictionCol="prediction")


@dataclass
class SearchResult:
    name: str
    kind: str
    setting: dict
    cv_metric: float | None
    model: PipelineModel
    metrics: dict = field(default_factory=dict)


@dataclass
class Prepared:
    """Fitted preparations and their assembled frames: of the whole training
    split and, to validate, of each fold's complement (``fold`` kept)."""
    model: PipelineModel
    train: DataFrame
    rows: int
    folds: list[tuple[DataFrame, int]]

    def unpersist(self) -> None:
        for frame in [self.train, *(f for f, _ in self.folds)]:
            frame.unpersist()


def prepare_folds(train: DataFrame, numerical, categorical, folds: int, keep: bool = True) -> Prepared:
    """The preparation, fitted once per fold and once on all of ``train``
    (with ``label`` and ``fold``); every candidate and setting reads these.
    ``keep`` the assembled rows where they are read more than once."""
    prep = feature_pipeline(numerical, categorical)

    def one(fold):
        part = train if fold is None else train.where(F.col("fold") != fold)
        model = prep.fit(part)
        frame = model.transform(train).select("features", "label", *[c for c in ("fold",) if c in train.columns])
        return model, _kept(frame) if keep else frame, part.count()
    with ThreadPoolExecutor(max_workers=CV_PARALLELISM) as pool:
        done = list(pool.map(one, [None, *range(folds if folds >= 2 else 0)]))
    return Prepared(done[0][0], done[0][1], done[0][2], [(frame, n) for _, frame, n in done[1:]])


def random_search(name: str, kind: str, problem: str, prepared: Prepared, n_classes: int, grid: dict[str, list] | None = None) -> SearchResult:
    """M6: 3 seeded settings of ``grid`` (None: the kind's own), k-fold CV on
    weighted F1 / R^2, best refit on the whole training split; no CV (direct
    default fit) when there are no folds or the grid is empty."""
    grid, setting, metric = GRIDS[kind] if grid is None else grid, {}, None
    if grid and prepared.folds:
        settings = grid_settings(grid, N_SETTINGS)

        def score(at):
            k, fold = at
            frame, n = prepared.folds[fold]
            est = make_estimator(kind, problem, settings[k], n, n_classes)
            return evaluator(problem).evaluate(fitted(est, frame.where(F.col("fold") != fold)).transform(frame.where(F.col("fold") == fold)))
        todo = [(k, f) for k in range(len(settings)) for f in range(len(prepared.folds))]
        with ThreadPoolExecutor(max_workers=CV_PARALLELISM) as pool:
            scores = dict(zip(todo, pool.map(score, todo)))
        means = [sum(scores[k, f] for f in range(len(prepared.folds))) / len(prepared.folds) for k in range(len(settings))]
        best = max(range(len(settings)), key=lambda k: (means[k], -k))
        setting, metric = settings[best], float(means[best])
    est = make_estimator(kind, problem, setting, prepared.rows, n_classes)
    model = PipelineModel(stages=[*prepared.model.stages, fitted(est, prepared.train)])
    return SearchResult(name, kind, setting, metric, model)


def class_scores(pred: DataFrame):
    """Per-class scores: ``probability`` when the model has it, else a
    normalised logistic of the raw margins (one-vs-rest boosting)."""
    if "probability" in pred.columns:
        return vector_to_array("probability")
    raw = vector_to_array("rawPrediction")
    sig = F.transform(raw, lambda x: 1 / (1 + F.exp(-x)))
    return F.transform(sig, lambda x: x / F.aggregate(sig, F.lit(0.0), lambda a, b: a + b))


def evaluate_model(model: PipelineModel, test: DataFrame, problem: str,
                   classes: list[str] | None) -> dict:
    """E1-E7 on the test split, one small aggregate per metric group."""
    pred = model.transform(test)
    if problem != "classification":
        row = E.regression_metrics(pred, "label", "prediction").first()
        return {"r2_score": row["r2_score"], "mae": row["mae"], "mse": row["mse"], "rmse": row["rmse"]}
    # Scored once; the three metric groups read the kept predictions.
    p = pred.select("label", "prediction", class_scores(pred).alias("scores")).persist()
    acc = E.accuracy(p).first()["accuracy"]
    w = E.weighted_metrics(p).first()
    idx = [str(float(i)) for i in range(len(classes))]
    if len(classes) == 2:
        auc = E.roc_auc_binary(p.select("label", F.element_at("scores", 2).alias("score")), idx[1]).first()["roc_auc"]
    else:
        auc = E.roc_auc_ovr(p, idx, "label", "scores").first()["roc_auc"]
    p.unpersist()
    return {"accuracy": acc, "f1_score": w["weighted_f1"], "precision": w["weighted_precision"],
            "recall": w["weighted_recall"], "roc_auc": auc}


@dataclass
class TrainResult:
    problem: str
    target: str
    classes: list[str] | None
    candidates: list[SearchResult]
    best: SearchResult
    final_model: PipelineModel
    numerical: list[str]
    categorical: list[str]

    def results_frame(self, spark) -> DataFrame:
        rows = [(i, c.name, json.dumps(c.setting, sort_keys=True), c.cv_metric,
                 json.dumps(c.metrics, sort_keys=True), c.name == self.best.name)
                for i, c in enumerate(self.candidates)]
        return spark.createDataFrame(rows, "position int, algorithm string, params string, "
                                           "cv_metric double, metrics string, is_best boolean")

    def metadata(self) -> dict:
        return {"problem_type": self.problem, "target_column": self.target,
                "classes": self.classes,
                "label_mapping": {c: i for i, c in enumerate(self.classes)} if self.classes else None,
                "numerical": self.numerical, "categorical": self.categorical,
                "algorithm": self.best.name, "metrics": self.best.metrics}


#: The split key beside the features; a feature may be the key itself.
SPLIT_KEY = "__split_key"


def training_rows(df: DataFrame, target: str, numerical: list[str], categorical: list[str], key: str) -> DataFrame:
    """Rows with a target: the features and the target with formatted numbers
    coerced (P1), and the key as text in a column of its own."""
    cols = list(dict.fromkeys([*numerical, *categorical, target]))
    rows = df.where(F.col(target).isNotNull())
    keyed = rows.select(*cols, F.col(key).cast("string").alias(SPLIT_KEY)) if key != SPLIT_KEY else rows.select(*cols, key)
    kinds = dict(keyed.dtypes)
    text = [c for c in numerical + [target] if kinds[c] == "string"]
    chosen = {r["column"] for r in coerce_report(keyed.select(*text)).where("coerced").select("column").collect()} if text else set()
    return keyed.withColumns({c: parse_number(F.col(c)) for c in chosen}) if chosen else keyed


def auto_train(df: DataFrame, target: str, problem: str, numerical: list[str],
               categorical: list[str], key: str, kinds: list[str] | None = None) -> TrainResult:
    """M9 (with M6-M8): split, encode, search every candidate, pick the best
    test score (strict ``>``: the earlier candidate wins a tie), refit it on
    every row whose class is known.  Formatted numbers are coerced first (P1)."""
    # the key may itself be a feature (a numeric id the rule profile keeps)
    data = training_rows(df, target, numerical, categorical, key)
    key = SPLIT_KEY
    todo = [(name, kind) for name, kind in CANDIDATES[problem] if not kinds or kind in kinds]
    searched = any(GRIDS[kind] for _, kind in todo)
    train, test, data = split_written(data, key, whole=True, with_key=searched)
    classes = None
    if problem == "classification":
        classes = [r["label"] for r in encode_labels(train, target).orderBy("idx").collect()]
    lab = lambda d: d.withColumn("label", label_column(d, target, classes)).where(F.col("label").isNotNull())
    train_l, test_l, folds = lab(train), lab(test), 0
    if searched:
        folds = int(cv_folds(train, target, problem).first()["folds"] or 0)
        train_l = _kept(with_folds(train_l, key, max(folds, 2), train_l.count(), "label" if classes else None).drop(key))
    prepared = prepare_folds(train_l, numerical, categorical, folds, keep=searched)
    if test_l.isEmpty():
        test_l = train_l
    n_classes = len(classes) if classes else 0

    def run(candidate):
        name, kind = candidate
        r = random_search(name, kind, problem, prepared, n_classes)
        r.metrics = evaluate_model(r.model, test_l, problem, classes)
        return r

    # Candidates are independent Spark jobs over the same persisted frame;
    # a small driver thread pool keeps the cluster busy while each search
    # waits on its own jobs.  Results keep the candidate order.
    with ThreadPoolExecutor(max_workers=CANDIDATE_THREADS) as pool:
        results = list(pool.map(run, todo))
    metric = "f1_score" if problem == "classification" else "r2_score"
    best = results[0]
    for r in results[1:]:
        if (r.metrics.get(metric) or float("-inf")) > (best.metrics.get(metric) or float("-inf")):
            best = r
    final = refit_full(best, lab(data), problem, numerical, categorical, n_classes)
    prepared.unpersist()
    return TrainResult(problem, target, classes, results, best, final, numerical, categorical)


def refit_full(best: SearchResult, labelled: DataFrame, problem: str, numerical, categorical,
               n_classes: int) -> PipelineModel:
    """M8: the winning setting refit on every labelled row (known classes)."""
    n = labelled.count()
    est = make_estimator(best.kind, problem, best.setting, n, n_classes)
    return fitted_stages(feature_pipeline(numerical, categorical), est, labelled)


def train_custom_estimator(estimator, df: DataFrame, target: str, problem: str,
                           numerical: list[str], categorical: list[str], key: str,
                           classes: list[str] | None = None):
    """A user-supplied Spark ML estimator or Pipeline.  A bare estimator
    is wrapped with the feature stages; fit on the training split, evaluated
    on the test split, refit on every labelled row.  Returns
    ``(final_model, metrics, classes)``."""
    data = training_rows(df, target, numerical, categorical, key)
    train, test = split_train_test(data, SPLIT_KEY)
    if problem == "classification" and classes is None:
        classes = [r["label"] for r in encode_labels(train, target).orderBy("idx").collect()]
    lab = lambda d: d.withColumn("label", label_column(d, target, classes)).where(F.col("label").isNotNull())
    prep = feature_pipeline(numerical, categorical)
    pipe = estimator if isinstance(estimator, Pipeline) else Pipeline(stages=prep.getStages() + [estimator])
    def fit_to(rows):
        kept = _kept(rows)
        try:
            return fitted_stages(prep, estimator, kept) if isinstance(estimator, _TREES) else pipe.fit(kept)
        finally:
            kept.unpersist()
    model = fit_to(lab(train))
    test_l = lab(test)
    metrics = evaluate_model(model, test_l if not test_l.isEmpty() else lab(train), problem, classes)
    return fit_to(lab(data)), metrics, classes
