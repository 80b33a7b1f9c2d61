"""Evaluation aggregates: E1-E7.

Classification metrics come from one small confusion table
``groupBy(label, prediction).count()`` (classes x classes rows), never from
row loops.  AUC is exact Mann-Whitney with ties at half weight, computed
from per-score positive/negative counts and sums over ranges of scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeep.functions.ordered import sums_before


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` with both sides as text."""
    return pred.groupBy(F.col(label).cast("string").alias("label"),
                        F.col(prediction).cast("string").alias("prediction")) \
        .agg(F.count(F.lit(1)).cast("long").alias("n"))


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Correct / total."""
    return pred.agg(F.avg((F.col(label).cast("string") == F.col(prediction).cast("string"))
                          .cast("double")).alias("accuracy"))


def per_class(conf: DataFrame) -> DataFrame:
    """``(cls, support, predicted, tp, precision, recall, f1)`` from a
    confusion table; undefined ratios are 0 (zero_division=0)."""
    sup = conf.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    prd = conf.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    tp = conf.where(F.col("label") == F.col("prediction")).select(
        F.col("label").alias("cls"), F.col("n").alias("tp"))
    j = (sup.join(prd, "cls", "full_outer").join(tp, "cls", "left")
         .fillna(0, ["support", "predicted", "tp"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return out.withColumn("f1", f1)


def weighted_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support-weighted precision, recall and F1 in one row."""
    pc = per_class(confusion(pred, label, prediction))
    total = F.sum("support")
    return pc.agg(
        (F.sum(F.col("support") * F.col("precision")) / total).alias("weighted_precision"),
        (F.sum(F.col("support") * F.col("recall")) / total).alias("weighted_recall"),
        (F.sum(F.col("support") * F.col("f1")) / total).alias("weighted_f1"))


def weighted_precision(pred, label="label", prediction="prediction"):
    return weighted_metrics(pred, label, prediction).select("weighted_precision")


def weighted_recall(pred, label="label", prediction="prediction"):
    return weighted_metrics(pred, label, prediction).select("weighted_recall")


def weighted_f1(pred, label="label", prediction="prediction"):
    return weighted_metrics(pred, label, prediction).select("weighted_f1")


def _auc_from_counts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """AUC per group from ``(groups, score, pos, neg)`` distinct-score counts."""
    cum = sums_before(counts, groups, ["score"], ["neg"])
    part = F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))
    agg = cum.groupBy(*groups).agg(F.sum(part).alias("u"), F.sum("pos").alias("p"),
                                   F.sum("neg").alias("q"))
    return agg.select(*groups, F.when((F.col("p") > 0) & (F.col("q") > 0),
                                      F.col("u") / (F.col("p") * F.col("q"))).alias("auc"))


def roc_auc_binary(pred: DataFrame, positive: str, label: str = "label",
                   score: str = "score") -> DataFrame:
    """E5: AUC of ``score`` for ``label == positive``; one class only -> 0.0."""
    is_pos = F.col(label).cast("string") == F.lit(positive)
    counts = pred.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(is_pos).cast("long").alias("pos"),
        F.count_if(~is_pos).cast("long").alias("neg"))
    auc = _auc_from_counts(counts, [])
    return auc.select(F.coalesce("auc", F.lit(0.0)).alias("roc_auc"))


def roc_auc_ovr(pred: DataFrame, classes: list[str], label: str = "label",
                scores: str = "scores") -> DataFrame:
    """Unweighted mean of one-vs-rest AUCs.

    ``scores`` holds one probability per class in ``classes`` order (e.g.
    ``vector_to_array(probability)``).  A class without positives or
    negatives in the rows makes the whole metric 0.0.
    """
    names = F.array(*[F.lit(c) for c in classes])
    long = pred.select(F.col(label).cast("string").alias("__label"),
                       F.posexplode(scores).alias("cls_idx", "score"))
    long = long.withColumn("cls", F.element_at(names, F.col("cls_idx") + 1))
    is_pos = F.col("__label") == F.col("cls")
    counts = long.groupBy("cls", F.col("score").cast("double").alias("score")).agg(
        F.count_if(is_pos).cast("long").alias("pos"), F.count_if(~is_pos).cast("long").alias("neg"))
    per = _auc_from_counts(counts, ["cls"])
    return per.agg(
        F.when((F.count(F.lit(1)) == len(classes)) & (F.count("auc") == len(classes)),
               F.avg("auc")).otherwise(F.lit(0.0)).alias("roc_auc"))


def regression_metrics(pred: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """R^2 (constant target: 1.0 if perfect else 0.0), MAE, MSE, RMSE.

    One aggregation; the total sum of squares is ``var_pop * n`` (Welford
    style merge inside Spark, no cancellation from sum of squares).
    """
    e = F.col(yhat).cast("double") - F.col(y).cast("double")
    agg = pred.agg(
        F.sum(e * e).alias("sse"),
        (F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))).alias("sst"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))
    r2 = (F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst"))
          .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(r2.alias("r2_score"), "mae", "mse", F.sqrt("mse").alias("rmse"))
