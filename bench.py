"""Benchmark the headline operators; prints ONE JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (default 3), BENCH_FULL=1 adds ``auto_train``
(a full 4-candidate search, several minutes).

result forced with ``write.format("noop")`` so the whole plan executes.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from modelkeep.functions.values import spread  # noqa: E402
from modelkeep.operators import drift as D  # noqa: E402
from modelkeep.operators import evaluate as E  # noqa: E402
from modelkeep.operators import profile as P  # noqa: E402
from modelkeep.operators import quality as Q  # noqa: E402
from modelkeep.operators import registry as R  # noqa: E402
from modelkeep.operators import train as M  # noqa: E402
from modelkeep.operators import prep as T  # noqa: E402
from modelkeep.plans import lifecycle as L  # noqa: E402
from modelkeep.session import get_spark, scratch_path  # noqa: E402
from modelkeep.sources import fixtures as V  # noqa: E402
from modelkeep.sources.tables import table  # noqa: E402
from modelkeep.streaming import streams as X  # noqa: E402


def force(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    full = os.environ.get("BENCH_FULL") == "1"
    spark = get_spark(f"local[{cpus}]", app="modelkeep-bench", shuffle_partitions=max(8, cpus * 2))

    li = table(spark, sf_dir, "lineitem")
    reg = V.v_reg(spark, sf_dir)
    reg_dp = L.profile_dataset(reg, "l_extendedprice")
    train, test = T.split_train_test(spread(reg), "k")
    prep = T.feature_pipeline(reg_dp.numerical, reg_dp.categorical).fit(
        train.withColumn("label", F.col("l_extendedprice")))
    reg_train = prep.transform(train.withColumn("label", F.col("l_extendedprice"))).persist()
    reg_train.count()
    linear = M.fit_linear(reg_train)
    scorer = prep  # prepared features + the fitted linear model
    log_src = scratch_path(spark, "bench-log")
    V.v_pred_log(spark, sf_dir).write.mode("overwrite").parquet(log_src)
    log_schema = spark.read.parquet(log_src).schema

    def profile_features():
        force(P.profile_features(P.coerce_numeric(li), "l_returnflag"))

    def quality_report():
        force(Q.quality_report(li, ["l_orderkey", "l_linenumber"]))

    def drift_large():
        ref, cur = V.v_drift_large(spark, sf_dir)
        feats, summary = D.drift_report(ref, cur)
        force(feats)
        force(summary)

    def drift_small():
        ref, cur = V.v_drift_parties(spark, sf_dir)
        feats, summary = D.drift_report(ref, cur)
        force(feats)
        force(summary)

    def evaluation():
        force(E.weighted_metrics(V.v_eval_cls(spark, sf_dir)))
        force(E.roc_auc_binary(V.v_eval_cls(spark, sf_dir), "1"))
        force(E.regression_metrics(V.v_eval_reg(spark, sf_dir)))

    def leaderboard_promotion():
        m = V.v_models(spark, sf_dir)
        deps = V.v_deployments(spark, sf_dir, m)
        force(R.leaderboard(m, deps))
        newest = m.where(F.col("status") == "DONE").groupBy("dataset_id").agg(
            F.max_by(F.struct("id", "version", "f1_score", "r2_score"), "id").alias("s")).select("dataset_id", "s.*")
        force(R.promote_if_better(newest, m, deps, V.v_datasets(spark, sf_dir, m)))

    def fit_linear():
        M.fit_linear(reg_train)

    def fit_forest():
        M.fit_forest(reg_train, "regression", {"numTrees": 50, "maxDepth": 5, "minSplit": 2})

    def fit_boosted_level():
        M.fit_boosted_level(reg_train, "regression", {"rounds": 50, "maxDepth": 3, "learningRate": 0.1})

    def score_batch():
        force(linear.transform(scorer.transform(reg)).select("k", "prediction"))

    def stream_volume():
        stream = spark.readStream.schema(log_schema).parquet(log_src)
        q = X.start(X.stream_volume(stream), scratch_path(spark, "bench-vol"),
                    scratch_path(spark, "bench-ck"))
        q.awaitTermination()

    def auto_train():
        df = V.v_cls(spark, sf_dir)
        dp = L.profile_dataset(df, "quality")
        M.auto_train(df, dp.target, dp.problem_type, dp.numerical, dp.categorical, "doc_id")

    suite = [("profile_features", profile_features), ("quality_report", quality_report),
             ("drift_report_large", drift_large), ("drift_report_small", drift_small),
             ("evaluation_metrics", evaluation), ("leaderboard_promotion", leaderboard_promotion),
             ("fit_linear", fit_linear), ("fit_forest", fit_forest),
             ("fit_boosted_level", fit_boosted_level), ("score_batch", score_batch),
             ("stream_volume", stream_volume)]
    if full:
        suite.append(("auto_train", auto_train))

    results = {}
    for name, fn in suite:
        fn()  # warm-up
        times = []
        for _ in range(1 if name == "auto_train" else runs):
            t0 = time.perf_counter()
            fn()
            times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": float(sf) if sf else sf_dir,
                      "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
