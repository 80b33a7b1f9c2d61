"""Streams equal their batch twins (file sources, availableNow)."""

from pyspark.sql import functions as F

from modelkeep.operators import scoring as S
from modelkeep.sources import fixtures as V
from modelkeep.streaming import streams as X
from tests.conftest import SF_SMALL


def _write(df, path):
    df.write.mode("overwrite").parquet(path)
    return path


def test_stream_volume_equals_batch(spark, scratch):
    log = V.v_pred_log(spark, SF_SMALL)
    src = _write(log, scratch("log"))
    stream = spark.readStream.schema(log.schema).parquet(src)
    out, ck = scratch("vol"), scratch("ck")
    q = X.start(X.stream_volume(stream, watermark="0 seconds"), out, ck)
    q.awaitTermination()
    got = spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    want = X.volume_by_hour(log)
    # windows still open at the end of the stream are not emitted in append mode
    last = want.agg(F.max("window_start")).first()[0]
    a = sorted(map(tuple, got.where(F.col("window_start") < last).collect()))
    b = sorted(map(tuple, want.where(F.col("window_start") < last).collect()))
    assert a == b and len(a) > 0


def test_stream_score_equals_batch(spark, scratch):
    from pyspark.ml.regression import LinearRegression
    from modelkeep.operators.prep import feature_pipeline
    from pyspark.ml import Pipeline
    df = spark.range(200).select(F.col("id").alias("prediction_id"), (F.col("id") % 13).cast("double").alias("x"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    df = df.withColumn("label", F.col("x") * 2.0)
    model = Pipeline(stages=feature_pipeline(["x"], ["c"]).getStages() + [LinearRegression()]).fit(df)
    src = _write(df.drop("label"), scratch("inputs"))
    stream = spark.readStream.schema(df.drop("label").schema).parquet(src)
    out, ck = scratch("scored"), scratch("ck")
    X.start(X.stream_score(stream, model, None, 7, ["x", "c"]), out, ck).awaitTermination()
    got = {r["prediction_id"]: float(r["prediction"]) for r in spark.read.parquet(out).collect()}
    want = {r["prediction_id"]: r["prediction"] for r in model.transform(df).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def _in_parts(spark, df, path, parts):
    """``df`` as a folder of files that a stream reads one by one."""
    for k in range(parts):
        df.where(F.pmod(F.xxhash64("prediction_id", "received_at"), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_feedback_has_one_row_a_prediction(spark, scratch):
    """The sink itself equals the batch join: latest label within the wait, NULL without one."""
    preds = V.v_pred_log(spark, SF_SMALL).drop("actual")
    fb = V.v_feedback(spark, SF_SMALL)
    late = fb.where("prediction_id % 12 = 0").select("prediction_id", F.lit("late").alias("actual_value"), (F.col("received_at") + F.expr("INTERVAL 3 DAYS")).alias("received_at"))
    p_src, f_src = scratch("p"), scratch("f")
    for path, df, ts in ((p_src, preds, "logged_at"), (f_src, fb.unionByName(late), "received_at")):
        df.write.parquet(path)
        X.closing_events(df, ts, "20 days").write.mode("append").parquet(path)
    ps = spark.readStream.schema(preds.schema).parquet(p_src)
    fs = spark.readStream.schema(fb.schema).parquet(f_src)
    out = scratch("pairs")
    X.start(X.stream_feedback(ps, fs, "1 day"), out, scratch("ck")).awaitTermination()
    got = [(r["prediction_id"], r["actual"]) for r in spark.read.parquet(out).collect()]
    want = [(r["prediction_id"], r["actual"]) for r in S.attach_feedback(preds, fb).collect()]
    assert len(got) == len(want) and sorted(got, key=repr) == sorted(want, key=repr)


def _labels(spark):
    """Labels that are corrected, repeated, out of order, and for three deployments."""
    rows = []
    for k in range(120):
        dep = k % 3
        rows.append((k, dep, "a", "A" if k % 4 else "b", 10 + k))
        if k % 5 == 0:
            rows.append((k, dep, "a", "b", 500 + k))
        if k % 10 == 0:
            rows.append((k, dep, "a", "a", 900 + k))
        if k % 15 == 0:
            rows.append((k, dep, "a", "b", 5))  # older than the first
    rows += [(500 + k, 7, "a", None, 10) for k in range(9)] + [(600 + k, 8, "a", "a", 10) for k in range(3)]
    df = spark.createDataFrame(rows, "prediction_id long, deployment_id long, prediction string, actual string, at long")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("at"))
    return df.select("prediction_id", "deployment_id", "prediction", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("prediction_id")).alias("logged_at"),
                     "actual", at.alias("received_at"))


def _registry(spark):
    deps = spark.createDataFrame([(0, 10, "active", 0.3, 0.65), (1, 11, "active", 0.3, 0.99), (2, 12, "active", 0.3, 0.1), (8, 13, "active", 0.3, 0.9)],
                                 "id long, model_id long, status string, drift_threshold double, performance_threshold double")
    models = spark.createDataFrame([(10, 0, "DONE", "x", 0.5, None, 1, "m"), (11, 1, "DONE", "y", 0.5, None, 4, "m"), (12, 2, "DONE", "z", 0.5, None, 2, "m"),
                                    (13, 3, "DONE", "z", 0.5, None, 2, "m")],
                                   "id long, dataset_id long, status string, algorithm string, f1_score double, r2_score double, version long, model_name string")
    ds = spark.createDataFrame([(k, f"d{k}.csv", "classification", "y") for k in range(4)], "id long, name string, problem_type string, target_column string")
    return deps, models, ds


def _f9(df):
    return sorted((r["deployment_id"], r["n_labelled"], round(r["accuracy"], 9), r["alarm"], r["message"]) for r in df.collect())


def test_stream_performance_equals_batch_after_any_split_and_restart(spark, scratch):
    labels = _labels(spark)
    deps, models, ds = _registry(spark)
    last = X.latest_labels(labels)
    want = _f9(S.performance_check(last, deps))
    assert any(w[3] for w in want) and not all(w[3] for w in want)
    for parts in (1, 4):
        src, root, ck = scratch("labels"), scratch("perf"), scratch("ck")
        stream = _in_parts(spark, labels, src, parts)
        X.start_batches(X.label_changes(stream), X.performance_state(root, deps, models, ds), ck, mode="update").awaitTermination()
        assert _f9(X.performance_now(root, spark, deps)) == want
        # A restart goes on from the state: the same labels again change nothing, a correction changes one row.
        again = labels.where("prediction_id = 1").withColumn("actual", F.lit("zzz")).withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 1 HOUR"))
        labels.where("prediction_id < 40").unionByName(again).write.mode("append").parquet(src)
        X.start_batches(X.label_changes(stream), X.performance_state(root, deps, models, ds), ck, mode="update").awaitTermination()
        assert _f9(X.performance_now(root, spark, deps)) == _f9(S.performance_check(X.latest_labels(labels.unionByName(again)), deps))
        requests = spark.read.parquet(f"{root}/requests")
        assert requests.where("model_name = 'd1_autoretrain_v5'").count() == 1  # on the alarm's edge only
        if parts == 1:
            alarms = S.performance_check(last, deps).where("alarm")
            first = sorted(r["model_name"] for r in requests.where("batch_id = 0").collect())
            assert first == sorted(r["model_name"] for r in S.retrain_requests(alarms, models, deps, ds).collect())


def test_stream_performance_reads_no_history(spark, scratch):
    """A batch reads the totals of the one before, whatever else lies below the root; a replay writes the same."""
    deps, models, ds = _registry(spark)
    root = scratch("perf")
    body = X.performance_state(root, deps, models, ds)
    changes = spark.createDataFrame([(0, 6, 2), (1, 9, 9)], "deployment_id long, d_labelled long, d_correct long")
    for batch in (0, 1, 1):
        body(changes, batch)
    totals = {r["deployment_id"]: (r["n_labelled"], r["n_correct"]) for r in spark.read.parquet(f"{root}/totals/batch_id=1").collect()}
    assert totals == {0: (12, 4), 1: (18, 18)}
    assert spark.read.parquet(f"{root}/requests").where("batch_id = 1").count() == 0


def test_stream_drift_reads_the_reference_once(spark, scratch):
    from modelkeep.operators import drift as D
    ref = spark.range(3000).select((F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("g"), (F.col("id") % 3).cast("string").alias("c"))
    src = _write(ref, scratch("ref"))
    parts = [ref.where(f"x < {k}") for k in (20, 45)] + [ref.withColumn("c", F.lit("new"))]
    out = scratch("drift")
    reads = []

    class Once:
        """A reference that may be read by the first batch only."""
        def __getattr__(self, name):
            reads.append(name)
            return getattr(spark.read.parquet(src), name)

        def __getitem__(self, name):
            return spark.read.parquet(src)[name]
    body = X.drift_batch(Once(), out)
    body(parts[0], 0)
    assert reads
    reads.clear()
    for k, part in enumerate(parts[1:], 1):
        body(part, k)
    X.drift_batch(Once(), out)(parts[1], 1)  # after a restart, too
    assert not reads
    for k, part in enumerate(parts):
        feats, summary = D.drift_report(ref, part)
        row = spark.read.parquet(f"{out}/reports/batch_id={k}").drop("batch_id").first()
        assert row == summary.first()
        got = {r["feature"]: (r["position"], r["test_name"], r["n_ref"], r["n_cur"], r["n_values"], round(r["drift_score"], 9))
               for r in spark.read.parquet(f"{out}/features/batch_id={k}").collect()}
        assert got == {r["feature"]: (r["position"], r["test_name"], r["n_ref"], r["n_cur"], r["n_values"], round(r["drift_score"], 9)) for r in feats.collect()}
    plan = D.report_from_summary(spark.read.parquet(f"{out}/reference/version=0"), parts[0])
    few = X.drift_batch(ref, scratch("few"))
    few(ref.limit(3), 0)
    assert plan[1].first()["number_of_columns"] == 3


def test_reference_summaries_merge(spark, scratch):
    from modelkeep.operators import drift as D
    ref = spark.range(2000).select((F.col("id") % 90).cast("double").alias("x"), (F.col("id") % 4).cast("string").alias("c"))
    halves = [D.store_reference(ref.where(f"x {op} 30"), ref, scratch(name)) for op, name in (("<", "one"), (">=", "two"))]
    whole = D.store_reference(ref, ref, scratch("all"))
    key = (lambda r: (r["feature"], r["num"] or -1.0, r["cat"] or ""))
    cols = ["feature", "position", "num", "cat", "n"]
    assert sorted(D.merge_references(*halves).select(cols).collect(), key=key) == sorted(whole.select(cols).collect(), key=key)
