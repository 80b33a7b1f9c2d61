"""Structured Streaming: X1-X5.

The reference handles one event per HTTP call; here the same semantics run
over unbounded tables.  Sources are file/table streams, sinks are Parquet
folders with checkpoints under the session's checkpoint root, and every
``foreachBatch`` body is idempotent by batch id (a replayed batch
overwrites its own output folder), so a restarted query or a lost executor
never double-counts.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelkeep.operators import drift as D
from modelkeep.operators import scoring as S

DEFAULT_WATERMARK = "2 hours"


def volume_by_hour(log: DataFrame, ts: str = "logged_at") -> DataFrame:
    """X2 batch twin: predictions per deployment per hour."""
    return log.groupBy("deployment_id", F.date_trunc("hour", F.col(ts)).alias("window_start")) \
        .agg(F.count(F.lit(1)).cast("long").alias("predictions"))


def stream_volume(log_stream: DataFrame, every: str = "1 hour", ts: str = "logged_at",
                  watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Tumbling-window prediction counts; a window is emitted once the
    watermark passes its end (append mode), state is dropped after that."""
    # watermarks need TIMESTAMP (Parquet timestamps read as TIMESTAMP_NTZ)
    return (log_stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
            .groupBy("deployment_id", F.window(ts, every).alias("w"))
            .agg(F.count(F.lit(1)).cast("long").alias("predictions"))
            .select("deployment_id", F.col("w.start").alias("window_start"), "predictions"))


def stream_score(stream: DataFrame, model: PipelineModel, classes: list[str] | None,
                 deployment_id: int, inputs: list[str]) -> DataFrame:
    """F2 + F3 + F4 on an input stream (stateless, row by row)."""
    pred = S.scored(model, stream)
    if classes:
        pred = S.decode_labels(pred.withColumnRenamed("prediction", "raw_prediction"), classes)
    return pred.select(
        *[c for c in ("prediction_id",) if c in stream.columns],
        F.lit(deployment_id).cast("long").alias("deployment_id"),
        F.to_json(F.struct(*inputs)).alias("input_json"),
        F.col("prediction").cast("string").alias("prediction"),
        F.current_timestamp().alias("logged_at"))


def stream_feedback(preds: DataFrame, feedback: DataFrame, wait: str = "1 day") -> DataFrame:
    """Every prediction once, with the last label that arrives within
    ``wait``; NULL where none does.

    A stream-stream left outer join on the prediction id, with watermarks on
    both sides and a time bound, finds the labels; an aggregate keyed by
    prediction and its time keeps the latest of them.  The watermark is the
    timer: when it has passed a prediction's time and wait, its row is written
    and its state goes.  Labels for unknown predictions, and later ones, take no
    part.  The end of a stream is closed by :func:`closing_events`.
    """
    p = (preds.withColumn("logged_at", F.col("logged_at").cast("timestamp"))
         .withWatermark("logged_at", wait).alias("p"))
    f = (feedback.withColumn("received_at", F.col("received_at").cast("timestamp"))
         .withWatermark("received_at", wait)
         .select(F.col("prediction_id").alias("fb_id"), "actual_value", "received_at").alias("f"))
    cond = ((F.col("p.prediction_id") == F.col("f.fb_id"))
            & (F.col("f.received_at") >= F.col("p.logged_at"))
            & (F.col("f.received_at") <= F.col("p.logged_at") + F.expr(f"INTERVAL {wait}")))
    label = F.struct(F.unix_micros("f.received_at").alias("at"), F.col("f.actual_value").cast("string").alias("actual"))
    paired = p.join(f, cond, "leftOuter").select(
        "p.prediction_id", "p.deployment_id", "p.prediction", "p.logged_at", F.when(F.col("f.fb_id").isNotNull(), label).alias("label"))
    last = paired.groupBy("prediction_id", "deployment_id", "prediction", "logged_at").agg(F.max("label").alias("last"))
    return last.select(
        "prediction_id", "deployment_id", "prediction", "logged_at", F.col("last.actual").alias("actual"),
        F.timestamp_micros("last.at").alias("received_at"))


def closing_events(df: DataFrame, ts: str, after: str, key: str = "prediction_id") -> DataFrame:
    """One row of nothing but a time, ``after`` later than all of ``df``, and
    the smallest 64-bit number as id (a null would be filtered before any
    watermark sees it): as the last file of a bounded stream it lets the
    watermark pass every other row, and is never passed itself."""
    end = df.agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias(ts))
    return end.select(*[(F.col(f.name) if f.name == ts else F.lit(-(1 << 63)) if f.name == key else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in df.schema.fields])


def latest_labels(labelled: DataFrame) -> DataFrame:
    """Batch twin of :func:`label_changes`: the labelled rows of a table with
    the last label of each prediction."""
    known = labelled.where(F.col("actual").isNotNull())
    last = known.groupBy("prediction_id").agg(F.max_by(F.struct(*known.columns), "received_at").alias("last"))
    return last.select("last.*")


def label_changes(labelled: DataFrame, problem_type: str = "classification", wait: str = "30 days") -> DataFrame:
    """X4, first stage (update mode): ``(deployment_id, d_labelled, d_correct)``,
    what the batch changes in its deployments' counts.

    State is kept per prediction, so a hot deployment is spread over all
    tasks: the labels that came for it, with the time of the batch each came
    in.  What the labels of earlier batches made of it is taken back, what the
    latest label makes of it is added, so a corrected label counts once and a
    late one that something newer has replaced counts not at all.  State goes
    ``wait`` after a prediction was logged; labels after that are too late.
    """
    hit = (S.tolerance_correct(F.col("prediction"), F.col("actual")) if problem_type != "classification"
           else F.lower(F.col("prediction").cast("string")) == F.lower(F.col("actual").cast("string")))
    at = F.unix_micros(F.col("received_at").cast("timestamp")) if "received_at" in labelled.columns else F.unix_micros(F.col("logged_at").cast("timestamp"))
    rows = (labelled.withColumn("logged_at", F.col("logged_at").cast("timestamp")).withWatermark("logged_at", wait).where(F.col("actual").isNotNull())
            .select("prediction_id", "deployment_id", "logged_at",
                    F.struct(at.alias("at"), F.coalesce(hit, F.lit(False)).alias("hit"), F.unix_micros(F.current_timestamp()).alias("came")).alias("label")))
    kept = rows.groupBy("prediction_id", "deployment_id", "logged_at").agg(F.collect_set("label").alias("labels"), F.max("label.came").alias("now"))
    now = F.array_max("labels")["hit"]
    before = F.array_max(F.filter("labels", lambda x: x["came"] < F.col("now")))["hit"]
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return kept.select("deployment_id", (F.lit(1) - one(before.isNotNull())).alias("d_labelled"), (one(now) - one(before)).alias("d_correct"))


def performance_state(root: str, deployments: DataFrame, models: DataFrame | None = None, datasets: DataFrame | None = None):
    """X4, second stage: ``foreachBatch`` function over :func:`label_changes`.

    Adds the batch's changes to the deployments' totals (one row each), runs
    F9 on these, and requests retraining (F10) for a deployment when its alarm
    goes on.  A batch reads the totals that the batch before it wrote and no
    other history, and writes its own folders anew when it is replayed:
    ``totals``, ``checks`` (deployments it touched) and ``requests``.
    """

    def run(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        changes = batch.groupBy("deployment_id").agg(F.sum("d_labelled").alias("d_labelled"), F.sum("d_correct").alias("d_correct"))
        totals = f"{root}/totals/batch_id=%d"
        before = _latest(spark, f"{root}/totals", batch_id)
        schema = "deployment_id long, n_labelled long, n_correct long, alarm boolean"
        have = spark.read.schema(schema).parquet(totals % before) if before is not None else spark.createDataFrame([], schema)
        merged = have.withColumnRenamed("alarm", "was").join(changes, "deployment_id", "full").select(
            "deployment_id", *[(F.coalesce(f"n_{x}", F.lit(0)) + F.coalesce(f"d_{x}", F.lit(0))).cast("long").alias(f"n_{x}") for x in ("labelled", "correct")],
            F.coalesce("was", F.lit(False)).alias("was"), F.col("d_labelled").isNotNull().alias("touched"))
        rows = merged.withColumn("accuracy", F.col("n_correct") / F.nullif("n_labelled", F.lit(0)))
        checked = S.check_accuracy(rows, deployments)
        alarms = checked.select(F.col("deployment_id").alias("of"), "alarm")
        stored = rows.join(alarms, F.col("deployment_id") == F.col("of"), "left").withColumn("alarm", F.coalesce("alarm", F.lit(False)))
        stored.select("deployment_id", "n_labelled", "n_correct", "alarm", "was", "touched").write.mode("overwrite").parquet(totals % batch_id)
        now = spark.read.parquet(totals % batch_id)
        touched = now.where("touched").select("deployment_id")
        S.check_accuracy(now.withColumn("accuracy", F.col("n_correct") / F.nullif("n_labelled", F.lit(0))).drop("alarm"), deployments).join(
            touched, "deployment_id", "left_semi").write.mode("overwrite").parquet(f"{root}/checks/batch_id={batch_id}")
        if models is not None and datasets is not None:
            S.retrain_requests(now.where("alarm AND NOT was"), models, deployments, datasets).write.mode("overwrite") \
                .parquet(f"{root}/requests/batch_id={batch_id}")

    return run


def _latest(spark, folder: str, before: int) -> int | None:
    """The last batch before ``before`` that has written below ``folder``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return None
    names = [str(s.getPath().getName()) for s in fs.listStatus(path)]
    done = [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]
    done = [n for n in done if n < before and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch_id={n}/_SUCCESS"))]
    return max(done, default=None)


def performance_now(root: str, spark, deployments: DataFrame) -> DataFrame:
    """F9 of every deployment as of the last batch below ``root``."""
    last = _latest(spark, f"{root}/totals", 1 << 62)
    if last is None:
        return S.check_accuracy(spark.createDataFrame([], "deployment_id long, n_labelled long, accuracy double"), deployments)
    now = spark.read.parquet(f"{root}/totals/batch_id={last}")
    return S.check_accuracy(now.select("deployment_id", "n_labelled", (F.col("n_correct") / F.nullif("n_labelled", F.lit(0))).alias("accuracy")), deployments)


def drift_batch(reference: DataFrame, out_root: str, target: str | None = None,
                threshold: float = D.DEFAULT_DRIFT_THRESHOLD, version: int = 0):
    """X5 body: ``foreachBatch`` function running D11 of the micro-batch's
    inputs against the reference and writing one report per batch.

    The first batch stores the reference's value counts under ``version``; every
    later one, also after a restart, reads these and no row of the reference.
    """
    summary = f"{out_root}/reference/version={version}"

    def run(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{summary}/_SUCCESS")
        if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
            D.store_reference(reference, batch, summary, target)
        feats, report = D.report_from_summary(spark.read.parquet(summary), batch, threshold)
        report.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(f"{out_root}/reports/batch_id={batch_id}")
        feats.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(f"{out_root}/features/batch_id={batch_id}")

    return run


def start(query_df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
          available_now: bool = True, fmt: str = "parquet"):
    """Start a file-sink query (``availableNow`` processes what is there
    and stops, which is how tests and scheduled runs use it)."""
    w = query_df.writeStream.outputMode(mode).format(fmt).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start(sink)


def start_batches(query_df: DataFrame, body, checkpoint: str, available_now: bool = True,
                  mode: str = "append"):
    """Start a ``foreachBatch`` query with a checkpoint."""
    w = query_df.writeStream.outputMode(mode).foreachBatch(body).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
