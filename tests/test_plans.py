"""Composed plans: dataset registration, drift monitor, retraining."""

import json

from pyspark.sql import functions as F

from modelkeep.operators import train as M
from modelkeep.plans import lifecycle as L

MODELS = ("id long, dataset_id long, status string, algorithm string, f1_score double, "
          "r2_score double, version long, model_name string")


def _registry(spark):
    models = spark.createDataFrame([(1, 0, "DONE", "Random Forest", 0.5, None, 1, "ds_v1")], MODELS)
    deps = spark.createDataFrame([(0, 1, "active", 0.3, 0.7)], "id long, model_id long, status string, "
                                 "drift_threshold double, performance_threshold double")
    ds = spark.createDataFrame([(0, "churn.csv", "classification", "churn")],
                               "id long, name string, problem_type string, target_column string")
    return models, deps, ds


def _churn(spark, n=60):
    rows = [(i, 20 + i % 40, 1000 * (i % 17), "MF"[i % 2], "yes" if (i % 40) > 25 else "no")
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, age long, income long, gender string, churn string")


def test_register_dataset_row(spark):
    df = _churn(spark)
    row = L.register_dataset(df, "churn.csv", key=["id"]).first()
    assert row["target_column"] == "churn" and row["problem_type"] == "classification"
    meta = json.loads(row["features_metadata"])
    assert set(meta) == {"id", "age", "income", "gender"}
    assert meta["id"]["role"] == "ignore"          # rule profile: named id
    assert meta["gender"]["type"] == "categorical"
    assert "Rows: 60" in row["audit_message"]


def test_drift_monitor_flags_and_requests(spark):
    models, deps, ds = _registry(spark)
    ref = _churn(spark).select("age", "gender", "churn")
    log = spark.range(30).select(F.col("id").alias("prediction_id"), F.lit(0).cast("long").alias("deployment_id"),
                                 F.to_json(F.struct((F.col("id") + 90).alias("age"),
                                                    F.lit("Z").alias("gender"))).alias("input_json"))
    report, feats, requests = L.drift_monitor(deps, models, ds, {0: ref}, log)
    r = report.first()
    assert r["has_drift"] is True and "Retraining job has been queued" in r["message"]
    assert {f["feature"] for f in feats.collect()} == {"age", "gender"}
    req = requests.first()
    assert req["model_name"] == "churn_autotune_v2" and req["status"] == "PENDING"


def test_drift_monitor_without_logs(spark):
    models, deps, ds = _registry(spark)
    empty = spark.createDataFrame([], "prediction_id long, deployment_id long, input_json string")
    report, _, requests = L.drift_monitor(deps, models, ds, {0: _churn(spark)}, empty)
    assert report.first()["drift_score"] == 0.0 and requests is None


def test_run_retraining_with_feedback(spark):
    models, deps, ds = _registry(spark)
    df = _churn(spark)
    dp = L.profile_dataset(df, "churn")
    log = spark.createDataFrame(
        [(100 + i, 0, json.dumps({"age": 30 + i, "income": 5000, "gender": "M"}), "yes") for i in range(5)],
        "prediction_id long, deployment_id long, input_json string, actual string")
    result, decision = L.run_retraining(df, dp, "id", log, models, deps, ds, 0, kinds=["logistic"])
    assert result.best.name == "Logistic Regression"
    d = decision.first()
    assert d["active_model_id"] == 1 and d["promoted"] == (d["new_metric"] > 0.5)


def test_key_may_be_a_feature(spark):
    df = _churn(spark).withColumn("doc_id", F.col("id"))
    res = M.auto_train(df, "churn", "classification", ["doc_id", "age"], ["gender"], "doc_id",
                       kinds=["logistic"])
    assert res.best.metrics["accuracy"] >= 0.0


def test_monitor_query_reports_every_active_deployment(spark):
    from modelkeep.plans import registered as Q
    from tests.conftest import SF_SMALL
    m = Q._models(spark, SF_SMALL)
    active = {r["deployment_id"] for r in L.R.active_deployment(Q._deps(spark, SF_SMALL, m), m).collect()}
    reports = Q.QUERIES["D13_drift_monitor"](spark, SF_SMALL).collect()
    assert len(active) > 1 and sorted(r["deployment_id"] for r in reports) == sorted(active)
    logged = {r[0] for r in Q.V.v_pred_log(spark, SF_SMALL).select("deployment_id").distinct().collect()}
    assert {r["deployment_id"] for r in reports if r["message"] != L.NO_LOGS_MESSAGE} == active & logged


def test_retraining_query_trains_on_labelled_feedback(spark, monkeypatch):
    from modelkeep.plans import registered as Q
    from tests.conftest import SF_SMALL
    seen = {}
    fitted = M.auto_train

    def spy(data, *args):
        seen["keys"] = [r[0] for r in data.where("quality IS NOT NULL").select(M.SPLIT_KEY).collect()]
        return fitted(data, *args[:-1], ["logistic"])
    monkeypatch.setattr(L.M, "auto_train", spy)
    assert Q.QUERIES["F11_run_retraining"](spark, SF_SMALL).count() == 1
    labelled = {r["doc_id"] for r in Q.V.v_cls(spark, SF_SMALL).where("quality IS NOT NULL").collect()}
    feedback = [k for k in seen["keys"] if k.startswith("fb:")]
    assert sorted(int(k.removeprefix("fb:")) for k in seen["keys"]) == sorted(labelled)
    assert {int(k[3:]) for k in feedback} == {i for i in labelled if i % 5 == 0} != set()


def test_model_queries_return_predictions(spark):
    from modelkeep.plans import registered as Q
    from tests.conftest import SF_SMALL
    for name, key in (("M1_fit_logistic", "doc_id"), ("M8_refit_full", "doc_id"), ("M3_fit_forest", "k")):
        out = Q.QUERIES[name](spark, SF_SMALL)
        assert out.columns == [key, "label", "prediction"] and out.where("prediction IS NOT NULL").count() == out.count() > 0


def test_held_out_losses(spark):
    from modelkeep.plans import registered as Q

    class Fixed:
        def __init__(self, c):
            self.c = c

        def transform(self, df):
            return df.withColumn("prediction", self.c)
    train = spark.createDataFrame([(0.0,), (0.0,), (1.0,)], "label double")
    test = spark.createDataFrame([(0.0,), (1.0,)], "label double")
    held = lambda c, problem: tuple(Q._held_out(Fixed(c), train, test, problem).first())
    assert held(F.lit(1.0), "classification") == (2, 1.0, 1.0) and held(F.col("label"), "classification") == (2, 0.0, 1.0)
    n, own, constant = held(F.lit(0.5), "regression")
    assert (n, own) == (2, 0.5) and abs(constant - 5 / 9) < 1e-12


def test_linear_batch_equals_least_squares(spark):
    """Every prediction of F2, against the normal solution of numpy."""
    import numpy as np
    from modelkeep.plans import registered as Q
    from tests.conftest import SF_SMALL
    got = {}
    for r in Q.QUERIES["F2_score_batch"](spark, SF_SMALL).collect():
        got.setdefault(r["k"], []).append(r["prediction"])
    rows = Q.V.v_reg(spark, SF_SMALL).collect()
    flags = sorted({r["l_returnflag"] for r in rows})
    x = np.array([[r["l_quantity"], r["l_discount"], r["l_tax"], *(r["l_returnflag"] == f for f in flags)] for r in rows], float)
    y = np.array([r["l_extendedprice"] for r in rows])
    want = {}
    for r, p in zip(rows, x @ np.linalg.lstsq(x, y, rcond=None)[0]):
        want.setdefault(r["k"], []).append(p)
    assert set(got) == set(want)
    assert max(abs(a - b) for k in want for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True)) < 1e-3 * y.std()
