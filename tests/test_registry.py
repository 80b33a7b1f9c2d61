"""Registry, scoring, audit and sink behaviour."""

from pyspark.sql import functions as F

from modelkeep.operators import audit as A
from modelkeep.operators import registry as R
from modelkeep.operators import scoring as S
from modelkeep.sources import fixtures as V
from modelkeep.sources.tables import read_table, write_table
from tests.conftest import SF_SMALL

MODELS = ("id long, dataset_id long, status string, algorithm string, f1_score double, "
          "r2_score double, version long, model_name string, created_at timestamp")


def _models(spark):
    rows = [(1, 0, "DONE", "Random Forest", 0.7, None, 1, "d_v1", None),
            (2, 0, "DONE", "Logistic Regression", 0.9, None, 2, "d_v2", None),
            (3, 0, "PENDING", "Random Forest", None, None, 3, "d_v3", None),
            (4, 1, "DONE", "Linear Regression", None, 0.4, 1, "r_v1", None)]
    return spark.createDataFrame(rows, MODELS)


def _deps(spark):
    return spark.createDataFrame([(0, 1, "active", 0.3, 0.7), (1, 4, "active", 0.3, 0.7)],
                                 "id long, model_id long, status string, drift_threshold double, "
                                 "performance_threshold double")


def test_set_active_new_and_existing(spark):
    out = {r["model_id"]: r for r in R.set_active(_deps(spark), _models(spark), 2).collect()}
    assert out[2]["status"] == "active" and out[2]["id"] == 2 and out[2]["performance_threshold"] == 0.7
    assert out[1]["status"] == "inactive" and out[4]["status"] == "inactive"
    again = R.set_active(_deps(spark), _models(spark), 1).collect()
    assert len(again) == 2 and {r["model_id"] for r in again if r["status"] == "active"} == {1}


def test_set_active_requires_done(spark):
    import pytest
    with pytest.raises(ValueError):
        R.set_active(_deps(spark), _models(spark), 3)


def test_promote_if_better_strict_and_inherits(spark):
    models = _models(spark)
    ds = spark.createDataFrame([(0, "classification"), (1, "regression")], "id long, problem_type string")
    new = models.where(F.col("id").isin(2, 4))
    dec = {r["dataset_id"]: r for r in R.promote_if_better(new, models, _deps(spark), ds).collect()}
    assert dec[0]["promoted"] is True and "Auto-promoting" in dec[0]["message"]
    assert dec[1]["promoted"] is False  # 0.4 is not > 0.4
    snap = R.apply_promotions(_deps(spark), R.promote_if_better(new, models, _deps(spark), ds)).collect()
    act = [r for r in snap if r["status"] == "active"]
    assert {r["model_id"] for r in act} == {2, 4}
    assert all(r["drift_threshold"] == 0.3 for r in act)


def test_update_thresholds_keeps_none(spark):
    out = R.update_thresholds(_deps(spark), drift=None, performance=0.5).collect()
    assert all(r["performance_threshold"] == 0.5 and r["drift_threshold"] == 0.3 for r in out)


def test_leaderboard_rank_and_search(spark):
    lb = R.leaderboard(_models(spark), _deps(spark)).orderBy("rank").collect()
    assert [r["id"] for r in lb] == [2, 1, 4] and lb[1]["is_active"] is True
    lb2 = R.leaderboard(_models(spark), _deps(spark), "LOGISTIC").collect()
    assert [r["id"] for r in lb2] == [2]


def test_performance_rules(spark):
    rows = [(i, 0, "yes", "YES" if i < 3 else "no") for i in range(5)] + [(9, 1, "a", "A")]
    log = spark.createDataFrame(rows, "prediction_id long, deployment_id long, prediction string, actual string")
    chk = {r["deployment_id"]: r for r in S.performance_check(log, _deps(spark)).collect()}
    assert chk[0]["accuracy"] == 0.6 and chk[0]["alarm"] is True   # 0.6 < 0.7
    assert 1 not in chk                                            # fewer than 5 labelled
    reg = spark.createDataFrame([(1, 0, "1.14", "1.0"), (2, 0, "1.16", "1.0"), (3, 0, "0.1", "0"),
                                 (4, 0, "0.2", "0"), (5, 0, "5", "n/a")],
                                "prediction_id long, deployment_id long, prediction string, actual string")
    acc = S.accuracy_tolerance(reg).first()
    assert acc["n_correct"] == 2 and acc["n_labelled"] == 5


def test_feedback_latest_wins_and_unknown(spark):
    log = V.v_pred_log(spark, SF_SMALL).drop("actual")
    fb = V.v_feedback(spark, SF_SMALL)
    joined = S.attach_feedback(log, fb)
    six = joined.where(F.col("prediction_id") % 6 == 0).where(F.col("actual").isNotNull()).first()
    assert six["actual"] == six["actual"].lower()
    assert S.unknown_feedback(log, fb).count() == fb.where(F.col("prediction_id") >= 1_000_000_000).count()


def test_write_table_ids_and_audit(spark, scratch):
    path = scratch("audit")
    A.log_event(spark, path, "SYSTEM", "first")
    first_id = read_table(spark, path).first()["id"]
    A.log_events(spark, path, [("DRIFT", "two", "WARNING"), ("TRAINING", "three", "INFO")])
    ev = read_table(spark, path)
    ids = {r["message"]: r["id"] for r in ev.collect()}
    # unique and increasing across appends (not dense: no global row number)
    assert len(set(ids.values())) == 3 and ids["two"] > first_id and ids["three"] > first_id
    page = A.list_events(ev, severity="WARNING").collect()
    assert [r["message"] for r in page] == ["two"]
    counts = A.severity_counts(ev).first()
    assert (counts["info"], counts["warning"], counts["error"]) == (2, 1, 0)
    out = write_table(spark.createDataFrame([("x",)], "v string"), scratch("t"))
    assert "id" in out.columns


def test_list_events_bounds(spark):
    import pytest
    ev = V.v_audit(spark, SF_SMALL)
    with pytest.raises(ValueError):
        A.list_events(ev, limit=0)
    with pytest.raises(ValueError):
        A.list_events(ev, limit=201)
    assert A.list_events(ev, limit=5, offset=3).count() == 5
