"""Views derived from the driver's tables (FIXTURES.md, part 2).

The test data has no bookkeeping tables, so models, deployments, prediction
logs, feedback and audit events are derived deterministically from whole
tables (orders, events, lineitem, ...).  Each view exists twice: as a Spark
DataFrame (the library's input) and as DuckDB SQL (inlined by the oracle).
Every view reads its source table in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeep.functions.ordered import dense_positions
from modelkeep.sources.tables import table

# Algorithm label per order priority and audit event mapping
# used by the derived registry views.
PRIORITY_ALGORITHM = [
    ("1-URGENT", "Random Forest"),
    ("2-HIGH", "Logistic Regression"),
    ("3-MEDIUM", "XGBoost"),
    ("4-NOT SPECIFIED", "LightGBM"),
    ("5-LOW", "Linear Regression"),
]
AUDIT_TYPE = [
    ("click", "TRAINING"),
    ("view", "DEPLOYMENT"),
    ("error", "DRIFT"),
    ("purchase", "RETRAINING"),
    ("signup", "SYSTEM"),
]
N_DATASETS = 20
N_LOG_DEPLOYMENTS = 5


def _case(col, pairs, default=None):
    expr = None
    for k, v in pairs:
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def v_dirty(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price_txt"),
        "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_orderkey") % 10 < 7, F.col("o_custkey").cast("string"))
         .otherwise(F.lit("n/a")).alias("mixed"),
        F.when(F.col("o_orderkey") % 5 < 3, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("sparse"))


def v_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url")


def v_cls(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents")
    return labels.join(docs, "doc_id").select("doc_id", "n_chars", "lang", "source", "quality")


def _reg_key():
    return F.concat_ws(":", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                       F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))


def v_reg(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(_reg_key().alias("k"), "l_quantity", "l_discount", "l_tax",
                     "l_returnflag", "l_extendedprice")


def v_nulls(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    three = F.col("l_linenumber") == 3
    return li.select(_reg_key().alias("k"), "l_linenumber",
                     F.when(three, F.lit(None).cast("double")).otherwise(F.col("l_quantity")).alias("l_quantity"),
                     "l_discount", "l_tax",
                     F.when(three, F.lit(None).cast("string")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
                     "l_extendedprice")


def v_eval_cls(spark: SparkSession, d: str) -> DataFrame:
    c = v_cls(spark, d)
    return c.select("doc_id", F.col("quality").cast("string").alias("label"),
                    F.when(F.col("n_chars") > 500, "1").otherwise("0").alias("prediction"),
                    F.col("n_chars").cast("double").alias("score"))


def v_eval_multi(spark: SparkSession, d: str, classes: list[str]) -> DataFrame:
    """Multiclass predictions with one score per class, in ``classes`` order."""
    e = table(spark, d, "events")
    pred = F.when(F.col("event_id") % 4 == 0, F.lit("click")).otherwise(F.col("event_type"))
    base = e.select("event_id", F.col("event_type").alias("label"), pred.alias("prediction"))
    hit = F.lit(0.5) + (F.col("event_id") % 7).cast("double") / F.lit(20.0)
    miss = (F.col("event_id") % 5).cast("double") / F.lit(20.0)
    scores = F.array(*[F.when(F.col("prediction") == c, hit).otherwise(miss) for c in classes])
    return base.withColumn("scores", scores)


def v_eval_reg(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_extendedprice").alias("y"),
                     (F.col("l_quantity") * F.lit(1500.0)).alias("yhat"))


def v_models(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    ds = F.col("o_custkey") % N_DATASETS
    done = F.col("o_orderstatus") == "F"
    # a score in [0, 1) whose decimals never end on a rounding tie
    score = F.col("o_totalprice") / (F.col("o_totalprice") + F.lit(100000.0))
    base = o.select(
        F.col("o_orderkey").alias("id"),
        ds.alias("dataset_id"),
        _case(F.col("o_orderstatus"), [("F", "DONE"), ("O", "TRAINING")], "PENDING").alias("status"),
        _case(F.col("o_orderpriority"), PRIORITY_ALGORITHM[:-1], PRIORITY_ALGORITHM[-1][1]).alias("algorithm"),
        F.when(done & (ds % 2 == 0), score).alias("f1_score"),
        F.when(done & (ds % 2 == 1), score).alias("r2_score"),
        F.col("o_orderdate").alias("created_at"))
    # version = position of the model inside its dataset, by id; computed in
    # buckets so a dataset holding most models never sits in one task.
    ranked = dense_positions(base, ["dataset_id"], ["id"], name="version", few_groups=False)
    return ranked.withColumn("version", F.col("version").cast("long")).withColumn(
        "model_name", F.concat(F.lit("dataset_"), F.col("dataset_id").cast("string"),
                               F.lit("_v"), F.col("version").cast("string")))


def v_deployments(spark: SparkSession, d: str, models: DataFrame | None = None) -> DataFrame:
    """The 3 smallest DONE model ids per dataset; the smallest is active.

    ``row_number() <= 3`` plans a WindowGroupLimit: each input partition keeps
    its own top 3 per dataset before the shuffle.
    """
    from pyspark.sql import Window
    m = models if models is not None else v_models(spark, d)
    w = Window.partitionBy("dataset_id").orderBy("id")
    top = (m.where(F.col("status") == "DONE")
           .select("id", "dataset_id", "created_at")
           .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 3))
    return top.select(
        (F.col("dataset_id") * 3 + F.col("rn") - 1).cast("long").alias("id"),
        F.col("id").alias("model_id"),
        F.when(F.col("rn") == 1, "active").otherwise("inactive").alias("status"),
        F.lit(0.3).alias("drift_threshold"),
        F.lit(0.7).alias("performance_threshold"),
        F.col("created_at").alias("deployed_at"))


def v_datasets(spark: SparkSession, d: str, models: DataFrame | None = None) -> DataFrame:
    m = models if models is not None else v_models(spark, d)
    return m.groupBy("dataset_id").agg(F.min("created_at").alias("created_at")).select(
        F.col("dataset_id").alias("id"),
        F.concat(F.lit("dataset_"), F.col("dataset_id").cast("string"), F.lit(".csv")).alias("name"),
        F.when(F.col("dataset_id") % 2 == 0, "classification").otherwise("regression").alias("problem_type"),
        F.lit("target").alias("target_column"),
        "created_at")


def v_pred_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("prediction_id"),
        (F.col("user_id") % N_LOG_DEPLOYMENTS).alias("deployment_id"),
        F.col("ts").alias("logged_at"),
        F.col("props").alias("input_json"),
        F.when(F.col("value") > 50, "purchase").otherwise("view").alias("prediction"),
        F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).alias("actual"))


def v_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Ground-truth arrivals: a first label for every third event, a later
    correction for every sixth, and labels for ids that were never logged."""
    e = table(spark, d, "events")
    first = e.where(F.col("event_id") % 3 == 0).select(
        F.col("event_id").alias("prediction_id"), F.upper("event_type").alias("actual_value"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("received_at"))
    fix = e.where(F.col("event_id") % 6 == 0).select(
        F.col("event_id").alias("prediction_id"), F.lower("event_type").alias("actual_value"),
        (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("received_at"))
    stray = e.where(F.col("event_id") % 97 == 0).select(
        (F.col("event_id") + F.lit(1_000_000_000)).alias("prediction_id"),
        F.upper("event_type").alias("actual_value"),
        (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias("received_at"))
    return first.unionByName(fix).unionByName(stray)


def v_pred_reg(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    eid = F.col("event_id")
    actual = (F.when(eid % 50 == 0, F.lit("n/a"))
              .when(eid % 49 == 0, F.lit("0"))
              .otherwise((F.col("value") * (F.lit(1.0) + (eid % 5).cast("double") / F.lit(20.0)))
                         .cast("string")))
    return e.select(eid.alias("prediction_id"),
                    (F.col("user_id") % N_LOG_DEPLOYMENTS).alias("deployment_id"),
                    F.col("value").cast("string").alias("prediction"),
                    actual.alias("actual"))


def v_audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    sev = (F.when(F.col("event_type") == "error", "ERROR")
           .when(F.col("value") > 100, "WARNING").otherwise("INFO"))
    return e.select(
        F.col("event_id").alias("id"),
        _case(F.col("event_type"), AUDIT_TYPE).alias("event_type"),
        F.concat(F.col("event_type"), F.lit(" event "), F.col("event_id").cast("string")).alias("message"),
        sev.alias("severity"),
        F.col("ts").alias("created_at"))


def v_drift_large(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
    ref = li.where(F.col("l_returnflag") == "N").select(*cols)
    cur = li.where(F.col("l_returnflag") != "N").select(
        (F.col("l_quantity") * F.lit(1.5)).alias("l_quantity"), *cols[1:])
    return ref, cur


def _party(spark, d, name, prefix):
    t = table(spark, d, name)
    nation = table(spark, d, "nation")
    region = table(spark, d, "region")
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")
    return t.join(F.broadcast(geo), t[f"{prefix}_nationkey"] == geo.n_nationkey, "left").select(
        F.col(f"{prefix}_nationkey").alias("nationkey"),
        F.col(f"{prefix}_acctbal").alias("acctbal"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.when(F.col(f"{prefix}_acctbal") > 0, 1).otherwise(0).alias("positive"))


def v_drift_parties(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Reference = every supplier, current = every customer, on shared
    geography/balance features.  Small reference (<= 1000 rows up to sf0.1)
    exercises the KS / chi-square / z branch on whole tables."""
    return _party(spark, d, "supplier", "s"), _party(spark, d, "customer", "c")


# ---------------------------------------------------------------------------
# DuckDB twins (inlined by oracle SQL as CTEs)
# ---------------------------------------------------------------------------

def _sql_case(col, pairs, default=None):
    body = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in pairs)
    tail = f" ELSE '{default}'" if default is not None else ""
    return f"CASE {body}{tail} END"


_REG_KEY_SQL = ("concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                "CAST(round(l_extendedprice * 100) AS BIGINT))")

SQL_VIEWS: dict[str, str] = {
    "v_dirty": """
        SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS price_txt,
               o_orderstatus, o_orderpriority,
               CASE WHEN o_orderkey % 10 < 7 THEN CAST(o_custkey AS VARCHAR) ELSE 'n/a' END AS mixed,
               CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE o_orderpriority END AS sparse
        FROM orders""",
    "v_urls": "SELECT page_id, url FROM pages",
    "v_cls": """
        SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_reg": f"""
        SELECT {_REG_KEY_SQL} AS k, l_quantity, l_discount, l_tax, l_returnflag, l_extendedprice
        FROM lineitem""",
    "v_nulls": f"""
        SELECT {_REG_KEY_SQL} AS k, l_linenumber,
               CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity,
               l_discount, l_tax,
               CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS l_returnflag,
               l_extendedprice
        FROM lineitem""",
    "v_eval_cls": """
        SELECT doc_id, CAST(quality AS VARCHAR) AS label,
               CASE WHEN n_chars > 500 THEN '1' ELSE '0' END AS prediction,
               CAST(n_chars AS DOUBLE) AS score
        FROM v_cls""",
    "v_eval_multi": """
        SELECT event_id, event_type AS label,
               CASE WHEN event_id % 4 = 0 THEN 'click' ELSE event_type END AS prediction
        FROM events""",
    "v_eval_reg": """
        SELECT l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS yhat FROM lineitem""",
    "v_models": f"""
        SELECT *, 'dataset_' || dataset_id || '_v' || version AS model_name FROM (
          SELECT o_orderkey AS id, o_custkey % {N_DATASETS} AS dataset_id,
                 CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'TRAINING' ELSE 'PENDING' END AS status,
                 {_sql_case('o_orderpriority', PRIORITY_ALGORITHM[:-1], PRIORITY_ALGORITHM[-1][1])} AS algorithm,
                 CASE WHEN o_orderstatus = 'F' AND (o_custkey % {N_DATASETS}) % 2 = 0
                      THEN o_totalprice / (o_totalprice + 100000.0::DOUBLE) END AS f1_score,
                 CASE WHEN o_orderstatus = 'F' AND (o_custkey % {N_DATASETS}) % 2 = 1
                      THEN o_totalprice / (o_totalprice + 100000.0::DOUBLE) END AS r2_score,
                 o_orderdate AS created_at,
                 CAST(row_number() OVER (PARTITION BY o_custkey % {N_DATASETS} ORDER BY o_orderkey) AS BIGINT) AS version
          FROM orders)""",
    "v_deployments": """
        SELECT CAST(dataset_id * 3 + rn - 1 AS BIGINT) AS id, id AS model_id,
               CASE WHEN rn = 1 THEN 'active' ELSE 'inactive' END AS status,
               0.3::DOUBLE AS drift_threshold, 0.7::DOUBLE AS performance_threshold,
               created_at AS deployed_at
        FROM (SELECT id, dataset_id, created_at,
                     row_number() OVER (PARTITION BY dataset_id ORDER BY id) AS rn
              FROM v_models WHERE status = 'DONE')
        WHERE rn <= 3""",
    "v_datasets": """
        SELECT dataset_id AS id, 'dataset_' || dataset_id || '.csv' AS name,
               CASE WHEN dataset_id % 2 = 0 THEN 'classification' ELSE 'regression' END AS problem_type,
               'target' AS target_column, min(created_at) AS created_at
        FROM v_models GROUP BY dataset_id""",
    "v_pred_log": f"""
        SELECT event_id AS prediction_id, user_id % {N_LOG_DEPLOYMENTS} AS deployment_id,
               ts AS logged_at, props AS input_json,
               CASE WHEN value > 50 THEN 'purchase' ELSE 'view' END AS prediction,
               CASE WHEN event_id % 3 = 0 THEN upper(event_type) END AS actual
        FROM events""",
    "v_feedback": """
        SELECT event_id AS prediction_id, upper(event_type) AS actual_value,
               ts + INTERVAL 1 HOUR AS received_at FROM events WHERE event_id % 3 = 0
        UNION ALL
        SELECT event_id, lower(event_type), ts + INTERVAL 2 HOUR FROM events WHERE event_id % 6 = 0
        UNION ALL
        SELECT event_id + 1000000000, upper(event_type), ts + INTERVAL 3 HOUR
        FROM events WHERE event_id % 97 = 0""",
    "v_pred_reg": f"""
        SELECT event_id AS prediction_id, user_id % {N_LOG_DEPLOYMENTS} AS deployment_id,
               CAST(value AS VARCHAR) AS prediction,
               CASE WHEN event_id % 50 = 0 THEN 'n/a' WHEN event_id % 49 = 0 THEN '0'
                    ELSE CAST(value * (1.0::DOUBLE + CAST(event_id % 5 AS DOUBLE) / 20.0::DOUBLE) AS VARCHAR)
               END AS actual
        FROM events""",
    "v_audit": f"""
        SELECT event_id AS id, {_sql_case('event_type', AUDIT_TYPE)} AS event_type,
               event_type || ' event ' || event_id AS message,
               CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 100 THEN 'WARNING' ELSE 'INFO' END AS severity,
               ts AS created_at
        FROM events""",
    "v_drift_ref": """
        SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus
        FROM lineitem WHERE l_returnflag = 'N'""",
    "v_drift_cur": """
        SELECT l_quantity * 1.5::DOUBLE AS l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus
        FROM lineitem WHERE l_returnflag <> 'N'""",
    "v_geo": """
        SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_party_ref": """
        SELECT s_nationkey AS nationkey, s_acctbal AS acctbal, r_name AS region, n_name AS nation,
               CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS positive
        FROM supplier LEFT JOIN v_geo ON s_nationkey = n_nationkey""",
    "v_party_cur": """
        SELECT c_nationkey AS nationkey, c_acctbal AS acctbal, r_name AS region, n_name AS nation,
               CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS positive
        FROM customer LEFT JOIN v_geo ON c_nationkey = n_nationkey""",
}

_DEPENDS = {
    "v_eval_cls": ["v_cls"],
    "v_deployments": ["v_models"],
    "v_datasets": ["v_models"],
    "v_party_ref": ["v_geo"],
    "v_party_cur": ["v_geo"],
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs for ``names`` (dependencies first)."""
    ordered: list[str] = []

    def add(n):
        for dep in _DEPENDS.get(n, []):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
