"""Registered queries: one Spark plan and one DuckDB oracle per operator.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Each query reads whole driver tables (or views Spark derives from them).
Measures are rounded to 6 places and counts cast to BIGINT on both sides so
that the value hash compares like with like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelkeep.operators import profile as P
from modelkeep.operators import quality as Q
from modelkeep.plans.oracle import (
    SPECS, coerced_view, ignorable_sql, parse_sql, profile_sql, unpivot_text_sql)
from modelkeep.sources import fixtures as V
from modelkeep.sources.fixtures import with_views
from modelkeep.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- profiling
DIRTY_COERCED = ["price_txt"]
_DIRTY_C_SQL, _DIRTY_C_SPEC = coerced_view("v_dirty", SPECS["v_dirty"], DIRTY_COERCED)
_DIRTY_TEXT = [n for n, k in SPECS["v_dirty"] if k == "text"]


def _dirty(spark, d):
    return V.v_dirty(spark, d)


def _dirty_coerced(spark, d):
    return P.coerce_numeric(V.v_dirty(spark, d))


@register("P1_coerce_numeric", with_views(f"""
WITH u AS ({unpivot_text_sql('v_dirty', [(n, 'text') for n in _DIRTY_TEXT], ['o_orderkey'])}),
p AS (SELECT "column", value, {parse_sql('value')} AS x FROM u),
a AS (SELECT "column", CAST(count(value) AS BIGINT) AS non_null, CAST(count(x) AS BIGINT) AS parsed,
             sum(x) AS sp FROM p GROUP BY "column")
SELECT "column", non_null, parsed,
       round(CASE WHEN non_null > 0 THEN CAST(parsed AS DOUBLE) / non_null END, 6) AS parse_ratio,
       (non_null > 0 AND CAST(parsed AS DOUBLE) / non_null >= 0.8) AS coerced,
       round(CASE WHEN non_null > 0 AND CAST(parsed AS DOUBLE) / non_null >= 0.8 THEN sp END, 6) AS sum_value
FROM a""", "v_dirty"))
def q_p1(spark, d):
    rep = P.coerce_report(_dirty(spark, d))
    return rep.select("column", "non_null", "parsed", r6("parse_ratio").alias("parse_ratio"),
                      "coerced", r6("sum_value").alias("sum_value"))


def _ign_sql(source, spec):
    return f"""
WITH prof AS ({profile_sql(source, spec)}),
ign AS ({ignorable_sql('prof')})
SELECT "column", CAST(pos AS INTEGER) AS pos, round(url_ratio, 6) AS url_ratio,
       round(uniqueness, 6) AS uniqueness, n_unique, ignorable FROM ign"""


def _ign_out(df):
    return P.detect_ignorable(df).select(
        "column", F.col("pos").cast("int").alias("pos"), r6("url_ratio").alias("url_ratio"),
        r6("uniqueness").alias("uniqueness"), "n_unique", "ignorable")


@register("P2_detect_ignorable", _ign_sql("customer", SPECS["customer"]))
def q_p2(spark, d):
    return _ign_out(table(spark, d, "customer"))


@register("P2_detect_ignorable_urls", with_views(_ign_sql("v_urls", SPECS["v_urls"]), "v_urls"))
def q_p2_urls(spark, d):
    return _ign_out(V.v_urls(spark, d))


_DIRTY_IGN = f"""
WITH dc AS ({_DIRTY_C_SQL}),
prof AS ({profile_sql('dc', _DIRTY_C_SPEC)}),
ign AS ({ignorable_sql('prof')})"""


@register("P3_pick_target", with_views(_DIRTY_IGN + """
SELECT COALESCE((SELECT "column" FROM ign WHERE NOT ignorable ORDER BY pos DESC LIMIT 1),
                'sparse') AS target""", "v_dirty"))
def q_p3(spark, d):
    return P.pick_target(_dirty_coerced(spark, d))


_P4_CASES = [("v_dirty", "sparse", False), ("lineitem", "l_quantity", True),
             ("lineitem", "l_returnflag", False), ("lineitem", "l_extendedprice", True),
             ("v_cls", "quality", True), ("customer", "c_nationkey", True),
             ("orders", "o_totalprice", True)]


def _p4_sql():
    parts = []
    for src, col, numeric in _P4_CASES:
        n = f"CAST(count(DISTINCT {col}) AS BIGINT)"
        pt = (f"CASE WHEN {n} < 15 THEN 'classification' ELSE 'regression' END" if numeric
              else "'classification'")
        parts.append(f"SELECT '{src}' AS source, '{col}' AS target, {n} AS n_unique, {pt} AS problem_type FROM {src}")
    return with_views("\nUNION ALL\n".join(parts), "v_dirty", "v_cls")


@register("P4_infer_problem_type", _p4_sql())
def q_p4(spark, d):
    srcs = {"v_dirty": lambda: _dirty(spark, d), "v_cls": lambda: V.v_cls(spark, d)}
    out = None
    for src, col, _ in _P4_CASES:
        df = srcs[src]() if src in srcs else table(spark, d, src)
        one = P.infer_problem_type(df, col).select(F.lit(src).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_P5_SQL = _DIRTY_IGN + """
SELECT p."column", CAST(p.pos AS INTEGER) AS pos,
       CASE WHEN p.numeric AND NOT i.ignorable THEN 'numerical' ELSE 'categorical' END AS type,
       p.null_count, p.dtype,
       round(CASE WHEN p.numeric AND NOT i.ignorable THEN p.min END, 6) AS min,
       round(CASE WHEN p.numeric AND NOT i.ignorable THEN p.max END, 6) AS max,
       round(CASE WHEN p.numeric AND NOT i.ignorable THEN p.mean END, 6) AS mean,
       CASE WHEN NOT (p.numeric AND NOT i.ignorable) THEN p.n_unique END AS unique_count,
       CASE WHEN i.ignorable THEN 'ignore' END AS role,
       CASE WHEN i.ignorable THEN '""" + P.IGNORE_EXPLANATION + """' END AS explanation
FROM prof p JOIN ign i ON p."column" = i."column"
WHERE p."column" <> 'sparse' AND p.null_count < p.n_rows"""


def _p5_out(df):
    return df.select("column", F.col("pos").cast("int").alias("pos"), "type", "null_count", "dtype",
                     r6("min").alias("min"), r6("max").alias("max"), r6("mean").alias("mean"),
                     "unique_count", "role", "explanation")


@register("P5_profile_features", with_views(_P5_SQL, "v_dirty"))
def q_p5(spark, d):
    return _p5_out(P.profile_features(_dirty_coerced(spark, d)))


_P6_SQL = f"""
WITH prof AS ({profile_sql('v_dirty', SPECS['v_dirty'])})
SELECT "column", CAST(pos AS INTEGER) AS pos,
       CASE WHEN "column" = 'sparse' THEN 'target'
            WHEN lower("column") IN ('id','uuid','index','key','pk','fk')
                 OR (NOT numeric AND n_unique > n_rows * 0.9) THEN 'ignore'
            ELSE 'feature' END AS role,
       CASE WHEN numeric THEN 'numerical' ELSE 'categorical' END AS type,
       CASE WHEN "column" = 'sparse' THEN '{P.RULE_TARGET_EXPLANATION}'
            WHEN lower("column") IN ('id','uuid','index','key','pk','fk')
                 OR (NOT numeric AND n_unique > n_rows * 0.9) THEN '{P.RULE_IGNORE_EXPLANATION}'
            ELSE 'Predictive feature of type ' || dtype || '.' END AS explanation
FROM prof"""


@register("P6_rule_profile", with_views(_P6_SQL, "v_dirty"))
def q_p6(spark, d):
    return P.rule_profile(_dirty(spark, d)).withColumn("pos", F.col("pos").cast("int"))


@register("P7_describe_dataset", with_views("""
SELECT 'Rule-based Profile: This dataset contains ' || count(*) || ' rows and 6 columns. '
       || 'The AutoML engine has identified it as a classification task targeting ''sparse''.'
       AS description, 'sparse' AS suggested_target, 'classification' AS suggested_problem_type
FROM v_dirty""", "v_dirty"))
def q_p7(spark, d):
    return P.describe_dataset(_dirty(spark, d))


_P8_SQL = f"""
WITH prof AS ({profile_sql('v_dirty', SPECS['v_dirty'])}),
u AS ({unpivot_text_sql('v_dirty', SPECS['v_dirty'], ['o_orderkey'])}),
r AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey) AS rn
      FROM u WHERE value IS NOT NULL),
s AS (SELECT "column", string_agg(value, '|' ORDER BY rn) AS sample_values FROM r WHERE rn <= 3
      GROUP BY "column")
SELECT p."column", CAST(p.pos AS INTEGER) AS pos, p.dtype, p.null_count,
       round_even(CAST(p.null_count AS DOUBLE) / p.n_rows * 100.0, 1) AS null_pct,
       p.n_unique AS unique_count, COALESCE(s.sample_values, '') AS sample_values
FROM prof p LEFT JOIN s ON p."column" = s."column\""""


@register("P8_column_summary", with_views(_P8_SQL, "v_dirty"))
def q_p8(spark, d):
    return P.column_summary(_dirty(spark, d), ["o_orderkey"], 3).withColumn(
        "pos", F.col("pos").cast("int"))


_ISSUES_SQL = f"""
WITH prof AS ({profile_sql('v_dirty', SPECS['v_dirty'])}),
u AS ({unpivot_text_sql('v_dirty', [(n, 'text') for n in _DIRTY_TEXT], ['o_orderkey'])}),
r AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY o_orderkey) AS rn
      FROM u WHERE value IS NOT NULL),
f AS (SELECT "column", avg(CASE WHEN {parse_sql('value')} IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE) AS ratio
      FROM r WHERE rn <= 20 GROUP BY "column"),
issues AS (
  SELECT CAST(p.pos AS INTEGER) AS pos, f."column", 'formatted_numeric' AS issue_type, 'warning' AS severity,
         'Column ''' || f."column" || ''' contains numeric values formatted as strings (e.g. currency, commas).' AS description,
         '{Q.FORMATTED_FIX}' AS recommended_fix, 0 AS issue_order
  FROM f JOIN prof p ON p."column" = f."column" WHERE f.ratio >= 0.8
  UNION ALL
  SELECT CAST(pos AS INTEGER), "column", 'high_cardinality', 'warning',
         'Column ''' || "column" || ''' has ' || n_unique || ' unique values ('
         || CAST(round_even(CAST(n_unique AS DOUBLE) / n_rows * 100.0, 0) AS BIGINT)
         || '% of rows) — likely an ID or free text.',
         '{Q.CARDINALITY_FIX.replace("'", "''")}', 1
  FROM prof WHERE NOT numeric AND n_unique > n_rows * 0.9
  UNION ALL
  SELECT CAST(pos AS INTEGER), "column", 'high_nulls', 'warning',
         'Column ''' || "column" || ''' is '
         || CAST(round_even(CAST(null_count AS DOUBLE) / n_rows * 100.0, 1) AS VARCHAR) || '% null.',
         '{Q.NULLS_FIX}', 2
  FROM prof WHERE CAST(null_count AS DOUBLE) / n_rows * 100.0 > 50)"""


@register("P9_scan_formatted_numeric", with_views(
    _ISSUES_SQL + "\nSELECT pos, \"column\", issue_type, severity, description, recommended_fix "
                  "FROM issues WHERE issue_type = 'formatted_numeric'", "v_dirty"))
def q_p9(spark, d):
    return Q.scan_formatted_numeric(_dirty(spark, d), ["o_orderkey"])


@register("P10_scan_high_cardinality", with_views(
    _ISSUES_SQL + "\nSELECT pos, \"column\", issue_type, severity, description, recommended_fix "
                  "FROM issues WHERE issue_type = 'high_cardinality'", "v_dirty"))
def q_p10(spark, d):
    return Q.scan_high_cardinality(_dirty(spark, d))


@register("P10_scan_high_cardinality_urls", with_views(f"""
WITH prof AS ({profile_sql('v_urls', SPECS['v_urls'])})
SELECT CAST(pos AS INTEGER) AS pos, "column", 'high_cardinality' AS issue_type, 'warning' AS severity,
       'Column \'\'\' || "column" || \'\'\' has ' || n_unique || ' unique values ('
       || CAST(round_even(CAST(n_unique AS DOUBLE) / n_rows * 100.0, 0) AS BIGINT)
       || '% of rows) — likely an ID or free text.' AS description,
       '{Q.CARDINALITY_FIX.replace("'", "''")}' AS recommended_fix
FROM prof WHERE NOT numeric AND n_unique > n_rows * 0.9""", "v_urls"))
def q_p10_urls(spark, d):
    return Q.scan_high_cardinality(V.v_urls(spark, d))


@register("P11_scan_high_nulls", with_views(
    _ISSUES_SQL + "\nSELECT pos, \"column\", issue_type, severity, description, recommended_fix "
                  "FROM issues WHERE issue_type = 'high_nulls'", "v_dirty"))
def q_p11(spark, d):
    return Q.scan_high_nulls(_dirty(spark, d))


@register("P12_quality_issues", with_views(
    _ISSUES_SQL + "\nSELECT pos, \"column\", issue_type, severity, description, recommended_fix, "
                  "issue_order FROM issues", "v_dirty"))
def q_p12_issues(spark, d):
    return Q.quality_issues(_dirty(spark, d), ["o_orderkey"])


@register("P12_quality_report", with_views(
    _ISSUES_SQL + """
SELECT CAST(count(*) AS BIGINT) AS issue_count,
       CAST(greatest(0, 100 - 10 * count(*)) AS BIGINT) AS overall_quality_score,
       'Found ' || count(*) || ' data quality issue(s) across 6 columns.' AS overall_summary
FROM issues""", "v_dirty"))
def q_p12(spark, d):
    return Q.quality_report(_dirty(spark, d), ["o_orderkey"])


def _enriched(spark, d):
    raw = _dirty(spark, d)
    p6 = P.rule_profile(raw)
    tgt = P.rule_target(raw.columns)
    p5 = P.profile_features(P.coerce_numeric(raw), tgt)
    return P.enrich_profile(p5, p6)


_P5_BODY = _P5_SQL.replace(_DIRTY_IGN, "").strip()
_P6_BODY = "SELECT" + _P6_SQL.rsplit("\nSELECT", 1)[1].replace("FROM prof", "FROM prof_r")
_P13_SQL = _DIRTY_IGN + f""",
p5 AS ({_P5_BODY}),
prof_r AS ({profile_sql('v_dirty', SPECS['v_dirty'])}),
p6 AS ({_P6_BODY})
SELECT p5."column", p5.pos, COALESCE(p6.type, p5.type) AS type, p5.null_count, p5.dtype,
       p5.min, p5.max, p5.mean, p5.unique_count,
       COALESCE(p6.role, 'feature') AS role,
       COALESCE(p6.explanation, '{P.DEFAULT_EXPLANATION}') AS explanation
FROM p5 LEFT JOIN p6 ON p5."column" = p6."column\""""


@register("P13_enrich_profile", with_views(_P13_SQL, "v_dirty"))
def q_p13(spark, d):
    e = _enriched(spark, d)
    return e.select("column", F.col("pos").cast("int").alias("pos"), "type", "null_count", "dtype",
                    r6("min").alias("min"), r6("max").alias("max"), r6("mean").alias("mean"),
                    "unique_count", "role", "explanation")


@register("P14_profile_totals", with_views(_P13_SQL.rsplit("SELECT p5.", 1)[0].rstrip() + """,
e AS (SELECT p5.*, COALESCE(p6.type, p5.type) AS etype FROM p5 LEFT JOIN p6 ON p5."column" = p6."column")
SELECT CAST(count_if(etype = 'numerical') AS BIGINT) AS numerical_features,
       CAST(count_if(etype = 'categorical') AS BIGINT) AS categorical_features,
       CAST(COALESCE(sum(null_count), 0) AS BIGINT) AS total_nulls,
       CAST(5 AS BIGINT) AS features
FROM e""", "v_dirty"))
def q_p14(spark, d):
    raw = _dirty(spark, d)
    return P.profile_totals(_enriched(spark, d), len(raw.columns))


# -------------------------------------------------------------------- drift
from modelkeep.operators import drift as D  # noqa: E402
from modelkeep.plans.oracle import drift_sql  # noqa: E402

_LARGE = dict(numeric=["l_quantity", "l_extendedprice", "l_discount", "l_tax"], text=["l_linestatus"],
              order=["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"])
_PARTY = dict(numeric=["nationkey", "acctbal", "positive"], text=["region", "nation"],
              order=["nationkey", "acctbal", "region", "nation", "positive"])


def _drift_with(ref, cur, spec, views, body):
    return with_views("WITH " + drift_sql(ref, cur, spec["numeric"], spec["text"],
                                          spec["order"]).strip() + "\n" + body, *views)


_LARGE_VIEWS = ("v_drift_ref", "v_drift_cur")
_PARTY_VIEWS = ("v_party_ref", "v_party_cur")
_FEATS_SQL = """SELECT feature, position, feature_type, test_name, score_kind, n_ref, n_cur, n_values,
       round(statistic, 6) AS statistic, round(p_value, 6) AS p_value,
       round(drift_score, 6) AS drift_score, drift_detected FROM feats"""


def _round_feats(df):
    return df.select("feature", "position", "feature_type", "test_name", "score_kind", "n_ref",
                     "n_cur", "n_values", r6("statistic").alias("statistic"),
                     r6("p_value").alias("p_value"), r6("drift_score").alias("drift_score"),
                     "drift_detected")


_D1_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("D1_align_features", with_views(" UNION ALL ".join(f"""
SELECT '{f}' AS feature, CAST({k} AS INTEGER) AS position, (SELECT CAST(count({f}) AS BIGINT) FROM lineitem) AS ref_values,
       (SELECT CAST(count({f}) AS BIGINT) FROM v_reg) AS cur_values""" for k, f in enumerate(_D1_FEATURES)), "v_reg"))
def q_d1(spark, d):
    """The aligned features in the reference's order, with the values each side has of them."""
    ref, cur = table(spark, d, "lineitem"), V.v_reg(spark, d)
    feats = D.align_features(ref, cur, "l_returnflag")
    sides = [df.agg(*[F.count(f).alias(f) for f in feats]).unpivot([], feats, "feature", name) for df, name in ((ref, "ref_values"), (cur, "cur_values"))]
    position = F.array_position(F.array(*[F.lit(f) for f in feats]), F.col("feature")) - 1
    return sides[0].join(sides[1], "feature").select("feature", position.cast("int").alias("position"), "ref_values", "cur_values")


_NULL_COLS = ["l_quantity", "l_tax", "l_returnflag"]


def _null_pair(spark, d):
    return V.v_nulls(spark, d).select(*_NULL_COLS), V.v_reg(spark, d).select(*_NULL_COLS)


@register("D2_harmonise_types", with_views("""
SELECT 'l_returnflag' AS feature, 'categorical' AS feature_type,
       CAST((SELECT count(*) FROM v_nulls WHERE COALESCE(l_returnflag, 'nan') = 'nan') AS BIGINT) AS ref_nan,
       CAST((SELECT count(*) FROM v_reg WHERE COALESCE(l_returnflag, 'nan') = 'nan') AS BIGINT) AS cur_nan
UNION ALL
SELECT f, 'numerical', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (VALUES ('l_quantity'), ('l_tax')) t(f)""",
    "v_nulls", "v_reg"))
def q_d2(spark, d):
    ref, cur = _null_pair(spark, d)
    r, c, numeric, text = D.harmonise_types(ref, cur, D.align_features(ref, cur))
    feats = numeric + text

    def nan_counts(df, name):
        counts = df.agg(*[(F.count_if(F.col(f) == "nan") if f in text else F.lit(0))
                          .cast("long").alias(f) for f in feats])
        return counts.unpivot([], feats, "feature", name)

    kind = F.when(F.col("feature").isin(numeric), "numerical").otherwise("categorical")
    return nan_counts(r, "ref_nan").join(nan_counts(c, "cur_nan"), "feature").select(
        "feature", kind.alias("feature_type"), "ref_nan", "cur_nan")


@register("D3_fill_from_reference", with_views("""
SELECT f AS feature, round(med, 6) AS median, ref_filled, cur_filled FROM (
  SELECT 'l_quantity' AS f, (SELECT median(l_quantity) FROM v_nulls) AS med,
         CAST((SELECT count(*) - count(l_quantity) FROM v_nulls) AS BIGINT) AS ref_filled,
         CAST((SELECT count(*) - count(l_quantity) FROM v_reg) AS BIGINT) AS cur_filled
  UNION ALL
  SELECT 'l_tax', (SELECT median(l_tax) FROM v_nulls),
         CAST((SELECT count(*) - count(l_tax) FROM v_nulls) AS BIGINT),
         CAST((SELECT count(*) - count(l_tax) FROM v_reg) AS BIGINT))""", "v_nulls", "v_reg"))
def q_d3(spark, d):
    """What the fill moved: values after it less values before it, on either side."""
    ref, cur = _null_pair(spark, d)
    r, c, numeric, text = D.harmonise_types(ref, cur, D.align_features(ref, cur))
    aligned = D.align_counts(D.value_counts(r, numeric, text), D.value_counts(c, numeric, text)).persist()
    filled = D.fill_from_reference(aligned)

    def values(df, sign):
        return df.where("num IS NOT NULL").select("feature", *[(F.lit(sign) * F.col(f"{x}_n")).alias(f"{x}_n") for x in ("ref", "cur")])
    moved = values(filled, 1).unionByName(values(aligned, -1)).groupBy("feature").agg(
        F.sum("ref_n").cast("long").alias("ref_filled"), F.sum("cur_n").cast("long").alias("cur_filled"))
    return _released(D.reference_medians(aligned).join(moved, "feature").select(
        "feature", r6("median").alias("median"), "ref_filled", "cur_filled"), aligned)


def _released(rows, *frames):
    """A result with a row per feature, computed now, and the frames behind it released."""
    found = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    for frame in frames:
        frame.unpersist()
    return found


def _pair_tests(spark, d, fx):
    ref, cur = fx(spark, d)
    _, aligned, tests = D.prepared_counts(ref, cur)
    return aligned, tests


_D4_BODY = """SELECT '{pair}' AS pair, feature, feature_type, n_ref, n_cur, n_values, test_name FROM tests2"""


@register("D4_choose_test", with_views(
    "WITH " + drift_sql("v_drift_ref", "v_drift_cur", _LARGE["numeric"], _LARGE["text"], _LARGE["order"]).strip()
    + "\n" + _D4_BODY.format(pair="large"), *_LARGE_VIEWS))
def q_d4(spark, d):
    aligned, tests = _pair_tests(spark, d, V.v_drift_large)
    return _released(tests.select(F.lit("large").alias("pair"), "feature", "feature_type", "n_ref", "n_cur",
                                  "n_values", "test_name"), aligned, tests)


@register("D4_choose_test_parties", with_views(
    "WITH " + drift_sql("v_party_ref", "v_party_cur", _PARTY["numeric"], _PARTY["text"], _PARTY["order"]).strip()
    + "\n" + _D4_BODY.format(pair="parties"), *_PARTY_VIEWS))
def q_d4_parties(spark, d):
    aligned, tests = _pair_tests(spark, d, V.v_drift_parties)
    return _released(tests.select(F.lit("parties").alias("pair"), "feature", "feature_type", "n_ref", "n_cur",
                                  "n_values", "test_name"), aligned, tests)


def _test_sql(spec, views, test, cols):
    body = (f"SELECT feature, {', '.join(f'round({c}, 6) AS {c}' if c != 'dof' else 'CAST(dof AS BIGINT) AS dof' for c in cols)} "
            f"FROM feats WHERE test_name = '{test}'")
    sql = _drift_with(views[0], views[1], spec, views, body)
    # The tests with p-values don't ask for the reference's size.
    return sql.replace("n_ref <= 1000", "TRUE") if test in (D.TEST_KS, D.TEST_CHI2, D.TEST_Z) else sql


def _test_q(fx, fn, cols):
    def q(spark, d):
        aligned, tests = _pair_tests(spark, d, fx)
        out = fn(aligned, tests)
        return _released(out.select("feature", *[r6(c).alias(c) if c != "dof" else F.col(c).cast("long")
                                                 for c in cols]), aligned, tests)
    return q


for _name, _fx, _fn, _spec, _views, _test, _cols in [
    ("D5_drift_ks", V.v_drift_parties, D.drift_ks, _PARTY, _PARTY_VIEWS, D.TEST_KS, ["statistic", "p_value"]),
    ("D6_drift_chi2", V.v_drift_parties, D.drift_chi2, _PARTY, _PARTY_VIEWS, D.TEST_CHI2,
     ["statistic", "dof", "p_value"]),
    ("D7_drift_z", V.v_drift_parties, D.drift_z, _PARTY, _PARTY_VIEWS, D.TEST_Z, ["statistic", "p_value"]),
    ("D8_drift_wasserstein", V.v_drift_large, D.drift_wasserstein, _LARGE, _LARGE_VIEWS,
     D.TEST_WASSERSTEIN, ["statistic"]),
    ("D9_drift_js", V.v_drift_large, D.drift_js, _LARGE, _LARGE_VIEWS, D.TEST_JS, ["statistic"]),
]:
    register(_name, _test_sql(_spec, _views, _test, _cols))(_test_q(_fx, _fn, _cols))


_D10_BODY = """SELECT '{pair}' AS pair, round(avg(CASE WHEN drift_detected THEN 1.0 ELSE 0.0 END), 6) AS drift_score,
       CAST(count(*) AS BIGINT) AS number_of_columns,
       CAST(count_if(drift_detected) AS BIGINT) AS number_of_drifted_columns,
       avg(CASE WHEN drift_detected THEN 1.0 ELSE 0.0 END) >= 0.3 AS has_drift,
       'Drift check complete. ' || count_if(drift_detected) || ' of ' || count(*) ||
       ' features drifted (ratio: ' || printf('%.2f', avg(CASE WHEN drift_detected THEN 1.0 ELSE 0.0 END)) || ').' AS message
FROM feats"""


def _d10_q(fx, pair):
    def q(spark, d):
        ref, cur = fx(spark, d)
        _, summary = D.drift_report(ref, cur)
        return summary.select(F.lit(pair).alias("pair"), r6("drift_score").alias("drift_score"),
                              "number_of_columns", "number_of_drifted_columns", "has_drift", "message")
    return q


register("D10_drift_score", _drift_with("v_drift_ref", "v_drift_cur", _LARGE, _LARGE_VIEWS,
                                        _D10_BODY.format(pair="large")))(_d10_q(V.v_drift_large, "large"))
register("D10_drift_score_parties", _drift_with("v_party_ref", "v_party_cur", _PARTY, _PARTY_VIEWS,
                                                _D10_BODY.format(pair="parties")))(
    _d10_q(V.v_drift_parties, "parties"))


def _d11_q(fx):
    def q(spark, d):
        ref, cur = fx(spark, d)
        feats, _ = D.drift_report(ref, cur)
        return _round_feats(feats)
    return q


register("D11_drift_report", _drift_with("v_drift_ref", "v_drift_cur", _LARGE, _LARGE_VIEWS, _FEATS_SQL))(
    _d11_q(V.v_drift_large))
register("D11_drift_report_parties", _drift_with("v_party_ref", "v_party_cur", _PARTY, _PARTY_VIEWS,
                                                 _FEATS_SQL))(_d11_q(V.v_drift_parties))

_D12_BODY = """SELECT CAST(count(*) AS BIGINT) AS features_checked,
       CAST(count_if(drift_detected) AS BIGINT) AS drifted_features,
       CAST(count(*) - count_if(drift_detected) AS BIGINT) AS stable_features,
       printf('%.1f', 100.0 * count_if(drift_detected) / count(*)) || '%' AS overall_drift
FROM feats"""


def _d12_q(fx):
    def q(spark, d):
        ref, cur = fx(spark, d)
        feats, _ = D.drift_report(ref, cur)
        return D.drift_summary(feats)
    return q


register("D12_drift_summary", _drift_with("v_drift_ref", "v_drift_cur", _LARGE, _LARGE_VIEWS, _D12_BODY))(
    _d12_q(V.v_drift_large))
register("D12_drift_summary_parties", _drift_with("v_party_ref", "v_party_cur", _PARTY, _PARTY_VIEWS,
                                                  _D12_BODY))(_d12_q(V.v_drift_parties))


# --------------------------------------------------------------- evaluation
from modelkeep.operators import evaluate as E  # noqa: E402


def _classes(df, col="label"):
    """Sorted distinct labels: bounded by the class count."""
    return [r[0] for r in df.select(F.col(col).cast("string")).distinct().orderBy(1).collect()]


def _eval_multi(spark, d):
    labels = table(spark, d, "events").select(F.col("event_type").alias("label"))
    return V.v_eval_multi(spark, d, _classes(labels))


_MULTI_SCORES = """
cls AS (SELECT DISTINCT label AS c FROM v_eval_multi),
ms AS (SELECT m.event_id, m.label, cls.c,
              CASE WHEN m.prediction = cls.c THEN 0.5 + CAST(m.event_id % 7 AS DOUBLE) / 20.0
                   ELSE CAST(m.event_id % 5 AS DOUBLE) / 20.0 END AS score
       FROM v_eval_multi m JOIN cls ON TRUE)"""


@register("E1_accuracy", with_views("""
SELECT 'cls' AS fixture, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM v_eval_cls
UNION ALL
SELECT 'multi', round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) FROM v_eval_multi""",
    "v_eval_cls", "v_eval_multi"))
def q_e1(spark, d):
    a = E.accuracy(V.v_eval_cls(spark, d)).select(F.lit("cls").alias("fixture"), r6("accuracy").alias("accuracy"))
    b = E.accuracy(_eval_multi(spark, d)).select(F.lit("multi").alias("fixture"), r6("accuracy").alias("accuracy"))
    return a.unionByName(b)


def _weighted_sql(view, fixture):
    return f"""
SELECT '{fixture}' AS fixture, round(sum(support * prec) / sum(support), 6) AS weighted_precision,
       round(sum(support * rec) / sum(support), 6) AS weighted_recall,
       round(sum(support * CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END)
             / sum(support), 6) AS weighted_f1
FROM (SELECT c, support, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS prec,
             CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS rec
      FROM (SELECT COALESCE(s.c, p.c) AS c, COALESCE(s.support, 0) AS support,
                   COALESCE(p.predicted, 0) AS predicted, COALESCE(t.tp, 0) AS tp
            FROM (SELECT label AS c, count(*) AS support FROM {view} GROUP BY label) s
            FULL OUTER JOIN (SELECT prediction AS c, count(*) AS predicted FROM {view} GROUP BY prediction) p
              ON s.c = p.c
            LEFT JOIN (SELECT label AS c, count(*) AS tp FROM {view} WHERE label = prediction GROUP BY label) t
              ON COALESCE(s.c, p.c) = t.c))"""


_WEIGHTED_SQL = with_views(_weighted_sql("v_eval_cls", "cls") + "\nUNION ALL\n"
                           + _weighted_sql("v_eval_multi", "multi"), "v_eval_cls", "v_eval_multi")


def _weighted(spark, d, cols):
    a = E.weighted_metrics(V.v_eval_cls(spark, d)).select(F.lit("cls").alias("fixture"), *[r6(c).alias(c) for c in cols])
    b = E.weighted_metrics(_eval_multi(spark, d)).select(F.lit("multi").alias("fixture"), *[r6(c).alias(c) for c in cols])
    return a.unionByName(b)


def _sel_sql(sql, cols):
    return f"SELECT fixture, {', '.join(cols)} FROM (\n{sql}\n)"


for _name, _col in [("E2_weighted_precision", "weighted_precision"), ("E3_weighted_recall", "weighted_recall"),
                    ("E4_weighted_f1", "weighted_f1")]:
    _inner = _weighted_sql("v_eval_cls", "cls") + "\nUNION ALL\n" + _weighted_sql("v_eval_multi", "multi")
    register(_name, with_views(_sel_sql(_inner, [_col]), "v_eval_cls", "v_eval_multi"))(
        (lambda col: lambda spark, d: _weighted(spark, d, [col]))(_col))


@register("E5_roc_auc_binary", with_views("""
WITH s AS (SELECT score, sum(CASE WHEN label = '1' THEN 1 ELSE 0 END) AS pos,
                  sum(CASE WHEN label = '1' THEN 0 ELSE 1 END) AS neg FROM v_eval_cls GROUP BY score),
c AS (SELECT *, COALESCE(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM s)
SELECT round(CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 0.0
                  ELSE sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) END, 6) AS roc_auc FROM c""",
    "v_eval_cls"))
def q_e5(spark, d):
    return E.roc_auc_binary(V.v_eval_cls(spark, d), "1").select(r6("roc_auc").alias("roc_auc"))


@register("E6_roc_auc_ovr", with_views("WITH " + _MULTI_SCORES.strip() + """,
s AS (SELECT c, score, sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label = c THEN 0 ELSE 1 END) AS neg FROM ms GROUP BY c, score),
w AS (SELECT *, COALESCE(sum(neg) OVER (PARTITION BY c ORDER BY score
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM s),
per AS (SELECT c, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                       THEN sum(pos * (nb + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
        FROM w GROUP BY c)
SELECT round(CASE WHEN count(auc) = count(*) THEN avg(auc) ELSE 0.0 END, 6) AS roc_auc FROM per""",
    "v_eval_multi"))
def q_e6(spark, d):
    labels = table(spark, d, "events").select(F.col("event_type").alias("label"))
    classes = _classes(labels)
    return E.roc_auc_ovr(V.v_eval_multi(spark, d, classes), classes).select(r6("roc_auc").alias("roc_auc"))


@register("E7_regression_metrics", with_views("""
SELECT round(CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(*))
                  WHEN sum((yhat - y) * (yhat - y)) = 0 THEN 1.0 ELSE 0.0 END, 6) AS r2_score,
       round(avg(abs(yhat - y)), 6) AS mae, round(avg((yhat - y) * (yhat - y)), 6) AS mse,
       round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse
FROM v_eval_reg""", "v_eval_reg"))
def q_e7(spark, d):
    m = E.regression_metrics(V.v_eval_reg(spark, d))
    return m.select(*[r6(c).alias(c) for c in m.columns])


# ----------------------------------------------------------------- registry
from modelkeep.operators import registry as R  # noqa: E402

TS_FMT = "yyyy-MM-dd HH:mm:ss"
TS_SQL = "'%Y-%m-%d %H:%M:%S'"
R3_MODEL_ID = 7
R4_SEARCH = "forest"
R12_DRIFT = 0.25


def _models(spark, d):
    return V.v_models(spark, d)


def _deps(spark, d, models=None):
    return V.v_deployments(spark, d, models)


@register("R1_next_version", with_views("""
SELECT dataset_id, CAST(count(*) + 1 AS BIGINT) AS next_version FROM v_models GROUP BY dataset_id""",
    "v_models"))
def q_r1(spark, d):
    return R.next_version(_models(spark, d))


@register("R2_list_models", with_views(f"""
SELECT CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS BIGINT) AS position, id, model_name,
       algorithm, status, version, strftime(created_at, {TS_SQL}) AS created_at
FROM v_models""", "v_models"))
def q_r2(spark, d):
    return R.list_models(_models(spark, d)).select("position", "id", "model_name", "algorithm",
                         "status", "version", F.date_format("created_at", TS_FMT).alias("created_at"))


@register("R3_model_status", with_views(f"""
SELECT id, model_name, status, algorithm, version FROM v_models WHERE id = {R3_MODEL_ID}""", "v_models"))
def q_r3(spark, d):
    return R.model_status(_models(spark, d), R3_MODEL_ID).select(
        "id", "model_name", "status", "algorithm", "version")


def _leader_sql(search):
    cond = (f"AND (lower(algorithm) LIKE '%{search}%' OR lower(model_name) LIKE '%{search}%')"
            if search else "")
    return with_views(f"""
SELECT CAST(row_number() OVER (ORDER BY COALESCE(f1_score, r2_score, 0) DESC, id ASC) AS BIGINT) AS rank,
       id, model_name, algorithm, version, round(COALESCE(f1_score, r2_score, 0), 6) AS score,
       id IN (SELECT model_id FROM v_deployments WHERE status = 'active') AS is_active
FROM v_models WHERE status = 'DONE' {cond}""", "v_models", "v_deployments")


def _leader_q(search):
    def q(spark, d):
        m = _models(spark, d)
        lb = R.leaderboard(m, _deps(spark, d, m), search)
        return lb.withColumn("score", r6("score"))
    return q


register("R4_leaderboard", _leader_sql(R4_SEARCH))(_leader_q(R4_SEARCH))
register("R4_leaderboard_all", _leader_sql(None))(_leader_q(None))


@register("R5_job_counts", with_views("""
SELECT CAST(count_if(status = 'DONE') AS BIGINT) AS done,
       CAST(count_if(status IN ('PENDING', 'TRAINING')) AS BIGINT) AS in_progress,
       CAST(count_if(status = 'FAILED') AS BIGINT) AS failed FROM v_models""", "v_models"))
def q_r5(spark, d):
    return R.job_counts(_models(spark, d))


@register("R5_jobs_not_done", with_views(f"""
SELECT id, model_name, status, strftime(created_at, {TS_SQL}) AS created_at FROM v_models WHERE status IN ('PENDING', 'TRAINING', 'FAILED')""", "v_models"))
def q_r5_jobs(spark, d):
    return R.jobs_not_done(_models(spark, d)).select("id", "model_name", "status", F.date_format("created_at", TS_FMT).alias("created_at"))


@register("R6_explode_metrics", with_views("""
SELECT id, 'F1 Score' AS metric, CAST(round(f1_score * 100) AS BIGINT) AS value
FROM v_models WHERE status = 'DONE' AND f1_score IS NOT NULL
UNION ALL
SELECT id, 'R2 Score', CAST(round(r2_score * 100) AS BIGINT)
FROM v_models WHERE status = 'DONE' AND r2_score IS NOT NULL""", "v_models"))
def q_r6(spark, d):
    return R.explode_metrics(_models(spark, d))


@register("R7_model_comparison", with_views("""
SELECT id, 'v' || version || ' ' || split_part(algorithm, ' ', 1) AS name,
       CAST(round(COALESCE(f1_score, r2_score, 0) * 100) AS BIGINT) AS score
FROM v_models WHERE status = 'DONE' ORDER BY created_at DESC, id DESC LIMIT 8""", "v_models"))
def q_r7(spark, d):
    return R.model_comparison(_models(spark, d))


_BEST_SQL = """best AS (SELECT id FROM v_models WHERE status = 'DONE'
                 ORDER BY COALESCE(f1_score, r2_score, 0) DESC, id ASC LIMIT 1)"""


def _best_model(models):
    done = models.where(F.col("status") == "DONE").select("id", R.model_score(models).alias("score"))
    return R.select_best(done, "score", "id")


@register("M7_select_best", with_views(f"""
WITH {_BEST_SQL}
SELECT m.id, round(COALESCE(m.f1_score, m.r2_score, 0), 6) AS score FROM v_models m JOIN best ON m.id = best.id""",
    "v_models"))
def q_m7(spark, d):
    return _best_model(_models(spark, d)).select("id", r6("score").alias("score"))


@register("R8_set_active", with_views(f"""
WITH {_BEST_SQL}
SELECT id, model_id, CASE WHEN model_id = (SELECT id FROM best) THEN 'active' ELSE 'inactive' END AS status,
       drift_threshold, performance_threshold FROM v_deployments
UNION ALL
SELECT (SELECT max(id) + 1 FROM v_deployments), (SELECT id FROM best), 'active', 0.3, 0.7
WHERE (SELECT id FROM best) NOT IN (SELECT model_id FROM v_deployments)""", "v_models", "v_deployments"))
def q_r8(spark, d):
    m = _models(spark, d)
    best = _best_model(m).first()["id"]
    return R.set_active(_deps(spark, d, m).drop("deployed_at"), m, best)


@register("R9_active_deployment", with_views("""
SELECT dp.id AS deployment_id, dp.model_id, dp.drift_threshold, dp.performance_threshold,
       m.dataset_id, m.version, m.algorithm, m.model_name
FROM v_deployments dp JOIN v_models m ON dp.model_id = m.id WHERE dp.status = 'active'""",
    "v_models", "v_deployments"))
def q_r9(spark, d):
    m = _models(spark, d)
    return R.active_deployment(_deps(spark, d, m), m)


@register("R10_active_for_dataset", with_views("""
SELECT m.dataset_id, dp.id AS deployment_id, dp.model_id
FROM v_deployments dp JOIN v_models m ON dp.model_id = m.id WHERE dp.status = 'active'""",
    "v_models", "v_deployments"))
def q_r10(spark, d):
    m = _models(spark, d)
    return R.active_for_dataset(_deps(spark, d, m), m)


def _newest_done(models):
    done = models.where(F.col("status") == "DONE")
    return done.groupBy("dataset_id").agg(
        F.max_by(F.struct("id", "version", "f1_score", "r2_score"), "id").alias("s")
    ).select("dataset_id", "s.*")


@register("R11_promote_if_better", with_views("""
WITH nw AS (SELECT * FROM v_models WHERE id IN (SELECT max(id) FROM v_models WHERE status = 'DONE' GROUP BY dataset_id)),
act AS (SELECT dp.id AS deployment_id, dp.model_id, m.dataset_id, m.version, m.f1_score, m.r2_score
        FROM v_deployments dp JOIN v_models m ON dp.model_id = m.id WHERE dp.status = 'active'),
j AS (SELECT nw.dataset_id, act.deployment_id, act.model_id AS active_model_id, nw.id AS new_model_id,
             nw.version AS nv, act.version AS av,
             COALESCE(CASE WHEN ds.problem_type = 'classification' THEN act.f1_score ELSE act.r2_score END, -1.0) AS am,
             COALESCE(CASE WHEN ds.problem_type = 'classification' THEN nw.f1_score ELSE nw.r2_score END, -1.0) AS nm
      FROM nw JOIN act ON nw.dataset_id = act.dataset_id JOIN v_datasets ds ON ds.id = nw.dataset_id)
SELECT dataset_id, deployment_id, active_model_id, new_model_id, round(am, 6) AS active_metric,
       round(nm, 6) AS new_metric, nm > am AS promoted,
       printf('Retrained model v%d (%.4f) ', nv, nm) || CASE WHEN nm > am THEN 'outperformed' ELSE 'did not outperform' END
       || printf(' active model v%d (%.4f). ', av, am) || CASE WHEN nm > am THEN 'Auto-promoting...' ELSE 'Promotion skipped.' END AS message
FROM j""", "v_models", "v_deployments", "v_datasets"))
def q_r11(spark, d):
    m = _models(spark, d)
    dec = R.promote_if_better(_newest_done(m), m, _deps(spark, d, m), V.v_datasets(spark, d, m))
    return dec.select("dataset_id", "deployment_id", "active_model_id", "new_model_id",
                      r6("active_metric").alias("active_metric"), r6("new_metric").alias("new_metric"),
                      "promoted", "message")


@register("R12_update_thresholds", with_views(f"""
SELECT id, model_id, status, CASE WHEN status = 'active' THEN {R12_DRIFT} ELSE drift_threshold END AS drift_threshold,
       performance_threshold FROM v_deployments""", "v_models", "v_deployments"))
def q_r12(spark, d):
    return R.update_thresholds(_deps(spark, d).drop("deployed_at"), drift=R12_DRIFT)


@register("R13_job_transitions", with_views("""
WITH ev AS (
  SELECT id AS model_id, 'PENDING' AS status, created_at AS ts, NULL AS msg, 0 AS step FROM v_models
  UNION ALL SELECT id, 'TRAINING', created_at + INTERVAL 1 HOUR, 'Training in progress...', 1 FROM v_models WHERE status IN ('TRAINING', 'DONE', 'FAILED')
  UNION ALL SELECT id, status, created_at + INTERVAL 2 HOUR,
                   CASE WHEN status = 'DONE' THEN 'Training successfully completed.' ELSE 'Model ' || id || ' failed.' END, 2
            FROM v_models WHERE status IN ('DONE', 'FAILED'))
SELECT model_id, arg_max(status, ts) AS status, last(msg ORDER BY ts) AS status_message, CAST(count(*) AS BIGINT) AS n_events FROM ev GROUP BY model_id""",
    "v_models"))
def q_r13(spark, d):
    failed = _models(spark, d).withColumn("error", F.format_string("Model %d failed.", "id"))
    return R.job_transitions(R.job_events(failed, "error"))


# ------------------------------------------------------- scoring & feedback
from modelkeep.operators import scoring as S  # noqa: E402

F1_REQUIRED = ["k", "value"]


@register("F1_check_inputs", """
SELECT event_id AS prediction_id,
       array_to_string(list_filter(['k', 'value'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS missing
FROM events""")
def q_f1(spark, d):
    out = S.check_inputs(V.v_pred_log(spark, d), F1_REQUIRED)
    return out.select("prediction_id", F.array_join("missing", ",").alias("missing"))


@register("F3_decode_labels", """
WITH cls AS (SELECT list(event_type ORDER BY event_type) AS c FROM (SELECT DISTINCT event_type FROM events))
SELECT event_id AS prediction_id, CAST(event_id % 6 AS BIGINT) AS raw_prediction,
       CASE WHEN event_id % 6 < len(cls.c) THEN cls.c[event_id % 6 + 1] ELSE CAST(event_id % 6 AS VARCHAR) END AS prediction
FROM events, cls""")
def q_f3(spark, d):
    ev = table(spark, d, "events")
    classes = _classes(ev.select(F.col("event_type").alias("label")))
    pred = ev.select(F.col("event_id").alias("prediction_id"), (F.col("event_id") % 6).alias("raw_prediction"))
    return S.decode_labels(pred, classes)


@register("F5_prediction_counts", with_views("""
SELECT deployment_id, CAST(count(*) AS BIGINT) AS prediction_count FROM v_pred_log GROUP BY deployment_id""",
    "v_pred_log"))
def q_f5(spark, d):
    return S.prediction_counts(V.v_pred_log(spark, d))


_LATEST_FB = "lf AS (SELECT prediction_id, arg_max(actual_value, received_at) AS actual FROM v_feedback GROUP BY prediction_id)"


@register("F6_attach_feedback", with_views(f"""
WITH {_LATEST_FB}
SELECT l.prediction_id, l.deployment_id, l.prediction, lf.actual
FROM v_pred_log l LEFT JOIN lf ON l.prediction_id = lf.prediction_id""", "v_pred_log", "v_feedback"))
def q_f6(spark, d):
    out = S.attach_feedback(V.v_pred_log(spark, d), V.v_feedback(spark, d))
    return out.select("prediction_id", "deployment_id", "prediction", "actual")


@register("F6_unknown_feedback", with_views(f"""
WITH {_LATEST_FB}
SELECT prediction_id, actual FROM lf WHERE prediction_id NOT IN (SELECT prediction_id FROM v_pred_log)""",
    "v_pred_log", "v_feedback"))
def q_f6u(spark, d):
    return S.unknown_feedback(V.v_pred_log(spark, d), V.v_feedback(spark, d))


_ACC_SQL = """
SELECT deployment_id, CAST(count(*) AS BIGINT) AS n_labelled, CAST(count_if({ok}) AS BIGINT) AS n_correct,
       round(avg(CASE WHEN {ok} THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM {view} WHERE actual IS NOT NULL GROUP BY deployment_id"""
_CLS_OK = "lower(prediction) = lower(actual)"
_REG_OK = """COALESCE(CASE WHEN TRY_CAST(actual AS DOUBLE) <> 0
     THEN abs(TRY_CAST(prediction AS DOUBLE) - TRY_CAST(actual AS DOUBLE)) / abs(TRY_CAST(actual AS DOUBLE)) < 0.15
     ELSE abs(TRY_CAST(prediction AS DOUBLE)) < 0.15 END, FALSE)"""


def _acc_out(df):
    return df.select("deployment_id", "n_labelled", "n_correct", r6("accuracy").alias("accuracy"))


@register("F7_accuracy_classification", with_views(_ACC_SQL.format(ok=_CLS_OK, view="v_pred_log"), "v_pred_log"))
def q_f7(spark, d):
    return _acc_out(S.accuracy_classification(V.v_pred_log(spark, d)))


@register("F8_accuracy_tolerance", with_views(_ACC_SQL.format(ok=_REG_OK, view="v_pred_reg"), "v_pred_reg"))
def q_f8(spark, d):
    return _acc_out(S.accuracy_tolerance(V.v_pred_reg(spark, d)))


_F9_SQL = f"""
acc AS ({_ACC_SQL.format(ok=_CLS_OK, view="v_pred_log")}),
chk AS (SELECT a.deployment_id, a.n_labelled, a.accuracy, dp.performance_threshold,
               a.accuracy < dp.performance_threshold AS alarm
        FROM acc a JOIN v_deployments dp ON a.deployment_id = dp.id WHERE a.n_labelled >= 5)"""


@register("F9_performance_check", with_views("WITH " + _F9_SQL.strip() + """
SELECT *, CASE WHEN alarm THEN printf('Model performance dropped to %.2f (threshold: %.2f). Triggering automatic retraining.',
                                      accuracy, performance_threshold) END AS message FROM chk""",
                                             "v_pred_log", "v_models", "v_deployments"))
def q_f9(spark, d):
    out = S.performance_check(V.v_pred_log(spark, d), _deps(spark, d))
    return out.select("deployment_id", "n_labelled", r6("accuracy").alias("accuracy"),
                      "performance_threshold", "alarm", "message")


@register("F10_retrain_requests", with_views("WITH " + _F9_SQL.strip() + """
SELECT m.dataset_id, replace(ds.name, '.csv', '') || '_autoretrain_v' || (m.version + 1) AS model_name,
       m.algorithm, CAST(m.version + 1 AS BIGINT) AS version, 'PENDING' AS status,
       'Performance drop auto-trigger retraining.' AS status_message
FROM chk JOIN v_deployments dp ON chk.deployment_id = dp.id JOIN v_models m ON dp.model_id = m.id
JOIN v_datasets ds ON ds.id = m.dataset_id WHERE chk.alarm""", "v_pred_log", "v_models", "v_deployments",
    "v_datasets"))
def q_f10(spark, d):
    m = _models(spark, d)
    deps = _deps(spark, d, m)
    alarms = S.performance_check(V.v_pred_log(spark, d), deps).where("alarm")
    return S.retrain_requests(alarms, m, deps, V.v_datasets(spark, d, m), "performance")


# -------------------------------------------------------------------- audit
from modelkeep.operators import audit as A  # noqa: E402


def _events_out(df):
    return df.select("id", "event_type", "message", "severity",
                     F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


_EV_COLS = "id, event_type, message, severity, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at"


@register("A2_list_events", with_views(f"""
SELECT {_EV_COLS} FROM v_audit WHERE event_type = 'DRIFT'
ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10""", "v_audit"))
def q_a2(spark, d):
    return _events_out(A.list_events(V.v_audit(spark, d), "DRIFT", None, 50, 10))


@register("A2_list_events_warning", with_views(f"""
SELECT {_EV_COLS} FROM v_audit WHERE severity = 'WARNING'
ORDER BY created_at DESC, id DESC LIMIT 200""", "v_audit"))
def q_a2w(spark, d):
    return _events_out(A.list_events(V.v_audit(spark, d), None, "WARNING", 200, 0))


@register("A3_severity_counts", with_views("""
SELECT CAST(count_if(severity = 'INFO') AS BIGINT) AS info, CAST(count_if(severity = 'WARNING') AS BIGINT) AS warning,
       CAST(count_if(severity = 'ERROR') AS BIGINT) AS error
FROM (SELECT * FROM v_audit ORDER BY created_at DESC, id DESC LIMIT 200)""", "v_audit"))
def q_a3(spark, d):
    return A.severity_counts(A.list_events(V.v_audit(spark, d), None, None, 200, 0))


# ------------------------------------------------------------------ sources
from modelkeep.sources import tables as TB  # noqa: E402


@register("S2_scan_table", "SELECT * FROM supplier")
def q_s2(spark, d):
    return TB.scan_table(spark, f"{d}/supplier.parquet")


@register("S3_dataset_shape", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS row_count, "
    f"CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS BIGINT) AS column_count "
    f"FROM {t}" for t in TB.TABLES))
def q_s3(spark, d):
    out = None
    for t in TB.TABLES:
        one = TB.dataset_shape(table(spark, d, t)).select(F.lit(t).alias("table_name"), "row_count", "column_count")
        out = one if out is None else out.unionByName(one)
    return out


@register("S4_preview", with_views("""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, COALESCE(price_txt, '') AS price_txt,
       COALESCE(o_orderstatus, '') AS o_orderstatus, COALESCE(o_orderpriority, '') AS o_orderpriority,
       COALESCE(mixed, '') AS mixed, COALESCE(sparse, '') AS sparse
FROM (SELECT * FROM v_dirty ORDER BY o_orderkey LIMIT 10)""", "v_dirty"))
def q_s4(spark, d):
    return TB.preview(V.v_dirty(spark, d), ["o_orderkey"], 10)


@register("S5_scan_inputs_json", """
SELECT event_id AS prediction_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_s5(spark, d):
    return TB.scan_inputs_json(V.v_pred_log(spark, d), keep=["prediction_id"])


@register("S8_list_datasets", with_views(f"""
SELECT CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) AS BIGINT) AS position, id, name,
       problem_type, strftime(created_at, {TS_SQL}) AS created_at FROM v_datasets""", "v_models", "v_datasets"))
def q_s8(spark, d):
    return TB.list_datasets(V.v_datasets(spark, d)).select("position", "id", "name", "problem_type",
                         F.date_format("created_at", TS_FMT).alias("created_at"))


# -------------------------------------------------------------- preparation
from modelkeep.operators import prep as T  # noqa: E402

_SPLIT_SQL = "(CAST(('0x' || substr(md5('42:' || {k}), 1, 8)) AS BIGINT) % 100)"


def _test_flag_sql(k):
    return f"{_SPLIT_SQL.format(k=k)} < 20"


@register("T1_select_features", with_views("SELECT l_quantity, l_discount, l_tax, l_returnflag FROM v_reg", "v_reg"))
def q_t1(spark, d):
    from modelkeep.plans.lifecycle import profile_dataset
    df = V.v_reg(spark, d)
    dp = profile_dataset(df, "l_extendedprice")
    return T.select_features(df, dp.numerical, dp.categorical)


@register("T2_drop_null_target", with_views("SELECT k, l_quantity FROM v_nulls WHERE l_quantity IS NOT NULL",
                                            "v_nulls"))
def q_t2(spark, d):
    return T.drop_null_target(V.v_nulls(spark, d), "l_quantity").select("k", "l_quantity")


@register("T3_split_train_test", with_views(f"SELECT k, {_test_flag_sql('k')} AS is_test FROM v_reg", "v_reg"))
def q_t3(spark, d):
    train, test = T.split_train_test(V.v_reg(spark, d), "k")
    return train.select("k", F.lit(False).alias("is_test")).unionByName(test.select("k", F.lit(True).alias("is_test")))


@register("T4_encode_labels", with_views(f"""
SELECT 'cls' AS fixture, label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT CAST(quality AS VARCHAR) AS label FROM v_cls WHERE NOT {_test_flag_sql('CAST(doc_id AS VARCHAR)')})
UNION ALL
SELECT 'events', label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER)
FROM (SELECT DISTINCT event_type AS label FROM events WHERE NOT {_test_flag_sql('CAST(event_id AS VARCHAR)')})""",
    "v_cls"))
def q_t4(spark, d):
    cls_train, _ = T.split_train_test(V.v_cls(spark, d), "doc_id")
    ev_train, _ = T.split_train_test(table(spark, d, "events"), "event_id")
    a = T.encode_labels(cls_train, "quality").select(F.lit("cls").alias("fixture"), "label", "idx")
    b = T.encode_labels(ev_train, "event_type").select(F.lit("events").alias("fixture"), "label", "idx")
    return a.unionByName(b)


@register("T5_filter_seen_classes", f"""
SELECT event_id, event_type FROM events
WHERE {_test_flag_sql('CAST(event_id AS VARCHAR)')}
  AND event_type IN (SELECT event_type FROM events WHERE NOT {_test_flag_sql('CAST(event_id AS VARCHAR)')})""")
def q_t5(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type")
    train, test = T.split_train_test(ev, "event_id")
    return T.filter_seen_classes(test, T.encode_labels(train, "event_type"), train, "event_type")


_NULLS_TRAIN = f"NOT {_test_flag_sql('k')}"


@register("T6_impute_median", with_views(f"""
SELECT k, round(COALESCE(l_quantity, (SELECT median(l_quantity) FROM v_nulls WHERE {_NULLS_TRAIN})), 6) AS l_quantity
FROM v_nulls""", "v_nulls"))
def q_t6(spark, d):
    df = V.v_nulls(spark, d)
    train, _ = T.split_train_test(df, "k")
    model = T.MedianImputer(inputCols=["l_quantity"]).fit(train)
    return model.transform(df).select("k", r6("l_quantity").alias("l_quantity"))


@register("T7_impute_mode", with_views(f"""
WITH m AS (SELECT l_returnflag FROM v_nulls WHERE {_NULLS_TRAIN} AND l_returnflag IS NOT NULL
           GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag ASC LIMIT 1)
SELECT k, COALESCE(l_returnflag, (SELECT l_returnflag FROM m)) AS l_returnflag FROM v_nulls""", "v_nulls"))
def q_t7(spark, d):
    df = V.v_nulls(spark, d)
    train, _ = T.split_train_test(df, "k")
    model = T.ModeImputer(inputCols=["l_returnflag"]).fit(train)
    return model.transform(df).select("k", "l_returnflag")


_SCALE_COLS = ["l_quantity", "l_discount", "l_tax"]


@register("T8_scale_standard", with_views(f"""
WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _SCALE_COLS)}
           FROM v_reg WHERE NOT {_test_flag_sql('k')})
SELECT k, {', '.join(f'round(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6) AS {c}' for c in _SCALE_COLS)}
FROM v_reg, s""", "v_reg"))
def q_t8(spark, d):
    df = V.v_reg(spark, d)
    train, _ = T.split_train_test(df, "k")
    model = T.PopulationScaler(inputCols=_SCALE_COLS).fit(train)
    return model.transform(df).select("k", *[r6(c).alias(c) for c in _SCALE_COLS])


_ONEHOT_COLS = ["o_orderstatus", "o_orderpriority", "mixed"]


@register("T9_encode_onehot", with_views(f"""
WITH tr AS (SELECT * FROM v_dirty WHERE NOT {_test_flag_sql('CAST(o_orderkey AS VARCHAR)')}),
vc AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c} AS category, count(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY {c}" for c in _ONEHOT_COLS)}),
r AS (SELECT *, count(*) OVER (PARTITION BY col) AS n_cats,
             row_number() OVER (PARTITION BY col ORDER BY n DESC, category DESC) AS fr FROM vc),
f AS (SELECT *, (n_cats <= 50 OR fr <= 49) AS frequent FROM r),
s AS (SELECT *, CASE WHEN frequent THEN row_number() OVER (PARTITION BY col, frequent ORDER BY category) - 1
                     ELSE count_if(frequent) OVER (PARTITION BY col) END AS slot FROM f)
SELECT col AS "column", category, CAST(n AS BIGINT) AS n, frequent, CAST(slot AS INTEGER) AS slot FROM s""",
    "v_dirty"))
def q_t9(spark, d):
    df = V.v_dirty(spark, d)
    train, _ = T.split_train_test(df, "o_orderkey")
    return T.capped_categories(train, _ONEHOT_COLS)


@register("T11_union_feedback", with_views("""
SELECT CAST(event_id AS BIGINT) AS id, value, event_type AS target, CAST(NULL AS BIGINT) AS k FROM events
UNION ALL
SELECT NULL, NULL, actual, CAST(json_extract(input_json, '$.k') AS BIGINT) FROM v_pred_log WHERE actual IS NOT NULL""",
    "v_pred_log"))
def q_t11(spark, d):
    from modelkeep.plans.lifecycle import feedback_rows
    base = table(spark, d, "events").select(F.col("event_id").alias("id"), "value",
                                            F.col("event_type").alias("target"),
                                            F.lit(None).cast("bigint").alias("k"))
    fb = feedback_rows(V.v_pred_log(spark, d), "target").drop("prediction_id")
    return T.union_feedback(base, fb, "target")


@register("T12_class_counts", with_views(f"""
SELECT 'cls' AS fixture, CAST(count(*) AS BIGINT) AS n_classes, CAST(min(n) AS BIGINT) AS min_class_count,
       CAST(CASE WHEN count(*) > 30 THEN 0 ELSE least(3, min(n)) END AS BIGINT) AS folds
FROM (SELECT quality, count(*) AS n FROM v_cls WHERE NOT {_test_flag_sql('CAST(doc_id AS VARCHAR)')} GROUP BY quality)
UNION ALL
SELECT 'reg', NULL, NULL, CAST(least(3, count(*)) AS BIGINT) FROM v_reg WHERE NOT {_test_flag_sql('k')}""",
    "v_cls", "v_reg"))
def q_t12(spark, d):
    cls_train, _ = T.split_train_test(V.v_cls(spark, d), "doc_id")
    reg_train, _ = T.split_train_test(V.v_reg(spark, d), "k")
    a = T.cv_folds(cls_train, "quality", "classification").select(F.lit("cls").alias("fixture"), "*")
    b = T.cv_folds(reg_train, "l_extendedprice", "regression").select(F.lit("reg").alias("fixture"), "*")
    return a.unionByName(b)


# ------------------------------------------------------------ model fitting
from modelkeep.operators import train as M  # noqa: E402
from modelkeep.plans import lifecycle as L  # noqa: E402


def _cls_setup(spark, d):
    df = V.v_cls(spark, d)
    dp = L.profile_dataset(df, "quality")
    return df, dp


def _reg_setup(spark, d):
    df = V.v_reg(spark, d)
    dp = L.profile_dataset(df, "l_extendedprice")
    return df, dp


def _assembled(df, dp, key, classes=None):
    """Feature pipeline fitted on the training split; (train, test) frames
    with ``features`` and ``label``."""
    train, test = T.split_written(df.where(F.col(dp.target).isNotNull()), key)
    if dp.problem_type == "classification" and classes is None:
        classes = [r["label"] for r in T.encode_labels(train, dp.target).orderBy("idx").collect()]
    # the key may be a feature, which the preparation replaces
    lab = lambda x: x.withColumns({"label": M.label_column(x, dp.target, classes), "__row": F.col(key)}).where(F.col("label").isNotNull())
    prep = T.feature_pipeline(dp.numerical, dp.categorical).fit(lab(train))
    return prep.transform(lab(train)), prep.transform(lab(test)), classes


def _predictions(scored, key, label="label"):
    """Key, label and prediction of every scored row."""
    return scored.select(F.col(key), F.round(label, 2).alias("label"), "prediction")


def _held_out(model, train, test, problem="regression"):
    """One row: held-out rows, the model's loss on them (squared errors, or wrong
    classes) and that of the best constant of the training rows."""
    scored = model.transform(test).select("label", "prediction")
    if problem == "regression":
        constant = train.agg(F.avg("label")).first()[0]
        loss = lambda c: F.sum(F.pow(F.col("label") - c, 2))
    else:
        common = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()
        constant = common and common["label"]
        loss = lambda c: F.count_if(F.col("label") != c).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n"), loss(F.col("prediction")).alias("model_loss"), loss(F.lit(constant)).alias("constant_loss"))


def _sound(model, train, test, key, problem="regression"):
    """Key and label of every held-out row, and whether the model does what any
    fitted one must: smaller errors on its training rows than the constant's,
    or only known classes.  What it does on held-out rows says ``_held_out``."""
    if problem == "regression":
        row = _held_out(model, train, train).first()
        sound = row["model_loss"] is not None and row["model_loss"] < row["constant_loss"]
    else:
        known = test.select("label").distinct().withColumnRenamed("label", "prediction")
        sound = model.transform(test).join(known, "prediction", "left_anti").isEmpty()
    return test.select(F.col("__row").alias(key), F.round("label", 2).alias("label"), F.lit(sound).alias("sound"))


_REG_ROWS = "SELECT k, round(l_extendedprice, 2) AS label, TRUE AS sound FROM v_reg"
_CLS_ROWS = ("SELECT l.doc_id, CAST(quality AS DOUBLE) AS label, TRUE AS sound FROM labels l JOIN documents d USING (doc_id) "
             "WHERE quality IS NOT NULL")


@register("T10_assemble_features")
def q_t10(spark, d):
    df, dp = _reg_setup(spark, d)
    train, test, _ = _assembled(df, dp, "k")
    from pyspark.ml.functions import vector_to_array
    return train.unionByName(test).select("k", vector_to_array("features").alias("features"))


@register("T10_assembled_cells", with_views(f"""
WITH tr AS (SELECT * FROM v_reg WHERE NOT {_test_flag_sql('k')}),
s AS (SELECT avg(l_quantity) AS m0, stddev_pop(l_quantity) AS s0, avg(l_discount) AS m1, stddev_pop(l_discount) AS s1,
             avg(l_tax) AS m2, stddev_pop(l_tax) AS s2 FROM tr),
c AS (SELECT l_returnflag, 2 + row_number() OVER (ORDER BY l_returnflag) AS slot FROM (SELECT DISTINCT l_returnflag FROM tr)),
cells AS (SELECT k, 0 AS slot, (l_quantity - m0) / s0 AS value FROM v_reg, s UNION ALL SELECT k, 1, (l_discount - m1) / s1 FROM v_reg, s
          UNION ALL SELECT k, 2, (l_tax - m2) / s2 FROM v_reg, s UNION ALL SELECT k, slot, 1.0 FROM v_reg JOIN c USING (l_returnflag))
SELECT k, CAST(slot AS INTEGER) AS slot, round(value, 6) AS value FROM cells WHERE round(value, 6) <> 0""", "v_reg"))
def q_t10_cells(spark, d):
    from pyspark.ml.functions import vector_to_array
    df, dp = _reg_setup(spark, d)
    train, test, _ = _assembled(df, dp, "k")
    cells = train.unionByName(test).select("k", F.posexplode(vector_to_array("features")).alias("slot", "v"))
    return cells.select("k", "slot", r6("v").alias("value")).where("value <> 0")


def _fitted_m1(spark, d):
    df, dp = _cls_setup(spark, d)
    train, test, _ = _assembled(df, dp, "doc_id")
    return M.fit_logistic(train), train, test


@register("M1_fit_logistic")
def q_m1(spark, d):
    model, _, test = _fitted_m1(spark, d)
    return _predictions(model.transform(test).withColumn("doc_id", F.col("__row")), "doc_id")


@register("M1_sound", f"{_CLS_ROWS} AND {_test_flag_sql('CAST(l.doc_id AS VARCHAR)')}")
def q_m1_sound(spark, d):
    return _sound(*_fitted_m1(spark, d), "doc_id", "classification")


@register("M1_held_out")
def q_m1_held_out(spark, d):
    return _held_out(*_fitted_m1(spark, d), "classification")


@register("M2_fit_linear", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def q_m2(spark, d):
    from pyspark.ml.feature import VectorAssembler
    li = table(spark, d, "lineitem").select(F.col("l_quantity"), F.col("l_extendedprice").alias("label"))
    x = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li)
    model = M.fit_linear(x)
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))],
                                 "slope double, intercept double").select(
        F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _fitted_m3(spark, d):
    df, dp = _reg_setup(spark, d)
    train, test, _ = _assembled(df, dp, "k")
    return M.fit_forest(train, "regression", {"numTrees": 50, "maxDepth": 5, "minSplit": 2}), train, test


@register("M3_fit_forest")
def q_m3(spark, d):
    model, _, test = _fitted_m3(spark, d)
    return _predictions(model.transform(test).withColumn("k", F.col("__row")), "k")


@register("M3_sound", with_views(f"{_REG_ROWS} WHERE {_test_flag_sql('k')}", "v_reg"))
def q_m3_sound(spark, d):
    return _sound(*_fitted_m3(spark, d), "k")


@register("M3_held_out")
def q_m3_held_out(spark, d):
    return _held_out(*_fitted_m3(spark, d))


def _fitted_m4(spark, d):
    df, dp = _reg_setup(spark, d)
    train, test, _ = _assembled(df, dp, "k")
    return M.fit_boosted_level(train, "regression", {"rounds": 50, "maxDepth": 3, "learningRate": 0.1}), train, test


@register("M4_fit_boosted_level")
def q_m4(spark, d):
    model, _, test = _fitted_m4(spark, d)
    return _predictions(model.transform(test).withColumn("k", F.col("__row")), "k")


@register("M4_sound", with_views(f"{_REG_ROWS} WHERE {_test_flag_sql('k')}", "v_reg"))
def q_m4_sound(spark, d):
    return _sound(*_fitted_m4(spark, d), "k")


@register("M4_held_out")
def q_m4_held_out(spark, d):
    return _held_out(*_fitted_m4(spark, d))


def _fitted_m5(spark, d):
    df, dp = _cls_setup(spark, d)
    train, test, classes = _assembled(df, dp, "doc_id")
    return M.fit_boosted_leaf(train, "classification", {}, len(classes)), train, test


@register("M5_fit_boosted_leaf")
def q_m5(spark, d):
    model, _, test = _fitted_m5(spark, d)
    return _predictions(model.transform(test).withColumn("doc_id", F.col("__row")), "doc_id")


@register("M5_sound", f"{_CLS_ROWS} AND {_test_flag_sql('CAST(l.doc_id AS VARCHAR)')}")
def q_m5_sound(spark, d):
    return _sound(*_fitted_m5(spark, d), "doc_id", "classification")


@register("M5_held_out")
def q_m5_held_out(spark, d):
    return _held_out(*_fitted_m5(spark, d), "classification")


@register("M6_random_search")
def q_m6(spark, d):
    df, dp = _cls_setup(spark, d)
    train, _ = T.split_train_test(df, "doc_id")
    classes = [r["label"] for r in T.encode_labels(train, "quality").orderBy("idx").collect()]
    folds = int(T.cv_folds(train, "quality", "classification").first()["folds"])
    labelled = train.withColumn("label", M.label_column(train, "quality", classes))
    tl = M.with_folds(labelled, "doc_id", max(folds, 2), labelled.count(), "label")
    prepared = M.prepare_folds(tl, dp.numerical, dp.categorical, folds)
    r = M.random_search("Logistic Regression", "logistic", "classification", prepared, len(classes))
    prepared.unpersist()
    return spark.createDataFrame([(r.name, str(r.setting), r.cv_metric)],
                                 "algorithm string, setting string, cv_metric double")


def _refit(spark, d, split):
    """The model refit on every labelled row, or on the training rows of the split; those rows and the held-out ones."""
    df, dp = _cls_setup(spark, d)
    best = M.SearchResult("Logistic Regression", "logistic", {"C": 1.0}, None, None)
    classes = [r["label"] for r in T.encode_labels(df, "quality").orderBy("idx").collect()]
    lab = df.withColumns({"label": M.label_column(df, "quality", classes), "__row": F.col("doc_id")}).where(F.col("label").isNotNull())
    train, test = T.split_train_test(lab, "doc_id") if split else (lab, lab)
    return M.refit_full(best, train, "classification", dp.numerical, dp.categorical, len(classes)), train, test, lab


@register("M8_refit_full")
def q_m8(spark, d):
    model, _, _, lab = _refit(spark, d, split=False)
    return _predictions(model.transform(lab).withColumn("doc_id", F.col("__row")), "doc_id")


@register("M8_sound", _CLS_ROWS)
def q_m8_sound(spark, d):
    model, train, test, _ = _refit(spark, d, split=False)
    return _sound(model, train, test, "doc_id", "classification")


@register("M8_held_out")
def q_m8_held_out(spark, d):
    """The same refit, with a fifth of the rows held out."""
    model, train, test, _ = _refit(spark, d, split=True)
    return _held_out(model, train, test, "classification")


@register("M6_fold_sizes", f"""
WITH c AS (SELECT CAST(quality AS DOUBLE) AS label, count(*) AS n FROM labels l JOIN documents d USING (doc_id)
           WHERE quality IS NOT NULL AND NOT {_test_flag_sql('CAST(l.doc_id AS VARCHAR)')} GROUP BY quality),
f AS (SELECT least(3, min(n)) AS folds FROM c)
SELECT label, CAST(i % folds AS INTEGER) AS fold, count(*) AS n
FROM c, f, LATERAL (SELECT unnest(generate_series(1, n)) AS i) GROUP BY label, i % folds""")
def q_m6_folds(spark, d):
    df, _ = _cls_setup(spark, d)
    train, _ = T.split_train_test(df, "doc_id")
    classes = [r["label"] for r in T.encode_labels(train, "quality").orderBy("idx").collect()]
    folds = int(T.cv_folds(train, "quality", "classification").first()["folds"])
    labelled = train.withColumn("label", M.label_column(train, "quality", classes))
    return M.with_folds(labelled, "doc_id", folds, labelled.count(), "label").groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def _auto_train_cls(spark, d):
    df, dp = _cls_setup(spark, d)
    return M.auto_train(df, dp.target, dp.problem_type, dp.numerical, dp.categorical, "doc_id")


@register("M9_auto_train")
def q_m9(spark, d):
    return _auto_train_cls(spark, d).results_frame(spark)


@register("M10_train_custom_estimator")
def q_m10(spark, d):
    from pyspark.ml.classification import LogisticRegression
    df, dp = _cls_setup(spark, d)
    _, metrics, _ = M.train_custom_estimator(LogisticRegression(maxIter=100), df, dp.target,
                                             dp.problem_type, dp.numerical, dp.categorical, "doc_id")
    return spark.createDataFrame([tuple(float(metrics[k]) for k in sorted(metrics))],
                                 ", ".join(f"{k} double" for k in sorted(metrics)))


def _linear_batch(spark, d):
    df, dp = _reg_setup(spark, d)
    model, _, _ = M.train_custom_estimator(M.make_estimator("linear", "regression", {}, 0), df, dp.target,
                                           dp.problem_type, dp.numerical, dp.categorical, "k")
    return L.score_batch(model, df, None)


@register("F2_score_batch")
def q_f2(spark, d):
    return _predictions(_linear_batch(spark, d), "k", "l_extendedprice")


@register("F2_sound", with_views(_REG_ROWS, "v_reg"))
def q_f2_sound(spark, d):
    scored = _linear_batch(spark, d).select("k", F.col("l_extendedprice").alias("label"), "prediction")
    error, spread_ = scored.agg(F.sum(F.pow(F.col("label") - F.col("prediction"), 2)), F.var_pop("label") * F.count("label")).first()
    return scored.select("k", F.round("label", 2).alias("label"), F.lit(error < spread_).alias("sound"))


@register("F2_held_out")
def q_f2_held_out(spark, d):
    df, dp = _reg_setup(spark, d)
    train, test, _ = _assembled(df, dp, "k")
    return _held_out(M.make_estimator("linear", "regression", {}, 0).fit(train), train, test)


# Fits whose every prediction has a closed form in SQL: least squares on one
# column, group means of a tree that can tell all groups apart, class shares of
# groups for a logistic model without a penalty.
_LINE_SQL = """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM v_reg)
SELECT k, round(slope * l_quantity + intercept, 2) AS prediction FROM v_reg, s"""
_GROUP_MEANS_SQL = "SELECT k, round(avg(l_extendedprice) OVER (PARTITION BY l_returnflag), 2) AS prediction FROM v_reg"


def _line_data(spark, d):
    return V.v_reg(spark, d).select("k", "l_quantity", "l_extendedprice")


def _rounded(scored, key="k"):
    return scored.select(key, F.round("prediction", 2).alias("prediction"))


def _flag_frame(spark, d):
    """One feature, the place of the row's return flag; label is the price."""
    from pyspark.ml.feature import VectorAssembler
    place = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag"))
    rows = V.v_reg(spark, d).select("k", place.cast("double").alias("flag"), F.col("l_extendedprice").alias("label"))
    return VectorAssembler(inputCols=["flag"], outputCol="features").transform(rows)


@register("M3_group_means", with_views(_GROUP_MEANS_SQL, "v_reg"))
def q_m3_means(spark, d):
    """A forest whose trees see all rows: every tree is the groups' means."""
    rows = _flag_frame(spark, d)
    forest = M.make_estimator("forest", "regression", {"numTrees": 3, "maxDepth": 2}, 0).setBootstrap(False)
    return _rounded(M.fitted(forest, rows).transform(rows))


@register("M4_group_means", with_views(_GROUP_MEANS_SQL, "v_reg"))
def q_m4_means(spark, d):
    """The first tree is the groups' means; later rounds find nothing left."""
    rows = _flag_frame(spark, d)
    return _rounded(M.fit_boosted_level(rows, "regression", {"rounds": 3, "maxDepth": 2, "learningRate": 0.1}).transform(rows))


@register("M5_group_means", with_views(_GROUP_MEANS_SQL, "v_reg"))
def q_m5_means(spark, d):
    rows = _flag_frame(spark, d)
    boosted = M.make_estimator("boosted_leaf", "regression", {"rounds": 3, "maxDepth": -1}, 0).setSubsamplingRate(1.0)
    return _rounded(M.fitted(boosted, rows).transform(rows))


@register("M6_group_means", with_views(f"""
WITH r AS (SELECT k, floor(l_quantity / 13) AS g, l_extendedprice AS y, {_SPLIT_SQL.format(k='k')} % 3 AS fold FROM v_reg),
f AS (SELECT DISTINCT fold AS held FROM r),
a AS (SELECT held, avg(y) AS overall FROM r JOIN f ON fold <> held GROUP BY held),
b AS (SELECT held, g AS of_g, avg(y) AS mean FROM r JOIN f ON fold <> held GROUP BY held, g),
s AS (SELECT a.held, 1 - sum((y - overall) ** 2) / (var_pop(y) * count(*)) AS flat, 1 - sum((y - mean) ** 2) / (var_pop(y) * count(*)) AS deep
      FROM r JOIN a ON r.fold = a.held JOIN b ON r.fold = b.held AND g = of_g GROUP BY a.held),
c AS (SELECT avg(flat) AS flat, avg(deep) AS deep FROM s)
SELECT k, round(CASE WHEN deep > flat THEN avg(y) OVER (PARTITION BY g) ELSE avg(y) OVER () END, 2) AS prediction,
       CASE WHEN deep > flat THEN 3 ELSE 0 END AS depth, round(greatest(deep, flat), 6) AS cv_metric FROM r, c""", "v_reg"))
def q_m6_means(spark, d):
    """A search whose scores have a closed form: trees without a split are the
    mean of the other folds, those of depth 3 the means of four groups; the
    better setting is refitted to all rows."""
    rows = V.v_reg(spark, d).select("k", F.floor(F.col("l_quantity") / 13).cast("double").alias("band"), F.col("l_extendedprice").alias("label"),
                                    F.pmod(T.split_bucket(F.col("k")), F.lit(3)).alias("fold"))
    prepared = M.prepare_folds(rows, ["band"], [], 3)
    found = M.random_search("Boosted Trees", "boosted_level", "regression", prepared, 0, {"rounds": [1], "maxDepth": [0, 3]})
    prepared.unpersist()
    return _rounded(found.model.transform(rows)).withColumns({"depth": F.lit(int(found.setting["maxDepth"])), "cv_metric": F.round(F.lit(found.cv_metric), 6)})


@register("M1_class_shares", """
SELECT l.doc_id, round(avg(CAST(quality AS DOUBLE)) OVER (PARTITION BY lang), 3) AS probability
FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL AND lang IS NOT NULL""")
def q_m1_shares(spark, d):
    """Indicators of all groups and no penalty: the likelihood's maximum is the groups' class shares."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    rows = table(spark, d, "labels").where("quality IS NOT NULL").join(table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id")
    langs = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    named = [f"is_{i}" for i in range(1, len(langs))]
    rows = rows.select("doc_id", F.col("quality").cast("double").alias("label"), *[(F.col("lang") == x).cast("double").alias(c) for x, c in zip(langs[1:], named)])
    rows = VectorAssembler(inputCols=named, outputCol="features").transform(rows)
    scored = M.fit_logistic(rows, {"C": 1e9}).transform(rows)
    return scored.select("doc_id", F.round(vector_to_array("probability")[1], 3).alias("probability"))


@register("M8_least_squares", with_views(_LINE_SQL, "v_reg"))
def q_m8_line(spark, d):
    rows = _line_data(spark, d).withColumn("label", F.col("l_extendedprice"))
    best = M.SearchResult("Linear Regression", "linear", {}, None, None)
    return _rounded(M.refit_full(best, rows, "regression", ["l_quantity"], [], 0).transform(rows))


def _line_model(spark, d):
    return M.train_custom_estimator(M.make_estimator("linear", "regression", {}, 0), _line_data(spark, d), "l_extendedprice", "regression", ["l_quantity"], [], "k")


@register("F2_least_squares", with_views(_LINE_SQL, "v_reg"))
def q_f2_line(spark, d):
    return _rounded(L.score_batch(_line_model(spark, d)[0], _line_data(spark, d), None))


@register("S7_save_load", with_views(_LINE_SQL.replace("round(slope", "'line' AS name, round(slope"), "v_reg"))
def q_s7(spark, d):
    """Predictions and metadata of a model that was saved and loaded again."""
    from modelkeep.session import scratch_path
    folder = TB.save_model(_line_model(spark, d)[0], {"name": "line"}, scratch_path(spark, "model"))
    model, meta = TB.load_model(spark, folder)
    return _rounded(L.score_batch(model, _line_data(spark, d), None)).withColumn("name", F.lit(meta["name"]))


@register("M10_least_squares", with_views(f"""
WITH r AS (SELECT *, {_test_flag_sql('k')} AS test FROM v_reg),
s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM r WHERE NOT test),
e AS (SELECT l_extendedprice AS y, slope * l_quantity + intercept - l_extendedprice AS err FROM r, s WHERE test)
SELECT round(1 - sum(err * err) / (var_pop(y) * count(*)), 6) AS r2_score, round(avg(abs(err)), 4) AS mae,
       round(sqrt(avg(err * err)), 4) AS rmse FROM e""", "v_reg"))
def q_m10_line(spark, d):
    """Metrics on the test split of a user's estimator fitted to the training split."""
    m = _line_model(spark, d)[1]
    return spark.createDataFrame([(float(m["r2_score"]), float(m["mae"]), float(m["rmse"]))], "r2_score double, mae double, rmse double").select(
        F.round("r2_score", 6).alias("r2_score"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@register("M9_least_squares", with_views(f"""
WITH r AS (SELECT *, {_test_flag_sql('k')} AS test FROM v_reg),
s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM r WHERE NOT test),
e AS (SELECT round(1 - sum((slope * l_quantity + intercept - l_extendedprice) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2_score
      FROM r, s WHERE test),
w AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM v_reg)
SELECT k, round(slope * l_quantity + intercept, 2) AS prediction, 'Linear Regression' AS algorithm, r2_score FROM v_reg, w, e""", "v_reg"))
def q_m9_line(spark, d):
    """The whole training run with one candidate: score on the test split, then
    predictions of the model refitted to every row."""
    rows = _line_data(spark, d)
    run = M.auto_train(rows, "l_extendedprice", "regression", ["l_quantity"], [], "k", kinds=["linear"])
    scored = _rounded(L.score_batch(run.final_model, rows, None))
    return scored.withColumns({"algorithm": F.lit(run.best.name), "r2_score": F.round(F.lit(float(run.best.metrics["r2_score"])), 6)})


@register("F4_log_predictions", with_views("""
SELECT CAST(0 AS BIGINT) AS deployment_id, l_quantity, l_discount, l_tax, l_returnflag, CAST(count(*) AS BIGINT) AS n_ids
FROM v_reg GROUP BY l_quantity, l_discount, l_tax, l_returnflag""", "v_reg"))
def q_f4(spark, d):
    df, dp = _reg_setup(spark, d)
    model, _, _ = M.train_custom_estimator(M.make_estimator("linear", "regression", {}, 0), df, dp.target,
                                           dp.problem_type, dp.numerical, dp.categorical, "k")
    from modelkeep.session import scratch_path
    path = scratch_path(spark, "prediction-log")
    S.append_predictions(L.score_batch(model, df, None), path, 0, dp.numerical + dp.categorical)
    log = TB.read_table(spark, path, "prediction_id").where("prediction IS NOT NULL")
    field = lambda c: F.get_json_object("input_json", f"$.{c}")
    return log.groupBy("deployment_id", *[field(c).cast("double").alias(c) for c in dp.numerical], *[field(c).alias(c) for c in dp.categorical]).agg(
        F.count_distinct("prediction_id").alias("n_ids"))


@register("P15_register_dataset")
def q_p15(spark, d):
    return L.register_dataset(V.v_dirty(spark, d), "orders_dirty.csv", key=["o_orderkey"])


@register("P15_dataset_row", with_views(_ISSUES_SQL + f""",
found AS (SELECT count(*) AS n FROM issues)
SELECT CAST(7 AS BIGINT) AS id, 'orders_dirty.csv' AS name, count(*) AS row_count, CAST(6 AS BIGINT) AS column_count,
       'sparse' AS target_column, 'classification' AS problem_type,
       'Rule-based Profile: This dataset contains ' || count(*) || ' rows and 6 columns. '
       || 'The AutoML engine has identified it as a classification task targeting ''sparse''.' AS description,
       CAST(greatest(0, 100 - 10 * any_value(n)) AS BIGINT) AS overall_quality_score, CAST(any_value(n) AS INTEGER) AS n_issues
FROM v_dirty, found""", "v_dirty"))
def q_p15_row(spark, d):
    """The stored row's fields, its quality report read back from the JSON."""
    row = L.register_dataset(V.v_dirty(spark, d), "orders_dirty.csv", key=["o_orderkey"], dataset_id=7)
    q = F.from_json("quality_report", "overall_quality_score long, issues array<struct<column:string>>")
    return row.select("id", "name", "row_count", "column_count", "target_column", "problem_type", "description",
                      q["overall_quality_score"].alias("overall_quality_score"), F.size(q["issues"]).alias("n_issues"))


@register("P15_metadata", with_views(_P13_SQL.replace('SELECT p5."column", p5.pos,', 'SELECT p5."column",'), "v_dirty"))
def q_p15_metadata(spark, d):
    """The stored row's metadata of every column, read back from the JSON."""
    row = L.register_dataset(V.v_dirty(spark, d), "orders_dirty.csv", dataset_id=7)
    stats = "struct<min: double, max: double, mean: double, unique_count: long>"
    each = row.select(F.explode(F.from_json("features_metadata", f"map<string, struct<type: string, null_count: long, dtype: string, stats: {stats}, role: string, explanation: string>>")).alias("column", "m"))
    s = F.col("m.stats")
    return each.select("column", "m.type", "m.null_count", "m.dtype", *[r6(s[c]).alias(c) for c in ("min", "max", "mean")],
                       s["unique_count"].alias("unique_count"), "m.role", "m.explanation")


def _monitor_inputs(spark, d):
    """Training data of the deployed models' datasets: the logged input
    schema (``k``) read from the events themselves; current = the logs."""
    m = _models(spark, d)
    deps = _deps(spark, d, m)
    ds = V.v_datasets(spark, d, m)
    ev = table(spark, d, "events")
    reference = ev.select(F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                          F.col("event_type").alias("target"))
    refs = {i: reference for i in range(V.N_DATASETS)}
    return m, deps, ds, refs


def _d13_sql():
    """All deployments at once: the drift SQL with a feature per deployment."""
    body = drift_sql("__ref", "__cur", [], [], [])
    long = """
act AS (SELECT dp.id AS deployment_id, dp.drift_threshold FROM v_deployments dp WHERE dp.status = 'active'),
cnt AS (SELECT a.deployment_id, a.drift_threshold, count(l.deployment_id) AS n_rows FROM act a LEFT JOIN v_pred_log l USING (deployment_id) GROUP BY ALL),
long AS (
  SELECT 'd' || c.deployment_id AS feature, 0 AS grp, CAST(json_extract_string(e.props, '$.k') AS DOUBLE) AS num, NULL::VARCHAR AS cat
  FROM cnt c CROSS JOIN events e WHERE c.n_rows >= 5
  UNION ALL
  SELECT 'd' || c.deployment_id, 1, CAST(json_extract_string(l.input_json, '$.k') AS DOUBLE), NULL::VARCHAR
  FROM cnt c JOIN v_pred_log l USING (deployment_id) WHERE c.n_rows >= 5),
"""
    rest = body[body.index("med AS ("):].replace("l.feature IN ('')", "TRUE").replace("feature IN ('')", "TRUE").replace("CAST(CASE feature  END AS INTEGER) AS position", "0 AS position")
    return with_views("WITH " + long.strip() + "\n" + rest + """
SELECT c.deployment_id, round(COALESCE(CASE WHEN f.drift_detected THEN 1.0 ELSE 0.0 END, 0.0), 6) AS drift_score,
  COALESCE(CASE WHEN f.drift_detected THEN 1.0 ELSE 0.0 END >= c.drift_threshold, FALSE) AS has_drift,
  CASE WHEN n_rows = 0 THEN 'No production predictions logged yet. Run predictions first to calculate drift.'
       WHEN n_rows < 5 THEN 'Insufficient production data to calculate drift. Logged predictions: ' || n_rows || ' (requires at least 5).'
       ELSE 'Drift check complete. ' || CAST(f.drift_detected AS INTEGER) || ' of 1 features drifted (ratio: '
            || CASE WHEN f.drift_detected THEN '1.00' ELSE '0.00' END || ').'
            || CASE WHEN f.drift_detected THEN ' Data drift exceeded threshold. Retraining job has been queued.' ELSE '' END END AS message
FROM cnt c LEFT JOIN feats f ON f.feature = 'd' || c.deployment_id""", "v_pred_log", "v_models", "v_deployments")


@register("D13_drift_monitor", _d13_sql())
def q_d13(spark, d):
    m, deps, ds, refs = _monitor_inputs(spark, d)
    reports, _, _ = L.drift_monitors(deps, m, ds, refs, V.v_pred_log(spark, d))
    return reports.withColumn("drift_score", r6("drift_score"))


def _retraining_inputs(spark, d):
    """Every labelled document once: a fifth as logged predictions with their
    actual value, beside the unlabelled ones without, the others as the dataset."""
    logged = F.col("doc_id") % 5 == 0
    rows = V.v_cls(spark, d)
    documents = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source")
    unlabelled = documents.join(rows.select("doc_id"), "doc_id", "left_anti").withColumn("quality", F.lit(None).cast(rows.schema["quality"].dataType))
    log = rows.where(logged).unionByName(unlabelled).select(
        F.col("doc_id").alias("prediction_id"), F.lit(0).cast("long").alias("deployment_id"),
        F.to_json(F.struct("doc_id", "n_chars", "lang", "source")).alias("input_json"), F.col("quality").cast("string").alias("actual"))
    return rows.where(~F.coalesce(logged, F.lit(False))), log


@register("F11_run_retraining")
def q_f11(spark, d):
    df, log = _retraining_inputs(spark, d)
    dp = L.profile_dataset(df, "quality")
    m = _models(spark, d)
    deps = _deps(spark, d, m)
    ds = V.v_datasets(spark, d, m)
    result, decision = L.run_retraining(df, dp, "doc_id", log, m, deps, ds, dataset_id=0)
    return decision.select("dataset_id", "active_model_id", "active_metric", "new_metric", "promoted", "message")


@register("F11_training_set", with_views("""
SELECT CAST(doc_id AS VARCHAR) AS split_key, n_chars, lang, source, CAST(quality AS BIGINT) AS quality FROM v_cls WHERE doc_id % 5 <> 0
UNION ALL
SELECT 'fb:' || doc_id, n_chars, lang, source, CAST(quality AS BIGINT) FROM v_cls WHERE doc_id % 5 = 0""", "v_cls"))
def q_f11_rows(spark, d):
    """What the second of two runs trains on: each label once."""
    from modelkeep.session import scratch_path
    df, log = _retraining_inputs(spark, d)
    root = scratch_path(spark, "ledger")
    middle = log.agg(F.percentile_approx("prediction_id", 0.5)).first()[0]
    L.consume_feedback(root, log.where(F.col("prediction_id") <= F.lit(middle)), "first")  # labels come in the order of ids
    feedback = L.consume_feedback(root, log, "second")
    data = L.training_set(df, "quality", "doc_id", feedback)
    return data.select(F.col(M.SPLIT_KEY).alias("split_key"), "n_chars", "lang", "source", F.col("quality").cast("long").alias("quality"))


@register("R8_commit_active", with_views(f"""
SELECT id, model_id, CASE WHEN model_id = (SELECT max(id) FROM v_models WHERE status = 'DONE') THEN 'active' ELSE 'inactive' END AS status FROM v_deployments
UNION ALL
SELECT (SELECT max(id) + 1 FROM v_deployments), max(id), 'active' FROM v_models WHERE status = 'DONE'
  HAVING max(id) NOT IN (SELECT model_id FROM v_deployments)""", "v_models", "v_deployments"))
def q_r8_commit(spark, d):
    """The newest model made active in the stored deployments, twice: the replay changes nothing."""
    from modelkeep.session import scratch_path
    from modelkeep.sources.snapshots import SnapshotTable
    m = _models(spark, d)
    table_ = SnapshotTable(spark, scratch_path(spark, "deployments"))
    table_.append(_deps(spark, d, m).drop("deployed_at"), "first")
    newest = m.where(F.col("status") == "DONE").agg(F.max("id")).first()[0]
    for _ in range(2):
        R.commit_active(table_, m, newest, f"activate {newest}")
    return table_.read().select("id", "model_id", "status")


@register("S1_scan_csv", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_s1(spark, d):
    from modelkeep.session import scratch_path
    path = TB.write_csv(table(spark, d, "customer"), scratch_path(spark, "csv-customer"))
    return TB.scan_csv(spark, path)


@register("S1_scan_csv_texts", f"""
SELECT doc_id, CASE WHEN text IN ({", ".join("'" + t + "'" for t in TB.NA_TOKENS)}) THEN NULL ELSE md5(text) END AS text_md5,
       CASE WHEN lang IN ({", ".join("'" + t + "'" for t in TB.NA_TOKENS)}) THEN NULL ELSE lang END AS lang FROM documents""")
def q_s1_texts(spark, d):
    """Texts with quotes, commas and newlines, written and read by splits."""
    from modelkeep.session import scratch_path
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    got = TB.scan_csv(spark, TB.write_csv(docs, scratch_path(spark, "csv-documents")))
    return got.select("doc_id", F.md5("text").alias("text_md5"), "lang")


# ------------------------------------------- written tables, one-hot columns
@register("S6_write_table", with_views("""
SELECT event_type, severity, CAST(2 * count(*) AS BIGINT) AS n, CAST(2 * count(*) AS BIGINT) AS n_ids
FROM v_audit GROUP BY event_type, severity""", "v_audit"))
def q_s6(spark, d):
    """Two appends, read back: every record has an id of its own."""
    from modelkeep.session import scratch_path
    path = scratch_path(spark, "appended")
    rows = V.v_audit(spark, d).drop("id")
    for _ in range(2):
        TB.write_table(rows, path)
    return TB.read_table(spark, path).groupBy("event_type", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@register("A1_log_event", with_views("""
SELECT event_type, message, severity, CAST(1 AS BIGINT) AS n FROM v_audit""", "v_audit"))
def q_a1(spark, d):
    """Every event appended as an audit event, read back: each has an id of its own."""
    from modelkeep.session import scratch_path
    path = scratch_path(spark, "events")
    A.append_events(V.v_audit(spark, d).select("event_type", "message", "severity"), path)
    return TB.read_table(spark, path).groupBy("event_type", "message", "severity").agg(F.count_distinct("id").alias("n"))


@register("T9_onehot_columns", with_views(f"""
WITH tr AS (SELECT * FROM v_dirty WHERE NOT {_test_flag_sql('CAST(o_orderkey AS VARCHAR)')}),
vc AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c} AS category, count(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY {c}" for c in _ONEHOT_COLS)}),
r AS (SELECT *, count(*) OVER (PARTITION BY col) AS n_cats,
             row_number() OVER (PARTITION BY col ORDER BY n DESC, category DESC) AS fr FROM vc),
f AS (SELECT *, (n_cats <= 50 OR fr <= 49) AS frequent FROM r),
s AS (SELECT *, CASE WHEN frequent THEN row_number() OVER (PARTITION BY col, frequent ORDER BY category) - 1
                     ELSE count_if(frequent) OVER (PARTITION BY col) END AS slot FROM f),
long AS ({' UNION ALL '.join(f"SELECT o_orderkey, '{c}' AS col, {c} AS category FROM v_dirty" for c in _ONEHOT_COLS)})
SELECT l.o_orderkey, l.col AS "column", CAST(s.slot AS INTEGER) AS slot FROM long l JOIN s ON l.col = s.col AND l.category = s.category""",
    "v_dirty"))
def q_t9_columns(spark, d):
    """The 0/1 columns themselves, of training and test rows: where they are 1."""
    df = V.v_dirty(spark, d)
    train, _ = T.split_train_test(df, "o_orderkey")
    model = T.CappedOneHot(inputCols=_ONEHOT_COLS).fit(train)
    out = model.transform(df)
    cells = []
    for i, (c, cats, rare) in enumerate(zip(_ONEHOT_COLS, model.getOrDefault(model.categories), model.getOrDefault(model.withRare))):
        slots = [(f"__oh{i}_{j}", j) for j in range(len(cats))] + ([(f"__oh{i}_rare", len(cats))] if rare else [])
        cells += [F.struct(F.lit(c).alias("column"), F.lit(j).alias("slot"), F.col(name).alias("v")) for name, j in slots]
    return out.select("o_orderkey", F.inline(F.array(*cells))).where("v = 1").drop("v")


# ------------------------------------------------------------------- streams
def _stream_of(spark, df, name, last=None):
    """``df``, and then ``last``, written to a folder and read as a file stream."""
    from modelkeep.session import scratch_path
    path = scratch_path(spark, f"stream-{name}")
    df.write.parquet(path)
    if last is not None:
        last.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@register("X1_stream_score", """
SELECT l_orderkey, l_linenumber, round(regr_intercept(l_extendedprice, l_quantity) OVER ()
       + regr_slope(l_extendedprice, l_quantity) OVER () * l_quantity, 3) AS prediction FROM lineitem""")
def q_x1(spark, d):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from modelkeep.session import scratch_path
    from modelkeep.streaming import streams as X
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    x = VectorAssembler(inputCols=["l_quantity"], outputCol="features")
    model = PipelineModel(stages=[x, M.fit_linear(x.transform(li.withColumnRenamed("l_extendedprice", "label")))])
    stream = _stream_of(spark, li, "inputs")
    out = scratch_path(spark, "scored")
    X.start(X.stream_score(stream, model, None, 1, ["l_orderkey", "l_linenumber"]), out, scratch_path(spark, "ck")).awaitTermination()
    got = spark.read.parquet(out)
    key = lambda k: F.get_json_object("input_json", f"$.{k}")
    return got.select(key("l_orderkey").cast("long").alias("l_orderkey"), key("l_linenumber").cast("int").alias("l_linenumber"),
                      F.round(F.col("prediction").cast("double"), 3).alias("prediction"))


@register("X2_stream_volume", with_views(f"""
SELECT deployment_id, strftime(date_trunc('hour', logged_at), {TS_SQL}) AS window_start,
       CAST(count(*) AS BIGINT) AS predictions
FROM v_pred_log GROUP BY deployment_id, date_trunc('hour', logged_at)""", "v_pred_log"))
def q_x2_stream(spark, d):
    """The stream itself, in complete mode so that open windows show too."""
    from modelkeep.session import scratch_path
    from modelkeep.streaming import streams as X
    out = scratch_path(spark, "volume")
    volume = X.stream_volume(_stream_of(spark, V.v_pred_log(spark, d), "log"))
    X.start_batches(volume, lambda batch, _: batch.write.mode("overwrite").parquet(out), scratch_path(spark, "ck"), mode="complete").awaitTermination()
    return spark.read.parquet(out).select("deployment_id", F.date_format("window_start", TS_FMT).alias("window_start"), "predictions")


@register("X3_stream_feedback", """
SELECT event_id AS prediction_id, CASE WHEN event_id % 6 = 0 THEN lower(event_type) WHEN event_id % 3 = 0 THEN upper(event_type) END AS actual FROM events""")
def q_x3(spark, d):
    """Every prediction with the last of its labels, as the stream's sink has it."""
    from modelkeep.session import scratch_path
    from modelkeep.streaming import streams as X
    preds, labels = V.v_pred_log(spark, d).drop("actual"), V.v_feedback(spark, d)
    end = "10 days"
    out = scratch_path(spark, "pairs")
    paired = X.stream_feedback(_stream_of(spark, preds, "predictions", X.closing_events(preds, "logged_at", end)),
                               _stream_of(spark, labels, "feedback", X.closing_events(labels, "received_at", end)), "1 day")
    X.start(paired, out, scratch_path(spark, "ck")).awaitTermination()
    return spark.read.parquet(out).select("prediction_id", "actual")


def _performance_stream(spark, d):
    from modelkeep.session import scratch_path
    from modelkeep.streaming import streams as X
    m = _models(spark, d)
    deps, ds = _deps(spark, d, m), V.v_datasets(spark, d, m)
    root = scratch_path(spark, "performance")
    changes = X.label_changes(_stream_of(spark, V.v_pred_log(spark, d), "log"), wait="60 days")
    X.start_batches(changes, X.performance_state(root, deps, m, ds), scratch_path(spark, "ck"), mode="update").awaitTermination()
    return root, deps


@register("X4_stream_performance", ORACLE["F9_performance_check"])
def q_x4(spark, d):
    from modelkeep.streaming import streams as X
    root, deps = _performance_stream(spark, d)
    return X.performance_now(root, spark, deps).select("deployment_id", "n_labelled", r6("accuracy").alias("accuracy"), "performance_threshold", "alarm", "message")


@register("X4_stream_requests", ORACLE["F10_retrain_requests"])
def q_x4_requests(spark, d):
    """What the stream asks to be retrained, when alarms go on."""
    root, _ = _performance_stream(spark, d)
    return spark.read.parquet(f"{root}/requests").drop("batch_id")


@register("X5_stream_drift", ORACLE["D10_drift_score"])
def q_x5(spark, d):
    from modelkeep.session import scratch_path
    from modelkeep.streaming import streams as X
    ref, cur = V.v_drift_large(spark, d)
    out = scratch_path(spark, "drift")
    X.start_batches(_stream_of(spark, cur, "current"), X.drift_batch(ref, out), scratch_path(spark, "ck")).awaitTermination()
    return spark.read.parquet(f"{out}/reports").select(
        F.lit("large").alias("pair"), r6("drift_score").alias("drift_score"), "number_of_columns", "number_of_drifted_columns", "has_drift", "message")
