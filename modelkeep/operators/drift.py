"""Drift: D1-D12 (test definitions: SURVEY Appendix C).

Both sides are counted once, in one shuffle, into the aligned counts
``(feature, num, cat, ref_n, cur_n)``, one row per distinct value; every test
works on these.  Numeric features have ``num``, text features ``cat``.  Ordered
statistics (KS, Wasserstein) use the bucketed running sums, so a feature with
billions of distinct values is still spread over many tasks.

Every step also takes ``keys``: more columns (a deployment, say) that tell
apart many reports, which are then computed by one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelkeep.functions.ordered import MAX_ROWS_PER_BUCKET, exact_median, running_sums
from modelkeep.functions.pvalues import chi2_pvalue, ks_pvalue_col, z_pvalue
from modelkeep.functions.values import is_numeric_type, spread, typed

# Gate, test selection and thresholds of the drift preset.
MIN_CURRENT_ROWS = 5
SMALL_REFERENCE_ROWS = 1000
NUMERIC_MIN_UNIQUE = 5      # numeric tests need more distinct values than this
BINARY_MAX_UNIQUE = 2       # z-test at or below this many distinct values
P_VALUE_THRESHOLD = 0.05
DISTANCE_THRESHOLD = 0.1
WASSERSTEIN_MIN_STD = 0.001
DEFAULT_DRIFT_THRESHOLD = 0.3
TEST_KS = "K-S p_value"
TEST_CHI2 = "chi-square p_value"
TEST_Z = "Z-test p_value"
TEST_WASSERSTEIN = "Wasserstein distance (normed)"
TEST_JS = "Jensen-Shannon distance"
GATE_MESSAGE = ("Insufficient production data to calculate drift. Logged predictions: %d "
                "(requires at least %d).")
NO_FEATURES_MESSAGE = "No matching feature columns between reference and current data."
DONE_MESSAGE = "Drift check complete. %d of %d features drifted (ratio: %s)."

FEATURE_SCHEMA = ("feature string, position int, feature_type string, test_name string, "
                  "score_kind string, n_ref bigint, n_cur bigint, n_values bigint, "
                  "statistic double, p_value double, drift_score double, drift_detected boolean")


# --------------------------------------------------------------------- D1
def align_features(ref: DataFrame, cur: DataFrame, target: str | None = None) -> list[str]:
    """Reference columns minus target, present in current, reference order."""
    cur_cols = set(cur.columns)
    return [c for c in ref.columns if c != target and c in cur_cols]


# --------------------------------------------------------------------- D2
def harmonise_types(ref: DataFrame, cur: DataFrame, features: list[str]):
    """When either side is text, both sides become text (NULL -> 'nan').

    Returns ``(ref, cur, numeric_features, text_features)``.
    """
    numeric, text = [], []
    for f in features:
        if is_numeric_type(ref.schema[f].dataType) and is_numeric_type(cur.schema[f].dataType):
            numeric.append(f)
        else:
            text.append(f)

    def side(df):
        cols = [typed(df, f).cast("double").alias(f) for f in numeric]
        cols += [F.coalesce(cell_text(df, f), F.lit("nan")).alias(f) for f in text]
        return df.select(*cols)

    return side(ref), side(cur), numeric, text


def cell_text(df: DataFrame, f: str):
    """A value as the text it is compared by."""
    dt = df.schema[f].dataType
    c = typed(df, f)
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def _cells(df: DataFrame, numeric: list[str], text: list[str], keys: list[str]) -> DataFrame:
    """``(keys, feature, num, cat)``: a row becomes one cell per feature, in one scan."""
    cells = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("num"), F.lit(None).cast("string").alias("cat")) for f in numeric]
    cells += [F.struct(F.lit(f).alias("feature"), F.lit(None).cast("double").alias("num"), F.col(f).alias("cat")) for f in text]
    return spread(df.select(*keys, *numeric, *text)).select(*keys, F.inline(F.array(*cells)))


def value_counts(df: DataFrame, numeric: list[str], text: list[str], keys: list[str] = []) -> DataFrame:
    """``(keys, feature, num, cat, n)`` of one harmonised side."""
    return _cells(df, numeric, text, keys).groupBy(*keys, "feature", "num", "cat").agg(F.count(F.lit(1)).alias("n"))


def align_counts(ref: DataFrame, cur: DataFrame, keys: list[str] = []) -> DataFrame:
    """``(keys, feature, num, cat, ref_n, cur_n)`` of two sides' cells; with a
    column ``n`` a cell stands for that many, so counts merge with cells."""
    def side(df, own, other):
        n = F.col("n") if "n" in df.columns else F.lit(1).cast("long")
        return df.select(*keys, "feature", "num", "cat", n.alias(own), F.lit(0).cast("long").alias(other))
    both = side(ref, "ref_n", "cur_n").unionByName(side(cur, "cur_n", "ref_n"))
    return both.groupBy(*keys, "feature", "num", "cat").agg(F.sum("ref_n").alias("ref_n"), F.sum("cur_n").alias("cur_n"))


# --------------------------------------------------------------------- D3
#: A text feature's cells have a text always (NULL is 'nan'), so this is a numeric NULL.
_HOLE = "num IS NULL AND cat IS NULL"


def reference_medians(aligned: DataFrame, keys: list[str] = []) -> DataFrame:
    """``(keys, feature, median)`` of the reference side of numeric features."""
    own = aligned.where("num IS NOT NULL AND ref_n > 0").select(*keys, "feature", F.col("num").alias("value"), F.col("ref_n").alias("n"))
    return exact_median(own, [*keys, "feature"])


def fill_from_reference(aligned: DataFrame, keys: list[str] = []) -> DataFrame:
    """D3: numeric NULLs on both sides take the reference median.

    Only the counts of the NULLs move, to the median's row (a new one where
    the median isn't a value); no row is shuffled again.  Features without a
    reference value keep their NULLs.
    """
    g = [*keys, "feature"]
    holes = aligned.where(_HOLE).select(*g, F.col("ref_n").alias("ref_holes"), F.col("cur_n").alias("cur_holes"))
    if holes.isEmpty():
        return aligned
    some = aligned.join(F.broadcast(holes.select(*g)), g, "left_semi")  # one row per feature
    fill = F.broadcast(holes.join(reference_medians(some, keys), g, "left"))
    here = F.col("num") == F.col("median")
    whole = aligned.where(f"NOT ({_HOLE})").join(fill, g, "left")
    kept = whole.select(*g, "num", "cat", *[(F.col(f"{x}_n") + F.when(here, F.col(f"{x}_holes")).otherwise(0)).alias(f"{x}_n") for x in ("ref", "cur")])
    met = whole.where(here).select(*g)
    new = fill.join(met, g, "left_anti").select(*g, F.col("median").alias("num"), F.lit(None).cast("string").alias("cat"),
                                                F.col("ref_holes").alias("ref_n"), F.col("cur_holes").alias("cur_n"))
    return kept.unionByName(new)


# --------------------------------------------------------------------- D4
def choose_test(aligned: DataFrame, keys: list[str] = []) -> DataFrame:
    """``(keys, feature, feature_type, n_ref, n_cur, n_values, test_name, mu)``.

    ``mu`` is the reference mean of numeric features (used by D8).
    """
    per = aligned.groupBy(*keys, "feature").agg(
        F.sum("ref_n").cast("long").alias("n_ref"),
        F.sum("cur_n").cast("long").alias("n_cur"),
        F.count(F.lit(1)).cast("long").alias("n_values"),
        (F.sum(F.col("num") * F.col("ref_n")) / F.nullif(F.sum("ref_n"), F.lit(0))).alias("mu"),
        F.bool_and(F.col("cat").isNull()).alias("is_num"))
    num = F.col("is_num")
    test = (F.when(F.col("n_ref") <= SMALL_REFERENCE_ROWS, _small_test(num))
            .when(num & (F.col("n_values") > NUMERIC_MIN_UNIQUE), TEST_WASSERSTEIN)
            .otherwise(TEST_JS))
    return per.select(*keys, "feature", F.when(num, "numerical").otherwise("categorical").alias("feature_type"),
                      "n_ref", "n_cur", "n_values", test.alias("test_name"), "mu")


def _small_test(numeric):
    """The test of a feature whose reference is small."""
    return (F.when(numeric & (F.col("n_values") > NUMERIC_MIN_UNIQUE), TEST_KS)
            .when(F.col("n_values") > BINARY_MAX_UNIQUE, TEST_CHI2).otherwise(TEST_Z))


# --------------------------------------------------------------- D5 .. D9
def ordered_statistics(aligned: DataFrame, tests: DataFrame, keys: list[str] = []) -> DataFrame:
    """ECDF statistics of numeric features in ONE ordered pass.

    ``(keys, feature, ks_d, w_area, ref_var)``: max |F - G| (KS), the integral of
    |F - G| over the value axis (Wasserstein) and the reference population
    variance.  ``tests`` has one row per feature, hence the broadcast.
    """
    ordered = tests.where(F.col("test_name").isin(TEST_KS, TEST_WASSERSTEIN))
    g = [*keys, "feature"]
    info = F.broadcast(ordered.select(*g, "n_ref", "n_cur", "mu"))
    a = aligned.where(F.col("num").isNotNull()).join(info, g)
    # the distinct-value count per feature is known: size the buckets from it
    widest = ordered.agg(F.max("n_values")).first()[0] or 0
    buckets = max(1, -(-widest // MAX_ROWS_PER_BUCKET))
    cum = running_sums(a, g, ["num"], ["ref_n", "cur_n"], with_next=True, buckets=buckets)
    gap = F.coalesce(F.col("num_next") - F.col("num"), F.lit(0.0))
    diff = F.abs(F.col("ref_n_cum") / F.col("n_ref") - F.col("cur_n_cum") / F.col("n_cur"))
    return cum.groupBy(*g).agg(
        F.max(diff).alias("ks_d"),
        F.sum(diff * gap).alias("w_area"),
        (F.sum(F.col("ref_n") * F.pow(F.col("num") - F.col("mu"), 2)) / F.first("n_ref")).alias("ref_var"))


def share_statistics(aligned: DataFrame, tests: DataFrame, keys: list[str] = []) -> DataFrame:
    """Count-share statistics of every feature in ONE aggregation.

    ``(keys, feature, chi_sum, unseen, js_div, low_ref, low_cur)``: chi-square sum
    with expected = reference share x current rows (an expected 0 with
    observations marks ``unseen``), Jensen-Shannon divergence (natural log,
    0 ln 0 = 0) and the counts of the smallest value (z-test).
    """
    g = [*keys, "feature"]
    info = F.broadcast(tests.select(*g, "n_ref", "n_cur"))
    a = aligned.join(info, g)
    e = F.col("ref_n") * F.col("n_cur") / F.col("n_ref")
    p = F.col("ref_n") / F.col("n_ref")
    q = F.col("cur_n") / F.col("n_cur")
    h = (p + q) / 2

    def kl(x):
        return F.when(x > 0, x * F.log(x / h)).otherwise(F.lit(0.0))

    return a.groupBy(*g).agg(
        F.sum(F.when(e > 0, F.pow(F.col("cur_n") - e, 2) / e).otherwise(F.lit(0.0))).alias("chi_sum"),
        F.max(((e == 0) & (F.col("cur_n") > 0)).cast("int")).alias("unseen"),
        (F.sum(kl(p)) / 2 + F.sum(kl(q)) / 2).alias("js_div"),
        F.min_by(F.struct(F.col("ref_n").alias("ref"), F.col("cur_n").alias("cur")),
                 F.struct("num", "cat")).alias("low"))


def drift_statistics(aligned: DataFrame, tests: DataFrame, keys: list[str] = []) -> DataFrame:
    """Statistic and p-value of the chosen test for every feature."""
    g = [*keys, "feature"]
    stats = (tests.join(ordered_statistics(aligned, tests, keys), g, "left")
             .join(share_statistics(aligned, tests, keys), g, "left"))
    n, m = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    # z-test on the share of the smallest value
    p1, p2 = F.col("low.ref") / n, F.col("low.cur") / m
    pooled = (F.col("low.ref") + F.col("low.cur")) / (n + m)
    se = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / n + F.lit(1.0) / m))
    z = F.when((F.col("n_values") <= 1) | (se == 0), F.lit(0.0)).otherwise((p1 - p2) / se)
    chi = F.when(F.col("unseen") == 1, F.lit(float("inf"))).otherwise(F.col("chi_sum"))
    w = F.col("w_area") / F.greatest(F.sqrt("ref_var"), F.lit(WASSERSTEIN_MIN_STD))
    js = F.sqrt(F.greatest(F.col("js_div"), F.lit(0.0)))
    t = F.col("test_name")
    statistic = (F.when(t == TEST_KS, F.col("ks_d")).when(t == TEST_WASSERSTEIN, w)
                 .when(t == TEST_CHI2, chi).when(t == TEST_Z, z).otherwise(js))
    dof = F.when(t == TEST_CHI2, F.col("n_values") - 1)
    out = stats.select(*g, "feature_type", "test_name", "n_ref", "n_cur", "n_values",
                       statistic.alias("statistic"), dof.alias("dof"))
    # One row per feature: the p-value UDFs see a handful of rows, and are
    # only planned when a chi-square or z test was chosen.
    chosen = {r["test_name"] for r in tests.select("test_name").distinct().collect()}
    p_value = F.when(t == TEST_KS, ks_pvalue_col(F.col("statistic"), n, m))
    if TEST_CHI2 in chosen:
        p_value = p_value.when(t == TEST_CHI2, chi2_pvalue(F.col("statistic"), F.col("dof").cast("double")))
    if TEST_Z in chosen:
        p_value = p_value.when(t == TEST_Z, z_pvalue(F.col("statistic")))
    return out.withColumn("p_value", p_value)


def _by_test(aligned, tests, test, cols):
    """Features that ``test`` is for.  The tests with p-values don't ask how
    large the reference is; D10 asks, when it chooses."""
    if test in (TEST_KS, TEST_CHI2, TEST_Z):
        tests = tests.withColumn("test_name", _small_test(F.col("feature_type") == "numerical"))
    return drift_statistics(aligned, tests).where(F.col("test_name") == test).select("feature", *cols)


def drift_ks(aligned: DataFrame, tests: DataFrame) -> DataFrame:
    """Two-sample KS ``(feature, statistic=D, p_value)`` (asymptotic p)."""
    return _by_test(aligned, tests, TEST_KS, ["statistic", "p_value"])


def drift_chi2(aligned: DataFrame, tests: DataFrame) -> DataFrame:
    """Chi-square ``(feature, statistic, dof, p_value)``."""
    return _by_test(aligned, tests, TEST_CHI2, ["statistic", "dof", "p_value"])


def drift_z(aligned: DataFrame, tests: DataFrame) -> DataFrame:
    """Two-proportion z ``(feature, statistic=z, p_value)``."""
    return _by_test(aligned, tests, TEST_Z, ["statistic", "p_value"])


def drift_wasserstein(aligned: DataFrame, tests: DataFrame) -> DataFrame:
    """Wasserstein distance / max(std_pop(reference), 0.001)."""
    return _by_test(aligned, tests, TEST_WASSERSTEIN, ["statistic"])


def drift_js(aligned: DataFrame, tests: DataFrame) -> DataFrame:
    """Jensen-Shannon distance of the value shares."""
    return _by_test(aligned, tests, TEST_JS, ["statistic"])


def prepared_counts(ref: DataFrame, cur: DataFrame, target: str | None = None):
    """D1-D4 composed: ``(features, aligned, tests)``; the distinct-value
    frames are persisted because every statistic reads them (they are far
    smaller than the input and rebuilt from lineage if an executor is lost).
    The caller releases ``aligned`` and ``tests``.
    """
    features = align_features(ref, cur, target)
    r, c, numeric, text = harmonise_types(ref, cur, features)
    raw = align_counts(_cells(r, numeric, text, []), _cells(c, numeric, text, [])).persist()
    aligned = fill_from_reference(raw)
    if aligned is not raw:
        aligned = aligned.persist()
    tests = choose_test(aligned).persist()
    tests.count()  # fills all of them, so the raw counts can go
    if aligned is not raw:
        raw.unpersist()
    return features, aligned, tests


# ----------------------------------------------------- reference summaries
def store_reference(ref: DataFrame, cur: DataFrame, path: str, target: str | None = None) -> DataFrame:
    """The reference's value counts, harmonised with the columns of ``cur``,
    written once below ``path``: ``(feature, position, num, cat, n)``.

    Summaries merge: the counts of two parts of a reference, added up, are the
    counts of both (:func:`merge_references`).
    """
    features = align_features(ref, cur, target)
    r, _, numeric, text = harmonise_types(ref, cur, features)
    position = F.element_at(F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))]), F.col("feature"))
    counts = value_counts(r, numeric, text) if features else ref.sparkSession.createDataFrame([], "feature string, num double, cat string, n long")
    out = counts.withColumn("position", position.cast("int") if features else F.lit(None).cast("int"))
    out.select("feature", "position", "num", "cat", "n").write.mode("overwrite").parquet(path)
    return ref.sparkSession.read.parquet(path)


def merge_references(*summaries: DataFrame) -> DataFrame:
    """One summary of several parts of a reference."""
    both = summaries[0]
    for more in summaries[1:]:
        both = both.unionByName(more)
    return both.groupBy("feature", "position", "num", "cat").agg(F.sum("n").alias("n"))


def summary_features(summary: DataFrame) -> list[tuple[str, bool]]:
    """The features of a summary in order, and whether each is numeric: a row per column."""
    rows = summary.groupBy("position", "feature").agg(F.bool_and(F.col("cat").isNull()).alias("numeric")).orderBy("position").collect()
    return [(r["feature"], r["numeric"]) for r in rows]


def report_from_summary(summary: DataFrame, cur: DataFrame, threshold: float = DEFAULT_DRIFT_THRESHOLD):
    """D11 against a stored reference (:func:`store_reference`): reads the
    summary and the current rows only."""
    spark = cur.sparkSession
    known = [(f, n) for f, n in summary_features(summary) if f in cur.columns]
    numeric, text = [f for f, n in known if n], [f for f, n in known if not n]
    if not known:
        return _no_report(spark, cur.limit(MIN_CURRENT_ROWS).count())
    c = cur.select(*[typed(cur, f).cast("double").alias(f) for f in numeric], *[F.coalesce(cell_text(cur, f), F.lit("nan")).alias(f) for f in text])
    ref = summary.where(F.col("feature").isin([f for f, _ in known]))
    raw = align_counts(ref, _cells(c, numeric, text, [])).persist()
    aligned = fill_from_reference(raw)
    tests = choose_test(aligned).persist()
    found = _report(spark, [f for f, _ in known], aligned, tests, threshold)
    for frame in (raw, tests):
        frame.unpersist()
    return found


# ------------------------------------------------------------- D10 / D11
def feature_rows(stats: DataFrame, position, keys: list[str] = []) -> DataFrame:
    """Per-feature drift rows with what their tests say."""
    is_p = F.col("test_name").isin(TEST_KS, TEST_CHI2, TEST_Z)
    score = F.when(is_p, F.col("p_value")).otherwise(F.col("statistic"))
    detected = F.when(is_p, F.col("p_value") < P_VALUE_THRESHOLD) \
        .otherwise(F.col("statistic") >= DISTANCE_THRESHOLD)
    return stats.select(
        *keys, "feature", position.cast("int").alias("position"), "feature_type", "test_name",
        F.when(is_p, "p_value").otherwise("distance").alias("score_kind"),
        "n_ref", "n_cur", "n_values", "statistic", "p_value",
        score.alias("drift_score"), detected.alias("drift_detected"))


def _position_of(features: list[str]):
    return F.element_at(F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))]), F.col("feature"))


def feature_drift(ref: DataFrame, cur: DataFrame, target: str | None = None) -> DataFrame:
    """Per-feature drift rows (D1-D9 composed), schema ``FEATURE_SCHEMA``.

    The rows, one per feature, are computed at once and the frames behind
    them released, so a report leaves nothing cached.
    """
    spark = ref.sparkSession
    if not align_features(ref, cur, target):
        return spark.createDataFrame([], FEATURE_SCHEMA)
    features, aligned, tests = prepared_counts(ref, cur, target)
    rows = feature_rows(drift_statistics(aligned, tests), _position_of(features))
    found = spark.createDataFrame(rows.collect(), rows.schema)
    aligned.unpersist()
    tests.unpersist()
    return found


def drift_score(features: DataFrame, threshold: float = DEFAULT_DRIFT_THRESHOLD) -> DataFrame:
    """``(drift_score, number_of_columns, number_of_drifted_columns,
    has_drift, message)``."""
    agg = features.agg(
        F.count(F.lit(1)).cast("long").alias("number_of_columns"),
        F.count_if(F.col("drift_detected")).cast("long").alias("number_of_drifted_columns"))
    score = F.when(F.col("number_of_columns") > 0,
                   F.col("number_of_drifted_columns") / F.col("number_of_columns")).otherwise(0.0)
    return agg.select(
        score.cast("double").alias("drift_score"), "number_of_columns", "number_of_drifted_columns",
        (score >= F.lit(threshold)).alias("has_drift"),
        F.format_string(DONE_MESSAGE, F.col("number_of_drifted_columns"),
                        F.col("number_of_columns"), F.format_number(score, 2)).alias("message"))


SUMMARY_SCHEMA = "drift_score double, number_of_columns bigint, number_of_drifted_columns bigint, has_drift boolean, message string"


def _no_report(spark, n_cur: int):
    """No feature rows, and why: too few current rows, or no feature."""
    message = GATE_MESSAGE % (n_cur, MIN_CURRENT_ROWS) if n_cur < MIN_CURRENT_ROWS else NO_FEATURES_MESSAGE
    return spark.createDataFrame([], FEATURE_SCHEMA), spark.createDataFrame([(0.0, 0, 0, False, message)], SUMMARY_SCHEMA)


def _report(spark, features: list[str], aligned: DataFrame, tests: DataFrame, threshold: float):
    """Every current row has one cell per feature, so the tests' counts say how many rows there are."""
    n_cur = tests.agg(F.max("n_cur")).first()[0] or 0
    if n_cur < MIN_CURRENT_ROWS:
        return _no_report(spark, n_cur)
    rows = feature_rows(drift_statistics(aligned, tests), _position_of(features))
    feats = spark.createDataFrame(rows.collect(), rows.schema)
    return feats, drift_score(feats, threshold)


def drift_report(ref: DataFrame, cur: DataFrame, target: str | None = None,
                 threshold: float = DEFAULT_DRIFT_THRESHOLD):
    """Gate, then per-feature rows and the summary.

    Returns ``(features_df, summary_df)``.  Fewer than 5 current rows give
    score 0, no feature rows and the gate message; the rows are counted with
    their values, in the one pass over both sides.
    """
    spark = ref.sparkSession
    if not align_features(ref, cur, target):
        return _no_report(spark, cur.limit(MIN_CURRENT_ROWS).count())
    features, aligned, tests = prepared_counts(ref, cur, target)
    found = _report(spark, features, aligned, tests, threshold)
    aligned.unpersist()
    tests.unpersist()
    return found


# --------------------------------------------------------------------- D12
def drift_summary(features: DataFrame) -> DataFrame:
    """Checked, drifted, stable features and the overall percentage."""
    agg = features.agg(
        F.count(F.lit(1)).cast("long").alias("features_checked"),
        F.count_if(F.col("drift_detected")).cast("long").alias("drifted_features"))
    score = F.when(F.col("features_checked") > 0,
                   F.col("drifted_features") / F.col("features_checked")).otherwise(0.0)
    return agg.select(
        "features_checked", "drifted_features",
        (F.col("features_checked") - F.col("drifted_features")).alias("stable_features"),
        F.concat(F.format_number(score * 100, 1), F.lit("%")).alias("overall_drift"))
