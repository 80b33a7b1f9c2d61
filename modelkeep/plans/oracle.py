"""Helpers that write the DuckDB side of the correctness gate.

The oracle SQL is plain ANSI-ish SQL over the driver's views; these helpers
only generate repetitive per-column SELECTs from a column spec list so that
each query's SQL stays readable.
"""

from __future__ import annotations

from modelkeep.functions.values import NUMBER_PATTERN, STRIP_CHARS, URL_PATTERN

# Column specs of the fixture views: (name, kind) with kind in
# int / float / text / bool.
SPECS = {
    "v_dirty": [("o_orderkey", "int"), ("price_txt", "text"), ("o_orderstatus", "text"),
                ("o_orderpriority", "text"), ("mixed", "text"), ("sparse", "text")],
    "customer": [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"),
                 ("c_acctbal", "float"), ("c_mktsegment", "text")],
    "v_urls": [("page_id", "int"), ("url", "text")],
    "v_cls": [("doc_id", "int"), ("n_chars", "int"), ("lang", "text"), ("source", "text"),
              ("quality", "int")],
    "v_reg": [("k", "text"), ("l_quantity", "float"), ("l_discount", "float"),
              ("l_tax", "float"), ("l_returnflag", "text"), ("l_extendedprice", "float")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"),
                 ("l_linenumber", "int"), ("l_quantity", "float"), ("l_extendedprice", "float"),
                 ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "text"),
                 ("l_linestatus", "text"), ("l_shipdate", "ts")],
}


def parse_sql(expr: str) -> str:
    """DuckDB twin of ``parse_number``."""
    cleaned = f"trim(regexp_replace({expr}, '{STRIP_CHARS}', '', 'g'))"
    return (f"CASE WHEN regexp_matches({cleaned}, '{NUMBER_PATTERN}') "
            f"THEN TRY_CAST({cleaned} AS DOUBLE) END")


def coerced_view(view: str, spec: list[tuple[str, str]], coerced: list[str]) -> tuple[str, list]:
    """SELECT over ``view`` with ``coerced`` text columns parsed to double."""
    cols = []
    new_spec = []
    for name, kind in spec:
        if name in coerced:
            cols.append(f"{parse_sql(name)} AS {name}")
            new_spec.append((name, "float"))
        else:
            cols.append(name)
            new_spec.append((name, kind))
    return f"SELECT {', '.join(cols)} FROM {view}", new_spec


def text_sql(name: str, kind: str) -> str:
    if kind == "text":
        return name
    if kind == "ts":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    if kind == "bool":
        return f"CASE WHEN {name} THEN 'true' WHEN NOT {name} THEN 'false' END"
    return f"CAST({name} AS VARCHAR)"


def profile_sql(source: str, spec: list[tuple[str, str]]) -> str:
    """Per-column profile rows over ``source`` (a view name or subquery).

    Columns: column, pos, numeric, n_rows, non_null, null_count, n_unique,
    min, max, mean, url_ratio, dtype.
    """
    parts = []
    for pos, (name, kind) in enumerate(spec):
        numeric = kind in ("int", "float", "bool")
        if numeric:
            num = f"CAST({name} AS DOUBLE)"
            mn, mx, mean, url = f"min({num})", f"max({num})", f"avg({num})", "NULL::DOUBLE"
        else:
            mn = mx = mean = "NULL::DOUBLE"
            url = (f"avg(CASE WHEN {name} IS NOT NULL THEN "
                   f"CAST(regexp_matches({text_sql(name, kind)}, '{URL_PATTERN}') AS DOUBLE) END)")
        if kind == "int":
            dtype = f"CASE WHEN count(*) - count({name}) > 0 THEN 'float64' ELSE 'int64' END"
        elif kind == "float":
            dtype = "'float64'"
        elif kind == "bool":
            dtype = "'bool'"
        else:
            dtype = "'object'"
        parts.append(
            f"SELECT '{name}' AS \"column\", {pos} AS pos, {str(numeric).upper()} AS numeric, "
            f"CAST(count(*) AS BIGINT) AS n_rows, CAST(count({name}) AS BIGINT) AS non_null, "
            f"CAST(count(*) - count({name}) AS BIGINT) AS null_count, "
            f"CAST(count(DISTINCT {name}) AS BIGINT) AS n_unique, "
            f"{mn} AS min, {mx} AS max, {mean} AS mean, {url} AS url_ratio, {dtype} AS dtype "
            f"FROM {source}")
    return "\nUNION ALL\n".join(parts)


def ignorable_sql(profile: str) -> str:
    """P2 rules over a profile CTE name."""
    return f"""
    SELECT "column", pos, url_ratio,
           CAST(n_unique AS DOUBLE) / greatest(non_null, 1) AS uniqueness, n_unique,
           COALESCE(CASE WHEN numeric
                THEN CAST(n_unique AS DOUBLE) / greatest(non_null, 1) > 0.95 AND n_unique > 100
                ELSE non_null > 0 AND (url_ratio > 0.3 OR
                     (CAST(n_unique AS DOUBLE) / greatest(non_null, 1) > 0.7 AND n_unique > 50))
           END, FALSE) AS ignorable
    FROM {profile}"""


def unpivot_text_sql(source: str, spec: list[tuple[str, str]], key: list[str]) -> str:
    """Long ``(key..., column, value)`` rows with values as text, NULLs kept."""
    parts = [f"SELECT {', '.join(key)}, '{n}' AS \"column\", {text_sql(n, k)} AS value FROM {source}"
             for n, k in spec]
    return "\nUNION ALL\n".join(parts)


def drift_sql(ref: str, cur: str, numeric: list[str], text: list[str],
              order: list[str] | None = None) -> str:
    """CTEs ``aligned``, ``tests``, ``stats``, ``feats`` for a drift check of
    ``cur`` against ``ref`` (SURVEY Appendix C), written for DuckDB."""
    parts = []
    for g, src in ((0, ref), (1, cur)):
        for f in numeric:
            parts.append(f"SELECT '{f}' AS feature, {g} AS grp, CAST({f} AS DOUBLE) AS num, "
                         f"NULL::VARCHAR AS cat FROM {src}")
        for f in text:
            parts.append(f"SELECT '{f}', {g}, NULL::DOUBLE, COALESCE(CAST({f} AS VARCHAR), 'nan') "
                         f"FROM {src}")
    nums = ", ".join(f"'{f}'" for f in numeric) or "''"
    pos = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(order or numeric + text))
    return f"""
long AS ({' UNION ALL '.join(parts)}),
med AS (SELECT feature, median(num) AS med FROM long WHERE grp = 0 AND num IS NOT NULL GROUP BY feature),
filled AS (SELECT l.feature, grp,
                  CASE WHEN l.feature IN ({nums}) AND num IS NULL THEN m.med ELSE num END AS num, cat
           FROM long l LEFT JOIN med m ON l.feature = m.feature),
aligned AS (SELECT feature, num, cat,
                   CAST(sum(CASE WHEN grp = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ref_n,
                   CAST(sum(CASE WHEN grp = 1 THEN 1 ELSE 0 END) AS BIGINT) AS cur_n
            FROM filled GROUP BY feature, num, cat),
tests AS (SELECT feature,
                 CASE WHEN feature IN ({nums}) THEN 'numerical' ELSE 'categorical' END AS feature_type,
                 CAST(sum(ref_n) AS BIGINT) AS n_ref, CAST(sum(cur_n) AS BIGINT) AS n_cur,
                 CAST(count(*) AS BIGINT) AS n_values,
                 sum(num * ref_n) / sum(ref_n) AS mu
          FROM aligned GROUP BY feature),
tests2 AS (SELECT *, CASE
             WHEN n_ref <= 1000 AND feature_type = 'numerical' AND n_values > 5 THEN 'K-S p_value'
             WHEN n_ref <= 1000 AND n_values > 2 THEN 'chi-square p_value'
             WHEN n_ref <= 1000 THEN 'Z-test p_value'
             WHEN feature_type = 'numerical' AND n_values > 5 THEN 'Wasserstein distance (normed)'
             ELSE 'Jensen-Shannon distance' END AS test_name FROM tests),
ord AS (SELECT a.feature, a.num, a.ref_n, t.mu, t.n_ref,
               sum(a.ref_n) OVER w / t.n_ref AS fr, sum(a.cur_n) OVER w / t.n_cur AS gc,
               lead(a.num) OVER (PARTITION BY a.feature ORDER BY a.num) AS nxt
        FROM aligned a JOIN tests2 t ON a.feature = t.feature
        WHERE a.num IS NOT NULL AND t.test_name IN ('K-S p_value', 'Wasserstein distance (normed)')
        WINDOW w AS (PARTITION BY a.feature ORDER BY a.num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ostat AS (SELECT feature, max(abs(fr - gc)) AS ks_d,
                 sum(abs(fr - gc) * COALESCE(nxt - num, 0)) AS w_area,
                 sum(ref_n * (num - mu) * (num - mu)) / max(n_ref) AS ref_var
          FROM ord GROUP BY feature),
sh AS (SELECT a.*, a.ref_n * t.n_cur / t.n_ref AS e, CAST(a.ref_n AS DOUBLE) / t.n_ref AS p,
              CAST(a.cur_n AS DOUBLE) / t.n_cur AS q,
              row_number() OVER (PARTITION BY a.feature ORDER BY a.num, a.cat) AS rk
       FROM aligned a JOIN tests2 t ON a.feature = t.feature),
sstat AS (SELECT feature,
                 sum(CASE WHEN e > 0 THEN (cur_n - e) * (cur_n - e) / e ELSE 0 END) AS chi_sum,
                 max(CASE WHEN e = 0 AND cur_n > 0 THEN 1 ELSE 0 END) AS unseen,
                 sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) / 2
                 + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js_div,
                 max(CASE WHEN rk = 1 THEN ref_n END) AS low_ref, max(CASE WHEN rk = 1 THEN cur_n END) AS low_cur
          FROM sh GROUP BY feature),
st0 AS (SELECT t.*, o.ks_d, o.w_area, o.ref_var, s.chi_sum, s.unseen, s.js_div,
               CAST(s.low_ref AS DOUBLE) / t.n_ref AS p1, CAST(s.low_cur AS DOUBLE) / t.n_cur AS p2,
               CAST(s.low_ref + s.low_cur AS DOUBLE) / (t.n_ref + t.n_cur) AS pooled
        FROM tests2 t LEFT JOIN ostat o ON t.feature = o.feature LEFT JOIN sstat s ON t.feature = s.feature),
st1 AS (SELECT *, sqrt(pooled * (1 - pooled) * (1.0 / n_ref + 1.0 / n_cur)) AS se FROM st0),
stats AS (SELECT feature, feature_type, test_name, n_ref, n_cur, n_values,
                 CASE test_name
                   WHEN 'K-S p_value' THEN ks_d
                   WHEN 'Wasserstein distance (normed)' THEN w_area / greatest(sqrt(ref_var), 0.001)
                   WHEN 'chi-square p_value' THEN CASE WHEN unseen = 1 THEN 'inf'::DOUBLE ELSE chi_sum END
                   WHEN 'Z-test p_value' THEN CASE WHEN n_values <= 1 OR se = 0 THEN 0.0 ELSE (p1 - p2) / se END
                   ELSE sqrt(greatest(js_div, 0)) END AS statistic,
                 CASE WHEN test_name = 'chi-square p_value' THEN n_values - 1 END AS dof
          FROM st1),
pv AS (SELECT *,
         CASE WHEN test_name = 'K-S p_value' THEN statistic * sqrt(CAST(n_ref AS DOUBLE) * n_cur / (n_ref + n_cur)) END AS lam,
         CASE WHEN test_name = 'chi-square p_value' THEN dof / 2.0 WHEN test_name = 'Z-test p_value' THEN 0.5 END AS ga,
         CASE WHEN test_name = 'chi-square p_value' THEN statistic / 2.0
              WHEN test_name = 'Z-test p_value' THEN statistic * statistic / 2.0 END AS gx
       FROM stats),
pv2 AS (SELECT *,
         CASE WHEN test_name = 'K-S p_value' THEN
              CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * (
                  SELECT sum(CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))
                  FROM range(1, 101) r(k)))) END
              WHEN ga IS NOT NULL THEN
              CASE WHEN isinf(gx) THEN 0.0 WHEN gx <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1.0 - (
                  SELECT sum(exp(ga * ln(gx) - gx + k * ln(gx) - lgamma(ga + k + 1)))
                  FROM range(0, 20000) r(k)))) END
         END AS p_value
       FROM pv),
feats AS (SELECT feature, CAST(CASE feature {pos} END AS INTEGER) AS position, feature_type, test_name,
                 CASE WHEN test_name IN ('K-S p_value', 'chi-square p_value', 'Z-test p_value')
                      THEN 'p_value' ELSE 'distance' END AS score_kind,
                 n_ref, n_cur, n_values, statistic, p_value,
                 CASE WHEN test_name IN ('K-S p_value', 'chi-square p_value', 'Z-test p_value')
                      THEN p_value ELSE statistic END AS drift_score,
                 CASE WHEN test_name IN ('K-S p_value', 'chi-square p_value', 'Z-test p_value')
                      THEN p_value < 0.05 ELSE statistic >= 0.1 END AS drift_detected, dof
          FROM pv2)"""
