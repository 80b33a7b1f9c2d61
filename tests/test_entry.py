"""Driver contract: entry(), queries() and oracle_sql()."""

import duckdb
import pytest

import __spark_entry__ as ENTRY
from modelkeep.sources.tables import TABLES
from tests.conftest import SF_SMALL

CHEAP = ["P5_profile_features", "P12_quality_report", "D11_drift_report", "D11_drift_report_parties",
         "E6_roc_auc_ovr", "R4_leaderboard", "F9_performance_check", "T9_encode_onehot",
         "A2_list_events", "X2_stream_volume"]


def test_entry_runs(spark):
    df = ENTRY.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and {"feature", "drift_detected", "test_name"} <= set(df.columns)


def test_oracle_keys_are_queries():
    assert set(ENTRY.oracle_sql()) <= set(ENTRY.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = ENTRY.queries()[name](spark, SF_SMALL)
    res = con.execute(ENTRY.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)

    def canon(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)
                       for r in rows), key=repr)
    assert canon(sdf.columns, sdf.collect()) == canon(dcols, res.fetchall())
