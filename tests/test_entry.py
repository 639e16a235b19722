import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver runs them all.
NAMES = [
    "t3_wip_series",
    "t7_open_backlog",
    "a6_monthly_interval_stats",
    "j7_caseload_extract",
    "q2_spearman",
    "q17_km_quantiles",
    "k4_k_anonymise",
    "w7_lag_corr",
    "p2_parse_date",
    "t11_stop_flow",
]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        f = lambda v: "" if pd.isna(v) else f"{float(v):.4f}" if isinstance(v, (int, float, bool)) or hasattr(v, "dtype") and v.dtype.kind in "ifb" else str(v)[:10]
        return sorted(tuple(f(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())

    assert rows(got) == rows(want)
