"""Registered queries against DuckDB on the smallest tables, and that the rest works without the llm folder."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidebar import plans

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = plans.load()
SAMPLE = ["ag01_resample_4h", "wn04_wn05_legs", "jn04_nearest_levels", "ag13_hac_sharpe", "ag21_concurrency", "wn19_round_trips", "jn11_wn20_wn22_first_barrier", "jn01_asof_blocks", "snk02_change_detecting", "src14_macro_pages"]


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


def test_every_query_is_described():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 120
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    out = con.execute(ORACLE[name])
    at = [[d[0] for d in out.description].index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
