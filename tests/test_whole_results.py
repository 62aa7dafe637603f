"""Queries that list every account, position and run, against DuckDB without subset or limit."""

import duckdb
import pytest

from tests.test_queries import QUERIES, SF, norm
from tidebar.plans.views import TRADES

WHOLE = {
    "srt09_positions_by_pnl": f"WITH {TRADES} SELECT trade_id, account, pnl FROM trades",
    "src19_srt08_run_listing": "SELECT l_suppkey % 7 AS strategy_id, l_suppkey AS run_id, count(*) AS trades, max(epoch_us(l_shipdate) // 1000) AS newest_ms FROM lineitem GROUP BY ALL",
    "wn16_step_equity": f"""WITH {TRADES}, eq AS (SELECT account, trade_id, exit_ts_ms, round(sum(pnl) OVER (PARTITION BY account ORDER BY exit_ts_ms, trade_id ROWS UNBOUNDED PRECEDING), 4) AS equity FROM trades),
 l AS (SELECT account, exit_ts_ms, last(equity ORDER BY trade_id) AS equity FROM eq GROUP BY ALL),
 g AS (SELECT account, unnest(generate_series((min(entry_ts_ms) // 86400000) * 86400000, (max(exit_ts_ms) // 86400000) * 86400000, 86400000)) AS ts_ms FROM trades GROUP BY account)
 SELECT g.account, g.ts_ms, round(coalesce(l.equity, 0), 4) AS equity FROM g ASOF LEFT JOIN l ON g.account = l.account AND g.ts_ms >= l.exit_ts_ms""",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_nothing_is_left_out(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out = con.execute(WHOLE[name])
    cols = [d[0] for d in out.description]
    want = sorted(tuple(map(norm, r)) for r in out.fetchall())
    got = sorted(tuple(norm(r[c]) for c in cols) for r in QUERIES[name](spark, SF).collect())
    print(name, len(want))
    assert got == want
