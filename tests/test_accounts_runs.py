import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import ORACLE, QUERIES, SF, norm
from tidebar.operators import accounts as ac, orders as od, runs as ru, series, trades as tr

NAMES = [
    "ag06_ingest_plan", "pf11_open_positions", "pf15_limit_entries", "pf16_maintenance", "ag15_exposure", "pf12_closed_rows", "ag26_merged_accounts", "ag25_fleet", "ag26_merged_trades", "ag27_pair_rows",
    "ag22_run_totals", "src19_run_catalog", "snk12_report_folders", "src06_landed_archive", "src20_log_lines", "src21_instruments",
]


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    out = con.execute(ORACLE[name])
    at = [[d[0] for d in out.description].index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in out.fetchall())
    assert want and sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_merged_accounts(spark):
    rows = [
        ("a", 1, "h1", ["x", "y"], 5.0, 10), ("a", 2, "h2", ["y", "z"], 5.0, None), ("a", 3, "h1", None, 4.0, 30),
        ("b", 1, None, [], None, 1), ("b", 2, "h2", ["q"], None, 2), ("", 1, "h", ["q"], 1.0, 1), (None, 1, "h", ["q"], 1.0, 1),
    ]
    snaps = spark.createDataFrame(rows, "account string, snap_seq int, host string, bots array<string>, equity double, n_open int")
    got = {r.account: (r.hosts, r.bots, r.equity, r.n_open) for r in ac.merge_accounts(snaps, ["n_open"]).collect()}
    assert got == {"a": (["h1", "h2"], ["x", "y", "z"], 5.0, 10), "b": (["h2"], ["q"], None, 2)}
    none = ac.fleet_totals(spark.createDataFrame([], "n_trades long, n_open long, realized_pnl double, open_upl double, equity double")).first()
    assert none.n_accounts == 0 and none.equity == 0 and none.combined == 0


def test_merged_trades_and_pairs(spark):
    t = spark.createDataFrame([("a", "o1", 1, "X", None, 2, "two"), ("a", "o1", 1, "X", None, 1, "one"), ("a", "o1", 1, "X", 2.0, 2, "two"), ("b", "o1", 1, "X", None, 2, "two")], "account string, order_id string, updated_ms long, symbol string, pnl double, snap_seq int, host string")
    assert sorted((r.account, str(r.pnl), r.host) for r in ac.merge_trades(t).collect()) == [("a", "2.0", "two"), ("a", "None", "one"), ("b", "None", "two")]
    coins = spark.createDataFrame([("h", "a", "x", 4, 8.0), ("h", "a", "y", 0, 8.0), ("h", "b", "x", 3, None), ("h", "c", "x", 1, 0.0)], "host string, account string, symbol string, n_trades long, days_active double")
    bots = spark.createDataFrame([("h", "a", "1", "One"), ("h", "a", "2", None), ("h", "b", "3", None)], "host string, account string, bot string, label string")
    given = spark.createDataFrame([("h", "a", "1", "X"), ("h", "a", "2", "x"), ("h", "a", "1", "X")], "host string, account string, bot string, symbol string")
    got = sorted((r.account, r.symbol, str(r.bot), r.label, r.trades_per_day) for r in ac.pair_rows(coins, bots, given).collect())
    assert got == [("a", "X", "1", "One", 0.5), ("a", "X", "2", "2", 0.5), ("b", "X", "3", "3", None), ("c", "X", "None", ac.NONE, None)]


def test_normalised_trades_takes_the_first_name(spark):
    bodies = [{"symbol": "x", "qty": 0, "closedSize": "2", "updatedTime": "0", "createdTime": "7", "closedPnl": 0, "pnl": 5}, {"order_id": "q", "updatedTime": "", "created_ms": 9, "openFee": "0", "cumEntryFee": "1"}]
    rows = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("no json",), (None,)], "body string")
    got = [(r.symbol, r.qty, r.closed_size, r.updated_ms, r.created_ms, r.pnl, r.open_fee, r.leg_count) for r in ac.normalised_trades(rows).collect()]
    assert got == [("X", 0.0, 2.0, None, 7, 0.0, None, 1), ("", None, None, 9, 9, None, 1.0, 1), ("", None, None, None, None, None, None, 1), ("", None, None, None, None, None, None, 1)]
    assert len(ac.normalised_trades(rows).columns) == 17


def test_positions_by_side(spark):
    p = spark.createDataFrame([(1, 100.0, 110.0, 95.0, 0, 5), (-1, 100.0, 90.0, 105.0, 3, 5), (1, 0.0, 110.0, None, None, None)], "side int, mark_price double, take_profit double, stop_loss double, open_time long, opened_at_ms long").withColumn("entry_price", F.lit(100.0))
    assert [(r.tp_pct, r.sl_pct, r.nearer, r.opened_ms) for r in od.position_view(p).collect()] == [(10.0, 5.0, "sl", 5), (10.0, 5.0, "sl", 3), (10.0, None, "tp", None)]


def test_ingest_plan_by_age(spark):
    hour, day = 3_600_000, 86_400_000
    rows = [(tf, t) for tf, last in (("1m", 98), ("1h", 93), ("1d", 61), ("3h", 75)) for t in (0, last * hour)] + [("4h", 8 * day)]
    bars = spark.createDataFrame([("s", "X", tf, t) for tf, t in rows], "source string, symbol string, timeframe string, ts_ms long")
    got = {r.timeframe: (r.action, r.start_ms) for r in series.ingest_plan(bars, F.lit(100 * hour), F.lit(0)).collect()}
    assert got == {"1m": ("skip", None), "1h": ("append", 93 * hour - 5 * day), "1d": ("skip", None), "3h": ("append", 75 * hour - 5 * day), "4h": ("restart", 0)}


def test_exposure(spark):
    t = spark.createDataFrame([("a", 10, 30), ("a", 20, 40), ("a", 50, 50)], "k string, entry_ts_ms long, exit_ts_ms long")
    grid = spark.createDataFrame([("a", x) for x in (0, 10, 30, 40, 50)] + [("b", 0)], "k string, ts_ms long")
    assert {r.k: r.exposure for r in tr.exposure(t, grid, ["k"]).collect()} == {"a": 0.4, "b": 0.0}


def test_only_saved_runs_are_replaced(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    make = lambda rows, schema: spark.createDataFrame(rows, f"strategy_id long, run_id long, {schema}")
    none = make([], "symbol string, ts_ms long")

    def save(run, pnls, eq):
        trades = make([(1, run, i, "X", p, i) for i, p in enumerate(pnls)], "trade_id long, symbol string, pnl double, exit_ts_ms long")
        curve = make([(1, run, i, i, e) for i, e in enumerate(eq)], "trade_id long, ts_ms long, equity double")
        ru.save_runs(root, make([(1, run, 100.0)], "starting_equity double"), trades, curve, none)

    save(1, [1.0, 2.0], [101.0, 103.0])
    save(2, [], [])
    save(1, [5.0], [105.0])
    keys = "strategy_id long, run_id long"
    read = lambda n, s: ru.stored(spark, root, n, f"{s}, {keys}")
    got = ru.listing(ru.catalog(read("runs", "starting_equity double"), read("trades", "trade_id long, symbol string, pnl double, exit_ts_ms long"), read("equity", "trade_id long, ts_ms long, equity double"))).collect()
    assert [(r.run_id, r.n_trades, r.net, r.ending_equity, r.symbol) for r in got] == [(1, 1, 5.0, 105.0, "X"), (2, 0, 0.0, 100.0, None)]
    with pytest.raises(ValueError):
        ru.stored(spark, root, "other", keys)


def test_runs_are_ranges_of_rows_in_few_folders(spark, tmp_path):
    root, n = f"file://{tmp_path}/many", 300
    runs = spark.range(n).select((F.col("id") % 7).alias("strategy_id"), F.col("id").alias("run_id"), F.lit(1.0).alias("starting_equity"))
    trades = runs.select("strategy_id", "run_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("trade_id"), F.lit(2.0).alias("pnl"))
    curve = runs.select("strategy_id", "run_id", F.lit(1.0).alias("equity"))
    bars = spark.createDataFrame([("X", 1, 1.0)], "symbol string, ts_ms long, close double")
    ru.save_runs(root, runs, trades, curve, bars, buckets=8)
    assert len(list((tmp_path / "many/trades").glob("bucket_=*"))) == 8
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "many/trades").rglob("*.parquet")}
    ru.save_runs(root, runs.where("run_id = 5"), trades.where("run_id = 5 AND trade_id = 1"), curve.where("false"), bars, buckets=8)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "many/trades").rglob("*.parquet")}
    assert len({p.parent for p in set(before) ^ set(after)}) == 1
    schema = "strategy_id long, run_id long, trade_id long, pnl double"
    own = ru.one_run(spark, root, "trades", schema, 5, 5, buckets=8)
    assert own.count() == 1 and ru.stored(spark, root, "trades", schema).count() == 2 * n - 1
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "bucket_" in plan[plan.index("PartitionFilters:") :].split("PushedFilters")[0] and "EqualTo(run_id,5)" in plan
    assert ru.stored(spark, root, "equity", "strategy_id long, run_id long, equity double").count() == n - 1
    assert ru.stored(spark, root, "bars", "symbol string, ts_ms long, close double").count() == 1


def test_reports_hold_infinities_as_text(spark, tmp_path):
    root = f"file://{tmp_path}/reports"
    m = spark.createDataFrame([(1, 1, float("inf")), (1, 2, float("nan")), (1, 3, 1.5)], "strategy_id long, run_id long, pf double")
    t = spark.createDataFrame([(1, 1, 'a "quoted", text', 2.5)], "strategy_id long, run_id long, note string, pnl double")
    ru.write_reports(root, t, t, m)
    assert {r.run_id: r.pf for r in spark.read.schema("pf string, strategy_id long, run_id long").json(f"{root}/metrics").collect()} == {1: "inf", 2: None, 3: "1.5"}
    one = list((tmp_path / "reports/trades/strategy_id=1/run_id=1").glob("*.csv"))
    assert len(one) == 1 and one[0].read_text().splitlines()[0] == "note,pnl"


def test_reports_of_many_runs_share_folders(spark, tmp_path):
    root, n = f"file://{tmp_path}/many", 200
    runs = spark.range(n).select((F.col("id") % 7).alias("strategy_id"), F.col("id").alias("run_id"))
    t = runs.select(F.lit('a "b", c').alias("note"), F.when(F.col("run_id") == 5, float("inf")).otherwise(2.5).alias("pnl"), *ru.KEY)
    ru.write_reports(root, t, t, t.drop("note"), buckets=8)
    for name, kind in (("trades", "csv"), ("equity", "csv"), ("metrics", "json")):
        assert 1 < len(list((tmp_path / "many" / name).rglob(f"*.{kind}"))) <= 16, name
    keys = "strategy_id long, run_id long"
    assert ru.reports(spark, root, "trades", f"note string, pnl double, {keys}").select("run_id").distinct().count() == n
    own = ru.one_report(spark, root, "equity", f"note string, pnl double, {keys}", 5, 5, buckets=8)
    assert [tuple(r) for r in own.collect()] == [('a "b", c', float("inf"), 5, 5)]
    assert ru.one_report(spark, root, "metrics", f"pnl string, {keys}", 5, 5, buckets=8).first().pnl == "inf"
    assert "bucket_" in own._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_step_exposure_equals_a_grid(spark):
    rng = random.Random(6)
    data = [(rng.choice("ab"), t, t + rng.choice((0, 3, 10, 25, 90))) for t in (rng.randrange(3, 900) for _ in range(60))] + [("a", 40, 40), ("c", 20, 20), ("d", 21, 22), ("e", 17, 20)]
    t = spark.createDataFrame(data, "k string, entry_ts_ms long, exit_ts_ms long")
    grid = t.groupBy("k").agg((F.floor(F.min("entry_ts_ms") / 10) * 10).alias("a"), F.max("exit_ts_ms").alias("z")).select("k", F.explode(F.sequence("a", "z", F.lit(10).cast("long"))).alias("ts_ms"))
    got = tr.step_exposure(t, ["k"], 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tr.exposure(t, grid, ["k"]).collect()))
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_tier_and_a_skip_cost_no_task_a_symbol(spark):
    plan = lambda n: QUERIES[n](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for n in ("pf16_maintenance", "jn20_tier_lookup"):
        assert "strategy=broadcast" in plan(n) and plan(n).count("Join") == 2, n
    assert not [line for line in plan("ag20_skip_counts").split("\n") if "Filter" in line and "qty_rounds_to_zero" in line]


def test_stored_strategies_are_split(spark):
    from tidebar.plans import stores

    made = []
    frame = type(spark.range(1))
    hint, repartition = frame.hint, frame.repartition
    with pytest.MonkeyPatch.context() as m:
        m.setattr(frame, "hint", lambda self, *a: made.append(a) or hint(self, *a))
        m.setattr(frame, "repartition", lambda self, *a: made.append(a) or repartition(self, *a))
        assert stores and QUERIES["snk11_snk12_run_store"](spark, SF).count() > 0
    assert made == [("rebalance", "strategy_id")]


def test_equity_is_made_of_the_stored_trades(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    make = lambda rows, schema: spark.createDataFrame(rows, f"strategy_id long, run_id long, {schema}")
    seen = []

    def curve(t):
        seen.append((sorted((r.run_id, r.pnl) for r in t.collect()), t.inputFiles()))
        return tr.equity_curve(t, ru.KEY, ["trade_id"]).select(*ru.KEY, "equity")

    for runs, pnls in (([1, 2], [(1, 1, 1, 2.0), (1, 1, 2, 3.0), (1, 2, 1, 4.0)]), ([2], [(1, 2, 1, 9.0)])):
        ru.save_runs(root, make([(1, r, 1.0) for r in runs], "starting_equity double"), make(pnls, "trade_id long, pnl double"), curve, make([], "symbol string, ts_ms long"), buckets=4)
    assert [s[0] for s in seen] == [[(1, 2.0), (1, 3.0), (2, 4.0)], [(2, 9.0)]] and all("/runs/trades/" in f for f in seen[0][1] if "saved-runs" not in f)
    assert sorted((r.run_id, r.equity) for r in ru.stored(spark, root, "equity", "equity double, strategy_id long, run_id long").collect()) == [(1, 2.0), (1, 5.0), (2, 9.0)]
