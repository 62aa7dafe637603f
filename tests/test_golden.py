"""Small cases with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidebar.functions import scalar as S
from tidebar.operators import leakage, orders, outcomes, series, structure, trades
from tidebar.streaming.bars import tip_gate

H = 3_600_000
T0 = 1_700_000_000_000 // H * H


def bars_df(spark, rows, timeframe="1h", step=H, t0=0):
    data = [("s", "X", timeframe, t0 + i * step, *map(float, r), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "source string, symbol string, timeframe string, ts_ms long, open double, high double, low double, close double, volume double, ingest_seq long")


def test_resample_first_and_last(spark):
    b = bars_df(spark, [(i, i, i, i, 1) for i in range(8)])
    out = series.resample(b, "4h").orderBy("ts_ms").collect()
    assert [(r.open, r.close, r.volume, r.n_children) for r in out] == [(0, 3, 4, 4), (4, 7, 4, 4)]


def test_higher_timeframes_of_eight_days(spark):
    b = spark.range(8 * 1440).select(F.lit("s").alias("source"), F.lit("X").alias("symbol"), F.lit("1m").alias("timeframe"), (F.col("id") * 60_000).alias("ts_ms"), *[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume")])
    n = {r.timeframe: r["count"] for r in series.derive_higher(b).groupBy("timeframe").count().collect()}
    assert n["1h"] == 192 and n["4h"] == 48 and n["1d"] == 8 and n["1w"] >= 1


def test_forming_and_junk(spark):
    b = bars_df(spark, [(100, 101, 99, 100.5, 5), (100, 100, 100, 100, 0), (1, 2, 0.5, float("nan"), 1)], t0=T0)
    assert [r.ts_ms for r in series.drop_forming(b, F.lit(T0 + 2 * H + H // 2)).orderBy("ts_ms").collect()] == [T0, T0 + H]
    assert sorted(r.ingest_seq for r in series.drop_junk(b).collect()) == [0, 2]


def test_gap_and_repair(spark):
    full = bars_df(spark, [(100, 101, 99, 100, 1)] * 10)
    holey = full.where("ingest_seq NOT IN (4, 5, 6)")
    gap = series.gaps(holey, H).collect()
    assert len(gap) == 1 and gap[0].missing == 3
    assert series.repair_gaps(holey, full, H).count() == 3
    assert series.repair_gaps(holey, full.withColumn("close", F.lit(200.0)), H).count() == 0


def test_violations_fail_when_read(spark):
    bad = bars_df(spark, [(1, 2, 0.5, 1, 1), (1, 0.9, 0.5, 1, 1)])
    assert [r.rule for r in series.violations(bad).collect()] == ["high_below_body"]
    with pytest.raises(Exception, match="high_below_body"):
        series.check_bars(bad).collect()


def test_fibonacci(spark):
    row = spark.range(1).select(*[S.fib_price(F.lit(100.0), F.lit(200.0), r).alias(str(i)) for i, r in enumerate((0.0, 1.0, 0.618, 1.618))], S.nearest_ratio(S.retracement(F.lit(100.0), F.lit(200.0), F.lit(138.2))).alias("n")).first()
    assert row[0] == 200 and row[1] == 100 and math.isclose(row[2], 138.2) and math.isclose(row[3], 261.8) and row.n == "0.618"


def test_profit_factor_and_wilson(spark):
    rows = [("a", p) for p in (10.0, -5.0, 1.0, -10.0)] + [("b", p) for p in (1000.0, -0.01)] + [("c", p) for p in (1.0, 2.0, 3.0)]
    out = {r.k: r for r in trades.distribution(spark.createDataFrame(rows, "k string, pnl double"), ["k"]).collect()}
    assert math.isclose(out["a"].profit_factor, 0.7333333333333333, abs_tol=1e-9) and out["a"].win_rate == 0.5
    assert math.isclose(out["b"].profit_factor, 100000.0, rel_tol=1e-9)
    assert math.isinf(out["c"].profit_factor) and math.isclose(out["c"].wilson_lo, 0.43849391955098227, abs_tol=1e-9) and math.isclose(out["c"].wilson_hi, 1.0, abs_tol=1e-9)


def test_drawdown(spark):
    e = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((100, 120, 90, 95, 130))], "k string, i int, equity double")
    r = trades.drawdown(e, ["k"], ["i"]).first()
    assert (r.magnitude, r.fraction, r.duration) == (30.0, 0.25, 2)


def test_sharpe(spark):
    data = {"a": (0.01, -0.01, 0.02, 0.0), "b": (0.01, 0.01, 0.01), "c": (0.02, 0.015, 0.01, -0.01, -0.015, -0.005, 0.02, 0.018, 0.012, -0.012, -0.014, -0.006)}
    r = spark.createDataFrame([(k, i, x) for k, v in data.items() for i, x in enumerate(v)], "k string, day_ms int, r double")
    out = {x.k: x for x in trades.sharpe(r, ["k"]).collect()}
    assert math.isclose(out["a"].sharpe, 0.3872983346207417, abs_tol=1e-9) and math.isclose(out["a"].sharpe_annual, 7.399324293474371, abs_tol=1e-9)
    assert out["b"].sharpe is None or abs(out["b"].sharpe) > 1e10  # no dispersion up to rounding
    h = {x.k: x for x in trades.hac_sharpe(r, ["k"]).collect()}["c"]
    assert h.lag == 2 and math.isclose(h.sharpe_hac, 0.16559514202984144, abs_tol=1e-9)
    assert math.isclose(out["c"].sharpe, 0.19321777594723227, abs_tol=1e-9)


def test_concurrency(spark):
    t = spark.createDataFrame([("a", 1, 0, 10), ("a", 1, 5, 15), ("a", -1, 20, 30)], "k string, side int, entry_ts_ms long, exit_ts_ms long")
    r = trades.concurrency(t, ["k"]).first()
    assert (r.max_total, r.max_long, r.max_short) == (2, 2, 1)
    assert math.isclose(r.avg_total, 1.0) and math.isclose(r.avg_long, 20 / 30) and math.isclose(r.avg_short, 10 / 30)


def test_round_trip_of_three_legs(spark):
    t = spark.createDataFrame([("SOL", 1, 103.74, 0.1, 0.0848, 1000 + i, i) for i in range(3)] + [("SOL", 1, None, 1.0, 1.0, 5000, 9)], "symbol string, side int, entry_price double, qty double, pnl double, exit_ts_ms long, trade_id long")
    out = sorted(trades.round_trips(t, ["symbol"]).collect(), key=lambda r: r.leg_count)
    assert [r.leg_count for r in out] == [1, 3] and math.isclose(out[1].qty, 0.3)


def test_leaderboard(spark):
    rows = [("few", float("inf"), 2, 9.0), ("many", float("inf"), 6, 1.0), ("finite", 1.5, 4, 1.0), ("none", None, 0, 0.0)]
    out = trades.ranked(spark.createDataFrame(rows, "k string, profit_factor double, n_trades int, realized_pnl double"), ["k"]).orderBy("place").collect()
    assert [r.k for r in out] == ["many", "finite", "few", "none"]


def barrier(spark, rows, **kw):
    b = bars_df(spark, [(*r, 1) for r in rows], "1m", 60_000)
    e = spark.createDataFrame([(1, "X", 1, 1, 100.0, 95.0, 110.0)], "signal_id int, symbol string, side int, entry_i int, entry_open double, stop double, target double")
    return outcomes.first_barrier(e, b.drop("volume"), ["symbol"], kw.pop("hold", 5), **kw).first()


def test_first_barrier(spark):
    flat = (100, 101, 99, 100)
    r = barrier(spark, [flat, flat, (90, 91, 89, 90)])
    assert (r.reason, r.exit_price) == ("stop", 90.0)
    r = barrier(spark, [flat, flat, (100, 111, 94, 100)])
    assert (r.reason, r.exit_price, r.ambiguous) == ("stop", 95.0, True)
    r = barrier(spark, [flat, flat, (100, 111, 94, 100)], same_bar="favourable")
    assert (r.reason, r.exit_price) == ("target", 110.0)
    r = barrier(spark, [flat, flat, flat, (100.5, 101, 99, 100)], hold=2)
    assert (r.reason, r.exit_price, r.hold_bars) == ("max_hold", 100.5, 2)
    r = barrier(spark, [flat, (100, 111, 99, 100)])
    assert (r.reason, r.exit_price, r.hold_bars) == ("target", 110.0, 0)


def test_funding(spark):
    hold = spark.createDataFrame([(1, "X", 1, 1.0, 60_000, 200_000)], "trade_id int, symbol string, side int, qty double, entry_ts_ms long, exit_ts_ms long")
    st = spark.createDataFrame([("X", 120_000, 0.001), ("X", 180_000, 0.001)], "symbol string, ts_ms long, rate double")
    b = bars_df(spark, [(100, 100, 100, 100, 1)] * 5, "1m", 60_000)
    out = outcomes.funding(hold, st, b, 200_000).collect()
    assert len(out) == 2 and math.isclose(sum(r.charge for r in out), -0.2)
    with pytest.raises(ValueError, match="repeat"):
        outcomes.funding(hold, st.union(st), b, 200_000)


def test_tip_gate(spark):
    server, step = 1_704_067_620_000, 900_000
    want = server // step * step - step
    rows = [(want, 0, "PASS"), (want - step, 0, "CANDLE_STALE"), (want + step, 0, "CANDLE_AHEAD"), (want, 60_000, "CLOCK_SKEW"), (None, 0, "CANDLE_MISSING")]
    df = spark.createDataFrame([("15m", t, server + o, server, server + o, c) for t, o, c in rows], "timeframe string, tip_ms long, before_ms long, server_ms long, after_ms long, want string")
    assert all(r.code == r.want for r in tip_gate(df).collect())


def test_order_checks_keep_their_order(spark):
    o = spark.createDataFrame([(0.4, 10.0, 9.0, 100.0, 0.5, 6.0, 1.0, 0.25), (0.4, 10.0, 9.0, 10.0, 0.5, 6.0, 1.0, 0.25)], "raw_qty double, price double, stop_price double, equity double, min_qty double, max_qty double, min_notional double, qty_step double")
    assert [r.skip for r in orders.normalise_order(o, 0.01).collect()] == ["below_min_qty", "min_qty_exceeds_risk_cap"]


def wavy(spark, n=400):
    data = [(T0 + i * H, 100 + 8 * math.sin(i / 9) + 3 * math.sin(i / 2.3) + i * 0.01) for i in range(n)]
    return spark.createDataFrame(data, "ts_ms long, close double").select(F.lit("X").alias("symbol"), "ts_ms", F.col("close").alias("open"), (F.col("close") + 0.5).alias("high"), (F.col("close") - 0.5).alias("low"), "close")


def test_features_do_not_look_ahead(spark):
    b = wavy(spark)
    build = lambda x: structure.bar_features(x, keys=["symbol"])
    assert leakage.prefix_invariance(b, build, ["symbol"], cuts=(0.8,)).count() == 0
    s = structure.swings(b, keys=["symbol"])
    assert s.count() >= 4 and s.where("confirm_i <> pivot_i + 2").count() == 0
    assert build(b).where("last_retrace_pct IS NOT NULL").count() > 0


def test_leaks_are_caught(spark):
    from pyspark.sql import Window

    b = wavy(spark).withColumn("volume", F.lit(1.0))
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    leaky = lambda x: x.select("symbol", "ts_ms", F.lead("close").over(w).alias("target_close"), (F.col("close") / F.lag("close").over(w) - 1).alias("ret_1"))
    found = {(r.check, r.column) for r in leakage.audit(b, leaky, ["symbol"], [1]).collect() if r.severity == "HARD"}
    assert {("prefix_invariance", "target_close"), ("future_mutation", "target_close"), ("name_scan", "target_close"), ("streaming_tip", "*")} <= found
    assert not any(c == "ret_1" for k, c in found if k != "forward_corr")
    with pytest.raises(ValueError, match="future_close"):
        leakage.refuse(["future_close", "ret_1"], spark.createDataFrame([("future_close",)], "column string"))


def test_round_trips_of_one_hot_price(spark):
    day = 86_400_000
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, day // 2, 2 * day, 9 * day if i % 200 == 0 else day])
        rows.append((i, "X", 1, 100.0, 1.0, 1.0, t))
    want, first = {}, None
    for i, *_, at in rows:
        if first is None or at - first > 7 * day:
            first = at
        want[first] = want.get(first, 0) + 1
    df = spark.createDataFrame(rows, "trade_id long, symbol string, side int, entry_price double, qty double, pnl double, exit_ts_ms long").repartition(4)
    assert {r.first_ts_ms: r.leg_count for r in trades.round_trips(df, ["symbol"]).collect()} == want


def test_bar_features_read_events_in_one_window(spark):
    rows = [("X", i * 3_600_000, 10.0 + (i * 7) % 13, 9.0 + (i * 5) % 11, 9.5 + (i * 3) % 7) for i in range(80)]
    b = spark.createDataFrame(rows, "symbol string, ts_ms long, high double, low double, close double")
    plan = structure.bar_features(b, keys=["symbol"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("last(_retrace") == 1 and plan.count("last(_leg") == 1
