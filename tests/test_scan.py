import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidebar.operators import structure as st
from tidebar.operators import trades as tr
from tidebar.operators.parity import diff_trades, newest_decision
from tidebar.operators.scan import block_scan, global_rank
from tidebar.operators.series import gaps


def rows(spark, n=600):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.randrange(0, 5000), i, None if rng.random() < 0.2 else float(rng.randrange(-5, 6))) for i in range(n)] + [("only", 7, -1, 1.0), ("null", 7, -2, None)]
    return spark.createDataFrame(data, "k string, t long, i long, v double").repartition(4)


def test_block_scan_equals_whole_windows(spark):
    df = rows(spark)
    v = F.col("v")
    got = block_scan(df, ["k"], "t", ["i"], 700, {"s": ("sum", v), "hi": ("max", v), "lo": ("min", v), "last_": ("last", v), "before": ("lag", v), "after": ("lead", v)})
    w = Window.partitionBy("k").orderBy("t", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum(v).over(upto).alias("s"), F.max(v).over(upto).alias("hi"), F.min(v).over(upto).alias("lo"), F.last(v, True).over(upto).alias("last_"), F.lag(v).over(w).alias("before"), F.lead(v).over(w).alias("after"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert block_scan(df.where("false"), ["k"], "t", ["i"], 700, {"s": ("sum", v)}).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in line for line in plan.split("\n") if line.strip(" +-:*").startswith("Window"))


def test_operators_in_blocks_equal_whole_series(spark):
    df = rows(spark).withColumn("v", F.coalesce("v", F.lit(0.0)))
    key = lambda d: sorted(map(str, d.select(*sorted(d.columns)).collect()))
    e = tr.equity_curve(df, ["k"], ["t", "i"], "v")
    assert key(e) == key(tr.equity_curve(df, ["k"], ["t", "i"], "v", 300))
    for f in (lambda b: tr.drawdown(e, ["k"], ["t", "i"], block_ms=b), lambda b: tr.streaks(df, ["k"], ["t", "i"], "v", b), lambda b: gaps(df.select("k", F.col("t").alias("ts_ms")).distinct(), 10, ["k"], b)):
        assert key(f(None)) == key(f(300))
    swings = df.select("k", F.col("i").alias("swing_id"), F.when(F.col("v") > 0, "high").otherwise("low").alias("kind"), F.col("v").alias("price"), F.col("i").alias("pivot_i"), F.col("i").alias("pivot_ts_ms"), (F.col("i") * 10).alias("confirm_ts_ms")).where("swing_id >= 0")
    assert key(st.label_events(swings, ["k"])) == key(st.label_events(swings, ["k"], 500))


def test_global_rank(spark):
    df = rows(spark)
    got = global_rank(df, [F.desc("v"), F.col("i")])
    want = df.withColumn("place", F.row_number().over(Window.orderBy(F.desc("v"), "i")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "place" in global_rank(df.where("false"), [F.col("i")]).columns


@pytest.mark.parametrize("block_ms", [500, 10**9])
def test_tolerance_match_equals_a_loop(spark, block_ms):
    rng = random.Random(8)
    sides = [[(i, rng.randrange(0, 20000), float(rng.randrange(3))) for i in range(400)] for _ in range(2)]
    frames = [spark.createDataFrame(s, "trade_id long, entry_ts_ms long, qty double").repartition(3) for s in sides]
    got = {(r.left_id, r.right_id, r.outcome) for r in diff_trades(*frames, ["qty"], window_ms=25, block_ms=block_ms).collect()}
    free, want = sorted(sides[1], key=lambda r: (r[1], r[0])), set()
    for i, t, q in sorted(sides[0], key=lambda r: (r[1], r[0])):
        hit = next((r for r in free if abs(r[1] - t) <= 25), None)
        if hit:
            free.remove(hit)
        want.add((i, hit[0] if hit else None, "only_left" if not hit else "qty" if abs(hit[2] - q) > 1e-9 else "same"))
    want |= {(None, r[0], "only_right") for r in free}
    assert got == want


def test_newest_decision_equals_a_loop(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    ps = [(i, pick("X", "Y", "", None), pick("Buy", "Sell", None), pick(None, 1.0, 2.0, 2.00001, 3.0, 9.0)) for i in range(80)]
    ds = [(i, pick("X", "Y", "Z", None), pick("Buy", "Sell", ""), pick(None, 1.0, 2.0, 3.0), pick(0, 5, 6, 7, None)) for i in range(60)]
    got = {(r.position_id, r.decide_id) for r in newest_decision(spark.createDataFrame(ps, "position_id long, symbol string, side string, qty double"), spark.createDataFrame(ds, "decide_id long, symbol string, side string, qty double, bar_ms long")).collect()}
    want = set()
    for i, s, d, q in ps:
        fits = [(-b, float("inf") if n is None else n, j) for j, t, e, n, b in ds if b and (not s or not t or s == t) and (not d or not e or d == e) and (q is None or n is None or q <= n + max(1e-9, abs(n) * 1e-4))]
        want.add((i, min(fits)[2] if fits else None))
    assert got == want
    assert len({d for _, d in got}) > 5


def test_a_null_key_and_a_null_time_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, 1, 2), (None, 50, 3), ("a", None, 4), ("a", 99, 5)], "k string, t long, v int")
    got = block_scan(df, ["k"], "t", ["v"], 10, {"total": ("sum", F.col("v")), "prev": ("lag", F.col("v"))})
    assert sorted(map(tuple, got.where("k IS NULL").collect())) == [(None, 1, 2, 2, None), (None, 50, 3, 5, 2)]
    assert got.count() == 5


def test_newest_decision_sorts_distinct_quantities_in_ranges(spark):
    p = spark.range(400).select(F.col("id").alias("position_id"), F.lit("X").alias("symbol"), F.lit("Buy").alias("side"), (F.col("id") % 4).cast("double").alias("qty"))
    d = spark.range(300).select(F.col("id").alias("decide_id"), F.lit("X").alias("symbol"), F.lit("Buy").alias("side"), (F.col("id") % 3).cast("double").alias("qty"), (F.col("id") % 50 + 1).alias("bar_ms"))
    out = newest_decision(p, d)
    assert {(int(r.qty), r.decide_id, r.bar_ms) for r in out.collect()} == {(0, 99, 50), (1, 49, 50), (2, 149, 50), (3, None, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and out.count() == 400


def test_scans_shuffle_rows_once(spark):
    df = rows(spark).withColumn("v", F.coalesce("v", F.lit(0.0)))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    scan = block_scan(df, ["k"], "t", ["i"], 700, {"s": ("sum", F.col("v")), "before": ("lag", F.col("v")), "hi": ("max_before", F.col("v"))})
    assert "Join" not in plan(scan) and "Join" not in plan(tr.streaks(df, ["k"], ["t", "i"], "v", 300))
    e = tr.equity_curve(df, ["k"], ["t", "i"], "v")
    out = tr.drawdown(e, ["k"], ["t", "i"], block_ms=300)
    assert "Join" not in plan(out) and "_peak" not in plan(out)  # rows are done with, what is left is a table of blocks
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.i: r.m for r in df.withColumn("m", F.max("v").over(w)).collect()}
    assert {r.i: r.hi for r in scan.collect()} == want


def test_runs_go_on_over_block_borders(spark):
    signs = [1, 1, 1, 1, -1, 1, 1, 0, 0, -1, -1, -1, -1, -1, -1, 1]
    df = spark.createDataFrame([("a", i, i, float(s)) for i, s in enumerate(signs)] + [("b", 5, 0, None), ("b", 50, 1, None)], "k string, t long, i long, v double")
    for size in (1, 2, 3, 5, 100, None):
        assert {r.k: (r.wins, r.losses) for r in tr.streaks(df, ["k"], ["t", "i"], "v", size).collect()} == {"a": (4, 6), "b": (0, 0)}, size


def test_step_equity_equals_a_lookup(spark):
    rng = random.Random(9)
    data = [(rng.choice("ab"), rng.randrange(15, 300), i, rng.choice((None, 1.0, 2.5, -3.0))) for i in range(60)] + [("c", 25, 99, 7.0), ("d", 40, 98, 1.0)]
    curve = spark.createDataFrame(data, "k string, t long, i long, equity double")
    ends = {k: (0 if k in "ab" else 20 if k == "c" else 40, max(r[1] for r in data if r[0] == k) // 10 * 10) for k in "abcd"}
    span = spark.createDataFrame([(k, a, z) for k, (a, z) in ends.items()], "k string, a long, z long")
    want = []
    for k, (a, z) in ends.items():
        for t in range(a, z + 1, 10):
            seen = max((r for r in data if r[0] == k and r[1] <= t), key=lambda r: r[1:3], default=None)
            want.append((k, t, (seen[3] if seen else None) or 0.0))
    got = tr.step_equity(curve, span, ["k"], ["t", "i"], 10)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_equity_shares_the_shuffles_of_a_join(spark):
    data = rows(spark).withColumn("v", F.coalesce("v", F.lit(0.0)))
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        joined = data.select("k", "i", "v").join(data.select(F.col("i").alias("j"), "t"), F.col("i") == F.col("j")).select("k", "t", "i", "v")
        out = tr.equity_curve(joined, ["k"], ["t", "i"], "v", 300)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") == 2, plan  # both sides of the join, which rows and blocks are made of
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, tr.equity_curve(data.select("k", "t", "i", "v"), ["k"], ["t", "i"], "v").collect()))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@pytest.mark.parametrize("name", ["ag31_ruin", "wn15_equity_by_symbol"])
def test_account_queries_shuffle_lines_and_orders_once(spark, name):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert plan.count("ReusedExchange") == 2, plan


def test_a_shared_scan_equals_a_written_one(spark):
    df = spark.createDataFrame([("a", 1, 1), (None, 1, 2), (None, 50, 3), ("a", None, 4), ("a", 99, 5), ("b", 5, None)], "k string, t long, v int")
    v = F.col("v")
    scans = {"s": ("sum", v), "hi": ("max", v), "lo": ("min", v), "last_": ("last", v), "before": ("lag", v), "after": ("lead", v), "past": ("max_before", v)}
    for d in (df, df.where("false"), rows(spark).select("k", "t", F.col("i").cast("int").alias("v"))):
        got, want = (sorted(map(str, block_scan(d, ["k"], "t", ["v"], 10, scans, shared=x).collect())) for x in (True, False))
        assert got == want
