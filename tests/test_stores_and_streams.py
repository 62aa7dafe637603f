import itertools
import json

from pyspark.sql import functions as F

from tidebar.operators.upsert import Store
from tidebar.schemas import BARS, KEY, LIVE_BARS, OPEN_INTEREST, conform
from tidebar.sources import files
from tidebar.streaming.bars import closed_frames, online_resample, upsert_stream


def bars(spark, rows):
    return spark.createDataFrame([("s", "X", "1h", t, 1.0, 2.0, 0.5, c, v, i) for i, (t, c, v) in enumerate(rows)], "source string, symbol string, timeframe string, ts_ms long, open double, high double, low double, close double, volume double, seq long")


def test_upserts_are_idempotent(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/bars", KEY, BARS)
    assert store.read().count() == 0
    batch = bars(spark, [(1, 10.0, 1.0), (2, 20.0, None), (2, 21.0, 5.0)])
    for _ in range(2):
        store.upsert(batch, "seq")
    assert [(r.ts_ms, r.close, r.volume) for r in store.scan(symbol="X").collect()] == [(1, 10.0, 1.0), (2, 21.0, 5.0)]
    store.upsert(bars(spark, [(2, 30.0, 1.0)]), "seq")
    assert [r.close for r in store.scan(2, 2, symbol="X").collect()] == [30.0]


def test_coalescing_upsert(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/oi", KEY, OPEN_INTEREST)
    make = lambda rows: conform(spark.createDataFrame([("s", "X", "1h", *r) for r in rows], "source string, symbol string, timeframe string, ts_ms long, oi double, ls_ratio double"), OPEN_INTEREST)
    kept = ["oi_sum", "ls_ratio", "top_ls_ratio", "taker_ratio"]
    store.upsert_coalescing(make([(1, 10.0, 0.5), (2, 12.0, None)]), ["oi", "oi_usd"], kept)
    store.upsert_coalescing(make([(1, 11.0, None)]), ["oi", "oi_usd"], kept)
    assert [(r.ts_ms, r.oi, r.ls_ratio) for r in store.scan().collect()] == [(1, 11.0, 0.5), (2, 12.0, None)]


_sent = itertools.count()


def frame(t, close, closed=True):
    return json.dumps({"e": "kline", "E": next(_sent), "k": {"t": t, "s": "X", "i": "1h", "o": "1", "h": "2", "l": "0.5", "c": str(close), "v": "3", "x": closed}})


def test_stream_keeps_a_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([frame(1, 5), frame(2, 6), frame(3, 7, False), "pong", '{"op":"ack"}']))
    store = Store(spark, f"file://{tmp_path}/live", ["exchange", "symbol", "timeframe"], LIVE_BARS)
    values = ["open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote"]

    def run():
        lines = spark.readStream.text(f"file://{tmp_path}/in").withColumn("arrival", F.get_json_object("value", "$.E").cast("long"))
        frames = closed_frames(lines, keep=("arrival",))
        full = frames.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("quote_volume", "double"), ("trades", "long"), ("taker_buy_base", "double"), ("taker_buy_quote", "double"))])
        upsert_stream(full, store, f"file://{tmp_path}/cp", values, values[5:], "arrival").start().awaitTermination()

    run()
    first = {r.ts_ms: (r.close, r.updated_at_ms) for r in store.read().collect()}
    assert {t: c for t, (c, _) in first.items()} == {1: 5.0, 2: 6.0}
    (tmp_path / "in/b.txt").write_text("\n".join([frame(2, 6), frame(1, 5.5), frame(4, 8)]))
    run()
    second = {r.ts_ms: (r.close, r.updated_at_ms) for r in store.read().collect()}
    assert {t: c for t, (c, _) in second.items()} == {1: 5.5, 2: 6.0, 4: 8.0}
    assert second[2] == first[2] and second[1][1] > first[1][1]
    (tmp_path / "in/c.txt").write_text("\n".join([frame(1, 5), frame(1, 6), frame(2, 7), frame(2, 8), frame(2, 6), frame(2, 8)]))
    run()
    assert {r.ts_ms: r.close for r in store.read().collect()} == {1: 6.0, 2: 8.0, 4: 8.0}


def test_a_key_repeated_in_a_batch_gives_one_row(spark):
    from tidebar.operators.upsert import change_detecting, coalescing

    old = spark.createDataFrame([(1, 5.0, 1)], "k long, v double, at long")
    new = spark.createDataFrame([(1, 6.0, 1), (1, 5.0, 2), (2, None, 4), (2, 9.0, 3)], "k long, v double, seq long")
    now = F.lit(7).cast("long")
    assert sorted(map(tuple, change_detecting(old, new, ["k"], ["v"], [], "at", now, "seq").collect())) == [(1, 5.0, 1), (2, None, 7)]
    assert change_detecting(old, new.drop("seq"), ["k"], ["v"], [], "at", now).count() == 2
    two = new.withColumn("w", F.col("v"))
    assert sorted((r.k, r.v, r.w) for r in coalescing(old.withColumn("w", F.lit(1.0)), two, ["k"], ["v"], ["w"], "seq").collect()) == [(1, 5.0, 5.0), (2, None, 9.0)]


MONTH_MS = 31 * 86_400_000


def test_a_batch_reads_and_writes_only_its_months(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/pruned", KEY, BARS)
    rows = [("s", x, "1h", t, 1.0, 1.0, 1.0, float(t), 1.0) for x in ("A", "B", "C") for t in (1, 2, MONTH_MS, 2 * MONTH_MS)]
    store.write(spark.createDataFrame(rows, BARS))
    plan = store._touched(spark.createDataFrame(rows[:1], BARS))._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :].split("PushedFilters")[0]
    assert "symbol" in filters and "A" in filters and "month_" in filters and "197001" in filters
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "pruned").rglob("*.parquet")}
    store.upsert(spark.createDataFrame([("s", "B", "1h", MONTH_MS, 1.0, 1.0, 1.0, 77.0, 1.0)], BARS))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "pruned").rglob("*.parquet")}
    gone, new = set(before) - set(after), set(after) - set(before)
    assert len(gone) == len(new) == 1 and "symbol=B" in str(*new) and "month_=197002" in str(*new)
    assert all(after[p] == before[p] for p in set(before) & set(after))
    assert [r.close for r in store.scan(MONTH_MS, MONTH_MS, symbol="B").collect()] == [77.0]
    plan = store.scan(2 * MONTH_MS, symbol="B")._jdf.queryExecution().executedPlan().toString()
    assert "month_" in plan[plan.index("PartitionFilters:") :].split("PushedFilters")[0] and "ts_ms" in plan[plan.index("PushedFilters:") :]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("pruned.")]  # nothing stays beside the store
    assert store.read().count() == len(rows)


def test_purge_empties_folders_of_any_name(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/purged", KEY, BARS)
    names = ("A", "A:B", "A/B", "AB", "50%", "a b=c", "ä#?", None, "C")
    store.write(spark.createDataFrame([("s", x, "1h", t, 1.0, 1.0, 1.0, float(t), 1.0) for x in names for t in (1, 2, MONTH_MS)], BARS))
    gone = store.purge(F.col("symbol").isNull() | ~F.col("symbol").isin("A", "AB", "C") | (F.col("ts_ms") == 2)).collect()
    assert {(r.symbol, r.deleted) for r in gone} == {(x, 1 if x in ("A", "AB", "C") else 3) for x in names}
    assert sorted((r.symbol, r.ts_ms) for r in store.read().collect()) == [(x, t) for x in ("A", "AB", "C") for t in (1, MONTH_MS)]
    assert store.purge(F.col("ts_ms") == 2).count() == 0
    assert store.purge_series(symbol="C").collect()[0].deleted == 2
    assert Store(spark, f"file://{tmp_path}/none", KEY, BARS).purge(F.lit(True)).count() == 0


def test_null_keys_are_series_too(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/null", KEY, BARS)
    row = lambda c: spark.createDataFrame([("s", None, "1h", 1, 1.0, 1.0, 1.0, c, 1.0)], BARS)
    store.upsert(row(1.0))
    store.upsert(row(2.0))
    assert [r.close for r in store.read().collect()] == [2.0]


def test_frames_are_parsed_once(spark):
    plan = closed_frames(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2, plan


def test_online_resample_equals_batch(spark, tmp_path):
    rows = [(i * 60_000, float(i % 7)) for i in range(600)]
    df = spark.createDataFrame(rows, "ts_ms long, close double").select(F.lit("X").alias("symbol"), F.timestamp_millis("ts_ms").alias("ts"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    df.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks")
    q = online_resample(stream, "ts", "1 hour", "10 hours", ["symbol"]).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.ts_ms: (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("hours").collect()}
    for t, bar in got.items():
        own = [c for s, c in rows if s // 3_600_000 * 3_600_000 == t]
        assert bar == (own[0], max(own), min(own), own[-1], float(len(own)))


def test_landed_files(spark, tmp_path):
    (tmp_path / "k1.csv").write_text("open_time,open,high,low,close,volume\n1000,1,2,0.5,1.5,3\n1000,1,2,0.5,1.7,3\n2000,x,2,0.5,1.5,3\n")
    (tmp_path / "k2.csv").write_text("1700000000000000,1,2,0.5,1.5,3\n")
    out = {r.ts_ms: r.close for r in files.read_klines(spark, [f"{tmp_path}/k1.csv", f"{tmp_path}/k2.csv"]).collect()}
    assert out == {1000: 1.7, 1_700_000_000_000: 1.5}
    (tmp_path / "oi.csv").write_text("create_time,symbol,sum_open_interest,sum_open_interest_value\n2024-01-01 00:05:00,X,10,20\n2024-01-01 00:05:00,X,11,21\n")
    assert [(r.ts_ms, r.oi, r.oi_usd) for r in files.read_open_interest(spark, f"{tmp_path}/oi.csv").collect()] == [(1_704_067_500_000, 11.0, 21.0)]
    (tmp_path / "chart_4h.csv").write_text("Time,Value\n1700000000,5\n")
    assert [(r.timeframe, r.ts_ms, r.open, r.volume) for r in files.read_chart_exports(spark, f"{tmp_path}/chart_4h.csv").collect()] == [("4h", 1_700_000_000_000, 5.0, 0.0)]
    (tmp_path / "daily.csv").write_text("DATE,V\n2024-01-01,3.5\n2024-01-02,.\n")
    assert [(r.ts_ms, r.close) for r in files.read_daily_values(spark, f"{tmp_path}/daily.csv").collect()] == [(1_704_067_200_000, 3.5)]
    body = json.dumps({"result": {"list": [{"symbol": "XUSDT", "contractType": "LinearPerpetual", "quoteCoin": "USDT", "priceFilter": {"tickSize": "0.1"}}, {"symbol": "Y", "contractType": "Inverse", "quoteCoin": "USD"}]}})
    assert [(r.symbol, r.tick) for r in files.instruments(spark.createDataFrame([(body,)], "body string")).collect()] == [("XUSDT", 0.1)]


def test_tolerance_match(spark):
    from tidebar.operators.parity import diff_trades

    make = lambda ts: spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(ts)], "trade_id long, entry_ts_ms long, qty double")
    out = diff_trades(make([0, 100, 1000]), make([5, 90, 5000]), ["qty"], window_ms=20)
    assert sorted((r.left_id, r.right_id, r.outcome) for r in out.collect() if r.left_id is not None) == [(0, 0, "same"), (1, 1, "same"), (2, None, "only_left")]
    assert out.where("outcome = 'only_right'").count() == 1
