import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import leakage as lk
from tidebar.operators import structure as st
from tidebar.streaming.features import replay, stream_features


def walk(spark, n=420):
    rows = []
    for symbol in ("A", "B:C", "flat"):
        rng, price = random.Random(symbol), 100.0
        for i in range(n):
            price = price if symbol == "flat" else max(5.0, price + rng.choice((-1.5, -1.0, -0.5, 0.5, 1.0, 1.5)))
            high, low = price + rng.choice((0.0, 0.5, 1.0)), price - rng.choice((0.0, 0.5, 1.0))
            rows.append((symbol, 3_600_000 * (i + 1), high, low, price))
    return spark.createDataFrame(rows, "symbol string, ts_ms long, high double, low double, close double").repartition(3)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    bars = walk(spark).cache()
    stream = replay(bars, [3_600_000 * k for k in (1, 4, 150, 151, 420)], lambda s: stream_features(s, ["symbol"]), f"file://{tmp_path_factory.mktemp('replay')}")
    return bars, stream.cache(), st.bar_features(bars, keys=["symbol"]).cache()


def test_bar_by_bar_equals_batch(both):
    _, stream, batch = both
    assert sorted(stream.columns) == sorted(batch.columns)
    assert stream.count() == batch.count() == 3 * 420
    got = {(r.symbol, r.ts_ms): r.asDict() for r in stream.collect()}
    for r in batch.collect():
        own = got[r.symbol, r.ts_ms]
        for c, v in r.asDict().items():
            assert own[c] == pytest.approx(v, abs=1e-12) if isinstance(v, float) else own[c] == v, (r.symbol, r.ts_ms, c, own[c], v)
    assert batch.where("last_retrace_fib IS NOT NULL AND nearest_support IS NOT NULL").count() > 300


def test_late_and_repeated_bars_give_no_row(spark, tmp_path):
    bars = walk(spark, 30).where("symbol = 'A'")
    late = bars.where(F.col("ts_ms") <= 3_600_000 * 10).withColumn("close", F.col("close") + 50)
    folder = f"file://{tmp_path}/late"
    build = lambda s: stream_features(s, ["symbol"])
    replay(bars, [3_600_000 * 20], build, folder)
    late.write.mode("append").parquet(f"{folder}/landed")
    out = replay(bars.where(F.col("ts_ms") > 3_600_000 * 20), [3_600_000 * 30], build, folder)
    assert out.count() == 30 and out.select("ts_ms").distinct().count() == 30


def test_tip_check_finds_planted_faults(both):
    _, stream, batch = both
    keys = ["symbol"]
    assert lk.streaming_tip(batch, stream, keys).count() == 0
    cut = stream.where(F.col("ts_ms") <= 3_600_000 * 390)
    assert lk.streaming_tip(batch, cut, keys).count() == 0
    wrong = cut.withColumn("last_structure_label", F.lower("last_structure_label")).withColumn("structure_bias", F.col("structure_bias") + 1).withColumn("last_sl_price", F.lit(None).cast("double"))
    assert {r.column for r in lk.streaming_tip(batch, wrong, keys).collect()} == {"last_structure_label", "structure_bias", "last_sl_price"}
    none = lk.streaming_tip(batch, cut.where("symbol <> 'A'"), keys).collect()
    assert [(r.column, r.severity) for r in none] == [("*", "HARD")]


def test_publication_rules_find_early_and_missing_columns(both, spark):
    bars, _, batch = both
    events = st.label_events(st.swings(bars, keys=["symbol"]), ["symbol"])
    made = st.legs(events, ["symbol"])
    records = lk.known_records(events, made, ["symbol"])
    fine = lk.publication(batch, records, ["symbol"])
    assert {r.verdict for r in fine.collect()} == {"ok"}
    # one value of a later record shown a bar before it is known
    before = {r.ts_ms: r.last_sh_price for r in batch.where("symbol = 'A'").collect()}
    at = next(t for t in sorted(before) if t > 3_600_000 * 200 and before[t] != before[t - 3_600_000])
    early = batch.withColumn("last_sh_price", F.when((F.col("symbol") == "A") & (F.col("ts_ms") == at - 3_600_000), F.lit(before[at])).otherwise(F.col("last_sh_price"))).drop("fib_0000")
    bad = {(r.symbol, r.column): r.verdict for r in lk.publication(early, records, ["symbol"]).where("verdict <> 'ok'").collect()}
    assert bad == {("A", "last_sh_price"): "early", **{(s, "fib_0000"): "missing" for s in ("A", "B:C", "flat")}}
