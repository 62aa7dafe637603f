import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import structure as st
from tidebar.operators.indicators import IndicatorStore

pytestmark = pytest.mark.usefixtures("small_plans")
HOUR, DAY = 3_600_000, 86_400_000
KEYS = ["symbol"]


def walk(spark, days=70, symbols=("B:C", "late"), seed=0):
    rows = []
    for symbol in symbols:
        rng, price = random.Random(f"{symbol}{seed}"), 100.0
        for i in range(days * 24):
            price = max(5.0, price + rng.choice((-1.5, -1.0, -0.5, 0.5, 1.0, 1.5)))
            if (symbol == "late" and i < 50 * 24) or rng.random() < 0.02:  # a series that starts late, and gaps
                continue
            rows.append((symbol, HOUR * i, price + rng.choice((0.0, 0.5, 1.0)), price - rng.choice((0.0, 0.5, 1.0)), price))
    return spark.createDataFrame(rows, "symbol string, ts_ms long, high double, low double, close double").repartition(3).cache()


def rows_of(store, name):
    return sorted(map(str, (r.asDict() for r in store.tables[name].read().collect())))


@pytest.fixture(scope="module")
def whole(spark, small_plans, tmp_path_factory):
    at = tmp_path_factory.mktemp("indicators")
    store = IndicatorStore(spark, f"file://{at}/whole", KEYS)
    store.replace(walk(spark))
    return at, store


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_updates_equal_a_rebuild_and_rewrite_one_month(spark, whole):
    at, rebuilt = whole
    bars = walk(spark)
    store = IndicatorStore(spark, f"file://{at}/steps", KEYS)
    for until in (3 * HOUR, 69 * DAY):  # at first too few bars for a pivot, and one of the series
        store.update(bars.where(F.col("ts_ms") < until))
    before = files(at / "steps")
    store.update(bars.where(F.col("ts_ms") < 69 * DAY))
    assert files(at / "steps") == before  # nothing new, nothing written
    store.update(bars)
    after = files(at / "steps")
    for name in store.tables:
        assert rows_of(store, name) == rows_of(rebuilt, name), name
    touched = {p for p in {*before, *after} if before.get(p) != after.get(p)}
    assert all("month_=197003" in p for p in touched if "/series/" not in p) and any("bar_features" in p for p in touched)
    got = store.scan("bar_features", 10 * DAY, 11 * DAY, symbol="B:C")
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :].split("PushedFilters")[0]
    assert "symbol" in filters and "month_" in filters and "ts_ms" in plan[plan.index("PushedFilters:") :]
    want = st.bar_features(bars, keys=KEYS).where((F.col("symbol") == "B:C") & F.col("ts_ms").between(10 * DAY, 11 * DAY))
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(got.columns)).collect()))


def test_replacement_leaves_no_stale_month(spark, whole):
    at, store = whole
    kept = {n: [r for r in rows_of(store, n) if "'late'" in r] for n in store.tables}
    other = walk(spark, 20, ("B:C",), seed=1)
    store.replace(other)
    swings = st.swings(other, keys=KEYS)
    events = st.label_events(swings, KEYS)
    want = {"swings": swings, "structure_events": events, "legs": st.legs(events, KEYS), "levels": st.levels(swings, KEYS), "bar_features": st.bar_features(other, keys=KEYS)}
    for name, df in want.items():
        assert rows_of(store, name) == sorted(kept[name] + [str(r.asDict()) for r in df.select(*store.tables[name].columns).collect()]), name
    series = {r.symbol: r for r in store.scan("series").collect()}
    assert (series["B:C"].n_bars, series["B:C"].n_swings, series["B:C"].n_legs) == (other.count(), swings.count(), want["legs"].count())
    assert {p.name for p in (at / "whole/bar_features").glob("symbol=B*/*")} == {"month_=197001"}
    assert len(list((at / "whole/bar_features").glob("symbol=late/*"))) == 2
