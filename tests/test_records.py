"""Fetched ranges, decisions, levels, flags and exports: small cases, brute force and DuckDB."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_queries import ORACLE, QUERIES, SF, norm
from tidebar.functions import scalar as S
from tidebar.functions.decisions import decision_sizes, order_ids
from tidebar.operators import levels, series, upsert as up
from tidebar.operators.coverage import Coverage, missing, united
from tidebar.sources import files

KEY = T.StructType([T.StructField("account", T.StringType())])
RANGES = "account string, from_ms long, to_ms long"
NEW = ["fn12_decision_sizes", "fn12_order_ids", "st10_missing_ranges", "pf18_trade_levels", "ag29_level_policy", "st07_listed_flags", "st08_repaired_store", "snk13_coverage_csv", "src08_last_number_as_close", "fn10_symbols_in_text", "fn13_numbers", "set05_ordered_universe"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def by_hand(ranges):
    out = []
    for k, a, b in sorted(r for r in ranges if r[2] is not None and r[1] <= r[2]):
        if out and out[-1][0] == k and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([k, a, b])
    return sorted(map(tuple, out))


def test_ranges_unite_as_by_hand_and_leave_the_right_holes(spark, small_plans):
    random.seed(5)
    ranges = [(random.choice("abc"), s := random.randrange(400), s + random.choice([0, 1, 3, 9, 40])) for _ in range(150)] + [("a", 50, None), ("b", 9, 3), ("d", 7, 7)]
    got = united(spark.createDataFrame(ranges, RANGES), ["account"], block_ms=25)
    assert rows(got) == by_hand(ranges)
    covered = spark.createDataFrame(by_hand(ranges), RANGES)
    want = [("a", 100, 460), ("b", -5, 30), ("d", 0, 7), ("e", 1, 5), ("e", 5, 5)]
    for overlap in (0, 4):
        expect = []
        for k, a, b in want:
            own = [(x, y) for key, x, y in by_hand(ranges) if key == k]
            holes = list(zip([float("-inf"), *(y - overlap for _, y in own)], [*(x for x, _ in own), float("inf")], strict=True))
            expect += [(k, max(a, x), min(b, y)) for x, y in holes if max(a, x) < min(b, y)]
        assert rows(missing(spark.createDataFrame(want, RANGES), covered, ["account"], overlap)) == sorted(expect)


def test_merges_in_any_order_leave_the_same_coverage(spark, small_plans, tmp_path):
    parts = [[("a", 0, 10), ("b", 5, 6)], [("a", 20, 30)], [("a", 10, 20), (None, 1, 2)], []]
    held = {}
    for name, order in {"x": (0, 1, 2, 3), "y": (3, 2, 1, 0)}.items():
        c = Coverage(spark, f"file://{tmp_path}/{name}", KEY, buckets=3)
        assert c.read().count() == 0
        for i in order:
            c.add(spark.createDataFrame(parts[i], RANGES))
        held[name] = sorted(map(tuple, c.read().collect()), key=str)
        assert sorted(map(tuple, c.watermark().collect()), key=str) == [("a", 0, 30), ("b", 5, 6), (None, 1, 2)]
    assert held["x"] == held["y"] == [("a", 0, 30), ("b", 5, 6), (None, 1, 2)]


def test_a_merge_rewrites_only_its_buckets(spark, small_plans, tmp_path):
    c = Coverage(spark, f"file://{tmp_path}/c", KEY, buckets=8)
    c.add(spark.createDataFrame([(str(i), i, i + 1) for i in range(40)], RANGES))
    files_of = lambda: {r["f"] for r in c._all().select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = files_of()
    c.add(spark.createDataFrame([("7", 100, 200)], RANGES))
    assert len(before - files_of()) == 1 and c.read().count() == 41


def test_sizes_of_decisions(spark):
    cases = [
        ({"confidence_pct": 61.23456, "risk_fraction": "0.015"}, (61.2346, 1.5, None, 1.5, None)),
        ({"confidence": 0.42, "qty_detail": {"confidence_pct": 9, "actual_risk_fraction": 0.0125, "sizing_mode": "m"}}, (42.0, None, 1.25, 1.25, "m")),
        ({"intended_risk_fraction": 0.02, "risk_fraction": 0.5, "actual_risk_pct": 1, "sizing_mode": "own", "qty_detail": {"risk_pct": 3, "sizing_mode": "x"}}, (None, 2.0, 1.0, 1.0, "own")),
        ({"sizing_mode": "none told", "confidence": None}, (None,) * 5),
        ({"qty_detail": [1], "risk_pct": "NaN"}, (None,) * 5),
    ]
    text = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(5, "{broken"), (6, None), (7, "")]
    got = decision_sizes(spark.createDataFrame(text, "i int, payload string")).orderBy("i").select("confidence_pct", "risk_pct", "actual_risk_pct", "display_risk_pct", "sizing_mode").collect()
    assert [tuple(r) for r in got] == [w for _, w in cases] + [(None,) * 5] * 3


def test_order_ids_of_results(spark):
    leg = lambda i: {"result": {"orderId": i}}
    cases = [
        ({"order_id": 12, "orderId": "b", "placed": {"response": {"result": {"orderId": "c"}}}, "tpsl": {"tp": [leg("d"), 5, {"orderId": "e"}, leg("d")], "sl": leg("f")}}, ["12", "b", "c", "d", "e", "f"]),
        ({"order_id": "", "orderId": None, "placed": "no", "tpsl": {"tp": [], "sl": {"result": "x", "orderId": "g"}}}, ["g"]),
        ({"other": {"orderId": "h"}}, []),
    ]
    text = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(3, "{"), (4, None), (5, "[1]")]
    got = spark.createDataFrame(text, "i int, t string").orderBy("i").select(order_ids(F.col("t"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases] + [[]] * 3


def test_levels_and_their_policy(spark):
    t = [("a", 1, 100.0, 98.0, [104.0, 108.0]), ("a", -1, 50.0, 51.0, [48.0, 46.0]), ("b", 1, 10.0, 9.0, None), ("c", 1, 10.0, 9.0, [11.0]), ("c", 1, 10.0, 9.5, [11.0]), ("d", 1, 0.0, 9.5, [11.0])]
    df = levels.level_percents(spark.createDataFrame(t, "k string, side int, entry_price double, stop_price double, targets array<double>"))
    assert [tuple(r) for r in df.orderBy("k", F.desc("side"), "sl_pct").select("sl_pct", "tp_pcts").collect()] == [(-2.0, [4.0, 8.0]), (-2.0, [4.0, 8.0]), (-10.0, []), (-10.0, [10.0]), (-5.0, [10.0]), (None, [None])]
    got = {r["k"]: r for r in levels.level_policy(df, ["k"]).collect()}
    assert got["a"]["levels"] == "SL -2.00%  |  TP1 +4.00%  |  TP2 +8.00%" and got["b"]["levels"] == "SL -10.00%  |  TP (none)"
    assert (got["c"]["signatures"], got["c"]["constant"], got["c"]["levels"], got["c"]["trades"]) == (2, False, None, 2)


def test_flags_tell_malformed_text_from_a_missing_reason(spark):
    meta = [("data_unsafe:a", '{"ok":true,"reason":"x"}'), ("data_unsafe:b", '{"reason":null}'), ("data_unsafe:c", "{" + "y" * 300), ("data_unsafe:d", None), ("other", "{")]
    got = {r["key"][-1]: tuple(r)[1:] for r in up.listed_flags(spark.createDataFrame(meta, "key string, value string")).collect()}
    assert got == {"a": (True, "x", None), "b": (None, None, None), "c": (False, "META_PARSE_FAIL", "{" + "y" * 199), "d": (False, "META_PARSE_FAIL", None)}


def test_close_is_the_last_column_of_numbers_where_none_is_named(spark, tmp_path):
    (tmp_path / "dom_4h.csv").write_text("time,share,other,note\n1700000000,50.5,7,a\n1700014400,,8,b\n")
    (tmp_path / "named.csv").write_text("time,close,other\n1700000000,50.5,7\n")
    got = {(r["file"], r["ts_ms"]): (r["timeframe"], r["close"], r["open"]) for r in files.read_chart_exports(spark, str(tmp_path)).collect()}
    assert got == {("dom_4h.csv", 1700000000000): ("4h", 7.0, 7.0), ("dom_4h.csv", 1700014400000): ("4h", 8.0, 8.0), ("named.csv", 1700000000000): ("1d", 50.5, 50.5)}


def test_words_numbers_and_flags(spark):
    row = spark.sql("SELECT 'ETHusdt, x btcUSDT and ETHUSDT; USDT' AS t, '--pack a.py --symbol=eth/usdt --SYMBOL  btc-usdt --symbol ETHUSDT' AS c")
    got = row.select(S.symbols_in_text(F.col("t")), S.symbols_of_flags(F.col("c")), S.flag_values(F.col("c"), "pack"), *[S.show_number(F.lit(v).cast("double"), 2) for v in (None, float("inf"), float("-inf"), float("nan"), -1.5)]).first()
    assert tuple(got) == (["ETHUSDT", "BTCUSDT"], ["ETHUSDT", "BTCUSDT"], ["a.py"], "-", "inf", "-inf", "nan", "-1.50")


def test_union_keeps_the_first_mention(spark):
    parts = [spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "s string, i long"), spark.createDataFrame([("c", 0), ("a", 1), (None, 2)], "s string, i long")]
    assert [tuple(r) for r in series.ordered_union(parts, ["s"], "i").orderBy("part", "place").collect()] == [("b", 0, 0), ("a", 0, 1), ("c", 1, 0), (None, 1, 2)]


@pytest.mark.parametrize("name", NEW)
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    out = con.execute(ORACLE[name])
    at = [[d[0] for d in out.description].index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in out.fetchall())
