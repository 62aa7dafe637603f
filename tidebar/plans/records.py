"""Decisions, fetched ranges, levels, flags and exports: records that go with bars and trades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.functions import scalar as S
from tidebar.functions.decisions import decision_sizes, order_ids
from tidebar.operators import levels, series, upsert as up
from tidebar.operators.coverage import Coverage, missing
from tidebar.plans.registry import register
from tidebar.plans.views import TRADES, TICKS, bars, bars_sql, more_bars, read, tick_bars, ticks, trades
from tidebar.schemas import BARS, KEY
from tidebar.scratch import scratch_path

H, DAY = 3_600_000, 86_400_000
OVERLAP = 2 * H


@register("fn12_decision_sizes", f"""WITH {TICKS} SELECT seq,
 CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 2 = 0 THEN round(user_id / 8.0::DOUBLE, 4) WHEN seq % 3 = 0 THEN (seq % 100)::DOUBLE END AS confidence_pct,
 CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 5 = 0 THEN (seq % 40)::DOUBLE WHEN seq % 3 = 0 THEN (seq % 10)::DOUBLE / 4 END AS risk_pct,
 CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 3 = 0 THEN (seq % 8)::DOUBLE / 2
      WHEN seq % 5 = 0 THEN (seq % 40)::DOUBLE END AS display_risk_pct,
 CASE WHEN seq % 7 = 0 OR (seq % 2 <> 0 AND seq % 3 <> 0 AND seq % 5 <> 0) THEN NULL WHEN seq % 2 = 0 THEN 'CONFIDENCE_RISK' WHEN seq % 3 = 0 THEN 'inner' END AS sizing_mode FROM ticks""")
def _(spark, d):
    k, u = F.col("seq"), F.col("user_id")
    part = lambda cond, *text: F.when(cond, F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in text]))
    inner = F.concat(F.lit('"qty_detail":{"confidence_pct":"'), k % 100, F.lit('","risk_pct":'), (k % 10) / 4, F.lit(',"actual_risk_fraction":'), (k % 8) / 200, F.lit(',"sizing_mode":"inner"}'))
    fields = F.concat_ws(",", part(k % 2 == 0, '"confidence":', u / 800, ',"sizing_mode":"CONFIDENCE_RISK"'), part(k % 5 == 0, '"risk_fraction":"', (k % 40) / 100, '"'), F.when(k % 3 == 0, inner).otherwise('"qty_detail":"none"'))
    body = F.when(k % 7 == 0, F.concat(F.lit('{"confidence_pct":'), k)).otherwise(F.concat(F.lit("{"), fields, F.lit("}")))
    out = decision_sizes(ticks(spark, d).select("seq", body.alias("payload")))
    return out.select("seq", "confidence_pct", "risk_pct", "display_risk_pct", "sizing_mode")


@register("fn12_order_ids", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'o' || o_orderkey END, 'p' || o_custkey,
 CASE WHEN o_orderkey % 3 = 0 THEN 't' || o_orderkey || ',u' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 't' || o_orderkey END, CASE WHEN o_orderkey % 4 = 0 THEN 's' || o_orderkey END) END AS ids FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    own = F.when(k % 2 == 0, F.concat(F.lit('"order_id":"o'), k, F.lit('","orderId":"o'), k, F.lit('",'))).otherwise(F.lit('"order_id":null,"orderId":"",'))
    placed = F.concat(F.lit('"placed":{"response":{"result":{"orderId":"p'), "o_custkey", F.lit('"}}},'))
    one, two = F.concat(F.lit('{"result":{"orderId":"t'), k, F.lit('"}}')), F.concat(F.lit('{"result":"none","orderId":"u'), k, F.lit('"}'))
    tp = F.when(k % 3 == 0, F.concat(F.lit("["), one, F.lit(","), two, F.lit(","), one, F.lit("]"))).when(k % 3 == 1, one).otherwise(F.lit('"failed"'))
    sl = F.when(k % 4 == 0, F.concat(F.lit('{"orderId":"s'), k, F.lit('"}'))).otherwise(F.lit("null"))
    body = F.concat(F.lit("{"), own, placed, F.lit('"tpsl":{"tp":'), tp, F.lit(',"sl":'), sl, F.lit("}}"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(order_ids(F.when(k % 7 == 0, F.substring(body, 1, 9)).otherwise(body)), ",").alias("ids"))


#: A day after every second and third of three trades has been fetched, in two merges.
_FETCHED = f"""{TRADES}, w AS (SELECT DISTINCT account, exit_ts_ms AS f, exit_ts_ms + {DAY} AS t FROM trades WHERE trade_id % 3 > 0),
 r AS (SELECT *, max(t) OVER (PARTITION BY account ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w),
 i AS (SELECT *, sum(CASE WHEN b IS NULL OR f > b THEN 1 ELSE 0 END) OVER (PARTITION BY account ORDER BY f) AS n FROM r),
 covered AS (SELECT account, min(f) AS from_ms, max(t) AS to_ms FROM i GROUP BY account, n)"""


def _fetched(spark, d) -> Coverage:
    """What is stored after two merges, the later one first."""
    held = Coverage(spark, scratch_path(spark, "coverage"), T.StructType([T.StructField("account", T.LongType())]))
    t = trades(spark, d).select("account", F.col("exit_ts_ms").alias("from_ms"), (F.col("exit_ts_ms") + DAY).alias("to_ms"), (F.col("trade_id") % 3).alias("turn"))
    for turn in (2, 1):
        held.add(t.where(F.col("turn") == turn))
    return held


@register("snk10_stored_coverage", f"WITH {_FETCHED} SELECT account, from_ms, to_ms FROM covered")
def _(spark, d):
    return _fetched(spark, d).read()


@register("snk10_stored_watermark", f"WITH {TRADES} SELECT account, min(exit_ts_ms) AS from_ms, max(exit_ts_ms) + {DAY} AS to_ms FROM trades WHERE trade_id % 3 > 0 GROUP BY account")
def _(spark, d):
    return _fetched(spark, d).watermark()


@register("st10_missing_ranges", f"""WITH {_FETCHED}, want AS (SELECT account, min(entry_ts_ms) AS a, max(exit_ts_ms) AS z FROM trades GROUP BY account),
 holes AS (SELECT account, to_ms AS x, lead(from_ms) OVER (PARTITION BY account ORDER BY from_ms) AS y FROM covered UNION ALL SELECT account, NULL, min(from_ms) FROM covered GROUP BY account)
SELECT account, greatest(a, x - {OVERLAP}) AS from_ms, least(z, y) AS to_ms FROM want LEFT JOIN holes USING (account) WHERE greatest(a, x - {OVERLAP}) < least(z, y)""")
def _(spark, d):
    want = trades(spark, d).groupBy("account").agg(F.min("entry_ts_ms").alias("from_ms"), F.max("exit_ts_ms").alias("to_ms"))
    return missing(want, _fetched(spark, d).read(), ["account"], OVERLAP)


#: Stops from each line's discount, ladders from its tax: real, repeated and mixed ones.
_LEVELLED = f"""{TRADES}, lv AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey AS trade_id, CASE WHEN l_suppkey % 4 = 0 THEN 0.02 ELSE l_discount END::DOUBLE AS sd, CASE WHEN l_suppkey % 4 = 0 THEN 0.04 ELSE l_tax END::DOUBLE AS td FROM lineitem),
 levelled AS (SELECT t.*, round(-sd * 100, 4) AS sl_pct, CASE WHEN td = 0 THEN [] ELSE [round(td * 100, 4), round(td * 200, 4)] END AS tps FROM trades t JOIN lv USING (trade_id))"""


def _levelled(spark, d):
    li = read(spark, d, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    fixed = F.col("l_suppkey") % 4 == 0
    own = li.select(key.alias("trade_id"), F.when(fixed, 0.02).otherwise(F.col("l_discount")).alias("sd"), F.when(fixed, 0.04).otherwise(F.col("l_tax")).alias("td"))
    entry, side = F.col("entry_price"), F.col("side")
    j = trades(spark, d).join(own, "trade_id").withColumns({"stop_price": entry * (1 - side * F.col("sd")), "targets": F.when(F.col("td") != 0, F.array(entry * (1 + side * F.col("td")), entry * (1 + side * 2 * F.col("td"))))})
    return levels.level_percents(j)


@register("pf18_trade_levels", f"WITH {_LEVELLED} SELECT trade_id, sl_pct + 0.0 AS sl_pct, len(tps)::INTEGER AS targets, coalesce(list_sum(tps), 0.0) AS ladder_sum FROM levelled")
def _(spark, d):
    total = F.aggregate("tp_pcts", F.lit(0.0), lambda a, x: a + x)
    return _levelled(spark, d).select("trade_id", (F.col("sl_pct") + 0.0).alias("sl_pct"), F.size("tp_pcts").alias("targets"), F.round(total, 4).alias("ladder_sum"))


@register("ag29_level_policy", f"WITH {_LEVELLED} SELECT account, count(*) AS trades, count(DISTINCT (sl_pct, tps)) AS signatures, count(DISTINCT (sl_pct, tps)) = 1 AS constant, CASE WHEN count(DISTINCT (sl_pct, tps)) = 1 THEN 'SL -2.00%  |  TP1 +4.00%  |  TP2 +8.00%' END AS levels FROM levelled GROUP BY account")
def _(spark, d):
    return levels.level_policy(_levelled(spark, d), ["account"])


@register("st07_listed_flags", f"""WITH {TICKS} SELECT 'data_unsafe:' || seq AS key, CASE WHEN seq % 4 IN (0, 1) THEN false WHEN seq % 4 = 2 THEN user_id % 2 = 0 END AS ok,
 CASE WHEN seq % 4 < 2 THEN 'META_PARSE_FAIL' WHEN seq % 4 = 2 THEN symbol END AS reason, CASE WHEN seq % 4 = 0 THEN '{{broken' || seq END AS raw FROM ticks WHERE user_id % 3 <> 0""")
def _(spark, d):
    k = F.col("seq")
    text = F.when(k % 4 == 0, F.concat(F.lit("{broken"), k)).when(k % 4 == 2, F.concat(F.lit('{"ok":'), F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"), F.lit(',"reason":"'), "symbol", F.lit('"}'))).when(k % 4 == 3, '{"reason":null}')
    return up.listed_flags(ticks(spark, d).select(F.concat(F.when(F.col("user_id") % 3 == 0, "other:").otherwise("data_unsafe:"), k).alias("key"), text.alias("value")))


@register("st08_repaired_store", f"""WITH {bars_sql()}, {more_bars('even', '1h', 'seq % 2 = 0')}, g AS (SELECT symbol, ts_ms AS before_ms, lead(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS after_ms FROM even),
 f AS (SELECT * FROM g WHERE after_ms - before_ms > {H}),
 bad AS (SELECT DISTINCT f.symbol, f.before_ms FROM f JOIN even e ON e.symbol = f.symbol AND e.ts_ms IN (f.before_ms, f.after_ms) JOIN bars b ON b.symbol = e.symbol AND b.ts_ms = e.ts_ms WHERE abs(e.close - b.close) > 1e-9 * greatest(1.0, abs(e.close)))
SELECT symbol, ts_ms, close FROM even UNION ALL SELECT b.symbol, b.ts_ms, b.close FROM bars b JOIN f ON b.symbol = f.symbol AND b.ts_ms > f.before_ms AND b.ts_ms < f.after_ms
WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.symbol = f.symbol AND bad.before_ms = f.before_ms)""")
def _(spark, d):
    t = ticks(spark, d)
    held = up.Store(spark, scratch_path(spark, "repaired"), KEY, BARS)
    held.upsert(tick_bars(t.where("seq % 2 = 0"), "1h"))
    held.upsert(series.repair_gaps(held.read(), tick_bars(t, "1h"), H))
    return held.read().select("symbol", "ts_ms", "close")


@register("snk13_coverage_csv", f"WITH {bars_sql()} SELECT source, symbol, timeframe, count(*) AS bars, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms FROM bars GROUP BY ALL")
def _(spark, d):
    return series.export_coverage(bars(spark, d), scratch_path(spark, "coverage-csv"))


@register("src08_last_number_as_close", f"WITH {TICKS} SELECT (ts_ms // 1000) * 1000 AS ts_ms, price + 1 AS open, price AS close, count(*) AS n FROM ticks GROUP BY ALL")
def _(spark, d):
    from tidebar.plans.landed import _with_headers
    from tidebar.sources import files

    p, s = F.col("price"), F.floor(F.col("ts_ms") / 1000).cast("string")
    heads = {"a": ["Time", "Open", "Dominance", "Remark"], "b": ["date", "OPEN", "share of all", "by"]}
    rows = _with_headers(ticks(spark, d), heads, [s, (p + 1).cast("string"), p.cast("string"), F.when(F.col("seq") % 2 == 0, "7").otherwise("desk")])
    return files.chart_rows(rows, 4).groupBy("ts_ms", "open", "close").agg(F.count("*").alias("n"))


@register("fn10_symbols_in_text", f"""WITH {TICKS} SELECT seq, concat_ws(',', upper(symbol) || 'USDT', CASE WHEN seq % 2 = 0 THEN 'A' || seq || 'USDT' END) AS named, CASE WHEN seq % 5 = 0 THEN '' ELSE upper(replace(symbol, '_', '')) || ',X' || (user_id % 9) END AS asked, seq || '' AS packs FROM ticks""")
def _(spark, d):
    k, sym = F.col("seq"), F.regexp_replace("symbol", "_", "")
    text = F.concat(F.lit("run "), "symbol", F.lit("usdt; then "), F.when(k % 2 == 0, F.concat(F.lit("a"), k, F.lit("usdt"))).otherwise("nothing"), F.lit(", "), F.upper("symbol"), F.lit("USDT"))
    args = F.concat(F.lit("--pack="), k, F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" --symbol "), sym, F.lit(" --SYMBOL=x-"), F.col("user_id") % 9, F.lit(" --symbol "), F.upper(sym))))
    return ticks(spark, d).select("seq", F.array_join(S.symbols_in_text(text), ",").alias("named"), F.array_join(S.symbols_of_flags(args), ",").alias("asked"), F.array_join(S.flag_values(args, "pack"), ",").alias("packs"))


@register("fn13_numbers", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '-' WHEN event_id % 7 = 0 THEN 'inf' ELSE printf('%.2f', value) END AS number FROM events")
def _(spark, d):
    v = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value"))
    return read(spark, d, "events").select("event_id", S.show_number(v, 2).alias("number"))


@register("set05_ordered_universe", """WITH u AS (SELECT n_name AS symbol, 0 AS part, n_nationkey AS place FROM nation UNION ALL SELECT r_name, 1, r_regionkey FROM region UNION ALL SELECT event_type, 2, event_id FROM events UNION ALL SELECT n_name, 3, -n_nationkey FROM nation)
SELECT symbol, part, place::BIGINT AS place FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY part, place) = 1""")
def _(spark, d):
    part = lambda t, c, place: read(spark, d, t).select(F.col(c).alias("symbol"), place.cast("long").alias("place"))
    parts = [part("nation", "n_name", F.col("n_nationkey")), part("region", "r_name", F.col("r_regionkey")), part("events", "event_type", F.col("event_id")), part("nation", "n_name", -F.col("n_nationkey"))]
    return series.ordered_union(parts, ["symbol"], "place").orderBy("part", "place")
