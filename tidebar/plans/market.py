"""Series queries: resampling, cleaning, coverage, gaps, comparison, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions import scalar as S
from tidebar.operators import asof, series
from tidebar.plans.registry import register
from tidebar.plans.views import NOW_MS, TICKS, bars, bars_sql, more_bars, read, tick_bars, ticks
from tidebar.schemas import KEY
from tidebar.timeframes import STEP_MS, normalize_timeframe

HOUR = STEP_MS["1h"]
OHLCV = "open, high, low, close, volume"
NOW = NOW_MS


def _resampled(base: str, out: str, timeframe: str, offset: int = 0) -> str:
    s = STEP_MS[timeframe]
    b = f"((ts_ms - {offset}) // {s}) * {s} + {offset}"
    return f"""{out} AS (SELECT source, symbol, '{timeframe}' AS timeframe, {b} AS ts_ms, first(open ORDER BY ts_ms) AS open, max(high) AS high, min(low) AS low,
      last(close ORDER BY ts_ms) AS close, sum(volume) AS volume, count(*) AS n_children FROM {base} GROUP BY source, symbol, {b})"""


def _cols(extra: str = "") -> str:
    return f"source, symbol, timeframe, ts_ms, {OHLCV}{extra}"


@register("ag01_resample_4h", f"WITH {bars_sql()}, {_resampled('bars', 'r', '4h')} SELECT {_cols(', n_children')} FROM r")
def _(spark, d):
    return series.resample(bars(spark, d), "4h")


@register("ag01_resample_offset", f"WITH {bars_sql()}, {_resampled('bars', 'r', '1d', 8 * HOUR)} SELECT {_cols(', n_children')} FROM r")
def _(spark, d):
    return series.resample(bars(spark, d), "1d", offset=8 * HOUR)


@register("ag01_tick_bars_15m", f"WITH {bars_sql('15m')} SELECT {_cols()} FROM bars")
def _(spark, d):
    return bars(spark, d, "15m")


_HIGHER = f"""WITH {bars_sql('1m', 'm')}, {_resampled('m', 'h1', '1h')}, {_resampled('h1', 'h4', '4h')}, {_resampled('m', 'd1', '1d')}, {_resampled('d1', 'w1', '1w', 345600000)}
SELECT {_cols()} FROM h1 UNION ALL SELECT {_cols()} FROM h4 UNION ALL SELECT {_cols()} FROM d1 UNION ALL SELECT {_cols()} FROM w1"""


@register("ag02_derive_higher", _HIGHER)
def _(spark, d):
    return series.derive_higher(bars(spark, d, "1m"))


@register("ag03_coverage", f"WITH {bars_sql()} SELECT source, symbol, timeframe, count(*) AS bars, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms FROM bars GROUP BY ALL")
def _(spark, d):
    return series.coverage(bars(spark, d))


@register("ag04_latest_earliest", "SELECT event_type AS symbol, max((epoch_us(ts) // 1000)) AS latest_ts_ms, min((epoch_us(ts) // 1000)) AS earliest_ts_ms, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return ticks(spark, d).groupBy("symbol").agg(F.max("ts_ms").alias("latest_ts_ms"), F.min("ts_ms").alias("earliest_ts_ms"), F.count("*").alias("n"))


@register("ag05_freshness", f"WITH {bars_sql()} SELECT source, symbol, timeframe, count(*) AS bars, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms, ({NOW_MS} - max(ts_ms)) / 1000.0::DOUBLE AS lag_s, ({NOW_MS} - max(ts_ms)) > 2.5 * {HOUR} AS stale FROM bars GROUP BY source, symbol, timeframe")
def _(spark, d):
    return series.freshness(bars(spark, d), F.lit(NOW))


_FROM = 1_704_067_200_000
_WANTED = f"CASE WHEN symbol < 'd' THEN {_FROM} - 1728000000 ELSE {_FROM} END"


@register("ag06_ingest_plan", f"""WITH {bars_sql('15m', 'q', "symbol <> 'view'")}, {more_bars('h', '1h')}, {more_bars('dd', '1d')}, {more_bars('m', '1m')},
 u AS (SELECT * FROM q WHERE ts_ms < 1706680000000 UNION ALL SELECT * FROM h UNION ALL SELECT * FROM dd UNION ALL SELECT * FROM m), c AS (SELECT source, symbol, timeframe, min(ts_ms) AS lo, max(ts_ms) AS hi, {_WANTED} AS w FROM u GROUP BY ALL),
 l(timeframe, ms) AS (VALUES ('1m', 7200000), ('15m', 14400000), ('1h', 21600000), ('1d', 144000000)), p AS (SELECT c.*, ms, lo > w + 604800000 AS late FROM c JOIN l USING (timeframe))
SELECT source, symbol, timeframe, CASE WHEN late THEN 'restart' WHEN {NOW_MS} - hi <= ms THEN 'skip' ELSE 'append' END AS action, CASE WHEN late THEN w WHEN {NOW_MS} - hi > ms THEN hi - CASE timeframe WHEN '1m' THEN 21600000 ELSE 432000000 END END AS start_ms FROM p""")
def _(spark, d):
    """Series of four timeframes; the quarter hours stop a day early, and some symbols are wanted from 20 days before."""
    from tidebar.plans.views import tick_bars, ticks

    t = ticks(spark, d)
    u = tick_bars(t.where("symbol <> 'view'"), "15m").where("ts_ms < 1706680000000")
    for tf in ("1h", "1d", "1m"):
        u = u.unionByName(tick_bars(t, tf))
    return series.ingest_plan(u, F.lit(NOW), F.when(F.col("symbol") < "d", _FROM - 1_728_000_000).otherwise(_FROM))


@register("ag07_daily_last", f"""WITH {bars_sql()}, x AS (SELECT source, symbol, (ts_ms // 86400000) * 86400000 AS day, last(close ORDER BY ts_ms) AS v FROM bars GROUP BY ALL)
SELECT source, symbol, '1d' AS timeframe, day AS ts_ms, v AS open, v AS high, v AS low, v AS close, 0.0::DOUBLE AS volume FROM x""")
def _(spark, d):
    return series.daily_last(bars(spark, d))


@register("ag09_ingest_summary", f"WITH {bars_sql()} SELECT count(DISTINCT symbol) AS series, count(*) AS bars, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms FROM bars")
def _(spark, d):
    return series.coverage(bars(spark, d)).agg(F.count("*").alias("series"), F.sum("bars").alias("bars"), F.min("min_ts_ms").alias("min_ts_ms"), F.max("max_ts_ms").alias("max_ts_ms"))


@register("pf01_conform", f"""WITH {TICKS}, x AS (SELECT source, symbol, '1m' AS timeframe, (ts_ms // 60000) * 60000 AS ts_ms, price AS open, price AS high, price AS low, price AS close, size AS volume, seq,
 row_number() OVER (PARTITION BY symbol, ts_ms // 60000 ORDER BY seq DESC) AS n FROM ticks) SELECT {_cols()} FROM x WHERE n = 1""")
def _(spark, d):
    t = ticks(spark, d)
    raw = t.select("source", "symbol", F.lit("1m").alias("timeframe"), F.timestamp_millis(F.floor(F.col("ts_ms") / 60000) * 60000).alias("timestamp"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.col("size").alias("volume"), F.col("seq").alias("ingest_seq"))
    return series.conform_bars(raw)


@register("pf02_pick_series", f"WITH {bars_sql()} SELECT source, symbol, timeframe, count(*) AS bars, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms FROM bars WHERE upper(symbol) IN ('CLICK', 'VIEW', 'PURCHASE') GROUP BY ALL HAVING count(*) >= 50")
def _(spark, d):
    return series.pick_series(bars(spark, d), symbols=["click", "view", "purchase"])


_MID = 1_705_276_800_000 + 1_800_000


@register("pf03_drop_forming", f"WITH {bars_sql()} SELECT {_cols()} FROM bars WHERE ts_ms + {HOUR} <= {_MID}")
def _(spark, d):
    return series.drop_forming(bars(spark, d), F.lit(_MID))


@register("pf04_drop_junk", f"WITH {bars_sql('15m')}, x AS (SELECT source, symbol, timeframe, ts_ms, open, high, low, close, CASE WHEN volume = 1 THEN 0.0 ELSE volume END::DOUBLE AS volume FROM bars) SELECT {_cols()} FROM x WHERE NOT (open = high AND high = low AND low = close AND volume <= 0)")
def _(spark, d):
    return series.drop_junk(bars(spark, d, "15m").withColumn("volume", F.when(F.col("volume") == 1, 0.0).otherwise(F.col("volume"))))


@register("pf05_violations", f"""WITH {TICKS}, b AS (SELECT source, symbol, '1m' AS timeframe, ts_ms, price AS open, price - 10 AS high, 20.0 AS low, price AS close, seq, lag(ts_ms) OVER (PARTITION BY symbol ORDER BY seq) AS prev FROM ticks)
SELECT * FROM (
 SELECT source, symbol, timeframe, ts_ms, 'not_increasing' AS rule FROM b WHERE ts_ms <= prev UNION ALL
 SELECT source, symbol, timeframe, ts_ms, 'off_grid' FROM b WHERE ts_ms > prev AND (ts_ms - prev) % 60000 <> 0 UNION ALL
 SELECT source, symbol, timeframe, ts_ms, 'not_positive' FROM b WHERE least(open, high, low, close) <= 0 UNION ALL
 SELECT source, symbol, timeframe, ts_ms, 'high_below_body' FROM b WHERE high < open - 1e-12 UNION ALL
 SELECT source, symbol, timeframe, ts_ms, 'low_above_body' FROM b WHERE low > open + 1e-12 UNION ALL
 SELECT source, symbol, timeframe, ts_ms, 'high_below_low' FROM b WHERE high < low)""")
def _(spark, d):
    t = ticks(spark, d)
    return series.violations(t.select("source", "symbol", F.lit("1m").alias("timeframe"), "ts_ms", F.col("price").alias("open"), (F.col("price") - 10).alias("high"), F.lit(20.0).alias("low"), F.col("price").alias("close"), F.col("size").alias("volume"), F.col("seq").alias("ingest_seq")))


@register("pf06_contract", f"""WITH {bars_sql()} SELECT symbol, count(*) AS bars, min(ts_ms) AS min_ts, max(ts_ms) AS max_ts, (max(ts_ms) - min(ts_ms)) // {HOUR} + 1 - count(*) AS missing,
 count(DISTINCT source) AS source_values, count(DISTINCT timeframe) AS timeframe_values, count(*) FILTER (WHERE source <> 'events' OR timeframe <> '1h' OR open <> close) AS invalid FROM bars GROUP BY symbol""")
def _(spark, d):
    return series.contract(bars(spark, d), {"source": "events", "timeframe": "1h"}, [("open", "close")], HOUR)


_TWO = f"""{bars_sql()}, two AS (SELECT CASE WHEN symbol < 'm' THEN 'binance' ELSE 'a' END AS source, symbol, timeframe, ts_ms FROM bars WHERE ts_ms % 7 = 0 UNION ALL SELECT 'other', symbol, timeframe, ts_ms FROM bars)"""


@register("pf07_dominant_source", f"WITH {_TWO}, n AS (SELECT symbol, timeframe, source, count(*) AS bars FROM two GROUP BY ALL) SELECT symbol, timeframe, source, bars FROM n QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY source = 'binance' DESC, bars DESC, source) = 1")
def _(spark, d):
    b = bars(spark, d)
    return series.dominant_source(b.where("ts_ms % 7 = 0").withColumn("source", F.when(F.col("symbol") < "m", "binance").otherwise("a")).unionByName(b.withColumn("source", F.lit("other"))))


@register("wn10_gaps", f"""WITH {bars_sql('15m')}, x AS (SELECT source, symbol, timeframe, ts_ms, lead(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS nxt FROM bars)
SELECT source, symbol, timeframe, ts_ms AS before_ms, nxt AS after_ms, ts_ms + 900000 AS start_ms, nxt - 900000 AS end_ms, (nxt - ts_ms) // 900000 - 1 AS missing FROM x WHERE nxt - ts_ms > 900000""")
def _(spark, d):
    return series.gaps(bars(spark, d, "15m"), 900_000, block_ms=7 * 86_400_000)


_EVEN = more_bars("even", "1h", "seq % 2 = 0")


@register("st08_gap_repair", f"""WITH {bars_sql()}, {_EVEN}, g AS (SELECT source, symbol, timeframe, ts_ms AS before_ms, lead(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms) AS after_ms FROM even),
 f AS (SELECT * FROM g WHERE after_ms - before_ms > {HOUR}),
 bad AS (SELECT DISTINCT f.symbol, f.before_ms FROM f JOIN even e ON e.symbol = f.symbol AND e.ts_ms IN (f.before_ms, f.after_ms) JOIN bars b ON b.symbol = e.symbol AND b.ts_ms = e.ts_ms WHERE abs(e.close - b.close) > 1e-9 * greatest(1.0, abs(e.close)))
SELECT b.source, b.symbol, b.timeframe, b.ts_ms, b.open, b.high, b.low, b.close, b.volume FROM bars b JOIN f ON b.symbol = f.symbol AND b.ts_ms > f.before_ms AND b.ts_ms < f.after_ms
WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.symbol = f.symbol AND bad.before_ms = f.before_ms)""")
def _(spark, d):
    t = ticks(spark, d)
    return series.repair_gaps(tick_bars(t.where("seq % 2 = 0"), "1h"), tick_bars(t, "1h"), HOUR).select(*KEY, "ts_ms", "open", "high", "low", "close", "volume")


@register("srt01_tips", f"WITH {bars_sql()} SELECT source, symbol, timeframe, ts_ms, open, high, low, close FROM bars WHERE ts_ms + {HOUR} <= {_MID} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) = 1")
def _(spark, d):
    return series.tips(bars(spark, d), F.lit(_MID))


@register("srt02_last_n", f"WITH {bars_sql()} SELECT {_cols()} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) <= 5")
def _(spark, d):
    return series.last_n(bars(spark, d), 5)


@register("jn13_compare_tips", f"""WITH {bars_sql()}, {_EVEN}, l AS (SELECT * FROM bars WHERE ts_ms + {HOUR} <= {NOW_MS} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) = 1),
 r AS (SELECT * FROM even WHERE ts_ms + {HOUR} <= {NOW_MS} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) = 1)
SELECT coalesce(l.symbol, r.symbol) AS symbol, CASE WHEN l.symbol IS NULL THEN 'missing_left' WHEN r.symbol IS NULL THEN 'missing_right' WHEN l.ts_ms <> r.ts_ms THEN 'ts_mismatch' WHEN abs(l.open - r.open) > 1e-9 THEN 'open_mismatch'
 WHEN abs(l.high - r.high) > 1e-9 THEN 'high_mismatch' WHEN abs(l.low - r.low) > 1e-9 THEN 'low_mismatch' WHEN abs(l.close - r.close) > 1e-9 THEN 'close_mismatch' ELSE 'ok' END AS reason FROM l FULL JOIN r ON l.symbol = r.symbol""")
def _(spark, d):
    t = ticks(spark, d)
    return series.compare_tips(tick_bars(t, "1h"), tick_bars(t.where("seq % 2 = 0"), "1h"), F.lit(NOW), ["timeframe", "symbol"]).drop("timeframe")


@register("jn14_compare_history", f"""WITH {bars_sql()}, {_EVEN}, j AS (SELECT coalesce(l.symbol, r.symbol) AS symbol, coalesce(l.ts_ms, r.ts_ms) AS ts_ms, l.symbol IS NOT NULL AND r.symbol IS NOT NULL AS both_, l.symbol AS ls, r.symbol AS rs,
 l.symbol IS NOT NULL AND r.symbol IS NOT NULL AND (abs(l.open - r.open) > 1e-9 OR abs(l.high - r.high) > 1e-9 OR abs(l.low - r.low) > 1e-9 OR abs(l.close - r.close) > 1e-9) AS bad FROM bars l FULL JOIN even r ON l.symbol = r.symbol AND l.ts_ms = r.ts_ms),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol, bad ORDER BY ts_ms) AS nth FROM j)
SELECT symbol, count(*) FILTER (WHERE both_) AS both, count(*) FILTER (WHERE rs IS NULL) AS only_left, count(*) FILTER (WHERE ls IS NULL) AS only_right, count(*) FILTER (WHERE bad) AS different,
 coalesce(string_agg(ts_ms::VARCHAR, ',' ORDER BY ts_ms) FILTER (WHERE bad AND nth <= 5), '') AS examples FROM k GROUP BY symbol""")
def _(spark, d):
    t = ticks(spark, d)
    return series.compare_history(tick_bars(t, "1h"), tick_bars(t.where("seq % 2 = 0"), "1h"), ["symbol"])


@register("set01_priority_union", f"WITH {bars_sql()}, {_EVEN} SELECT {_cols()} FROM (SELECT *, 0 AS part FROM bars UNION ALL SELECT *, 1 AS part FROM even) QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms ORDER BY part DESC) = 1")
def _(spark, d):
    t = ticks(spark, d)
    return series.priority_union(tick_bars(t, "1h"), tick_bars(t.where("seq % 2 = 0"), "1h"))


@register("set02_timeline", f"WITH {bars_sql()} SELECT DISTINCT ts_ms FROM bars")
def _(spark, d):
    b = bars(spark, d)
    return series.timeline(b.where("symbol < 'm'"), b.where("symbol >= 'm'"))


@register("set03_overlap", f"WITH {bars_sql()} SELECT DISTINCT a.ts_ms FROM bars a JOIN bars b ON a.ts_ms = b.ts_ms WHERE a.symbol = 'click' AND b.symbol = 'purchase'")
def _(spark, d):
    b = bars(spark, d)
    return series.overlap(b.where("symbol = 'click'"), b.where("symbol = 'purchase'"), [])


@register("set04_except", f"WITH {bars_sql()}, {_EVEN} SELECT symbol, ts_ms, 'left' AS side FROM bars b WHERE NOT EXISTS (SELECT 1 FROM even e WHERE e.symbol = b.symbol AND e.ts_ms = b.ts_ms) UNION ALL SELECT symbol, ts_ms, 'right' FROM even e WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE e.symbol = b.symbol AND e.ts_ms = b.ts_ms)")
def _(spark, d):
    t = ticks(spark, d)
    a, b = tick_bars(t, "1h").select("symbol", "ts_ms"), tick_bars(t.where("seq % 2 = 0"), "1h").select("symbol", "ts_ms")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


@register("set05_universe", "SELECT n_name AS symbol FROM nation UNION SELECT r_name FROM region UNION SELECT event_type FROM events")
def _(spark, d):
    parts = [read(spark, d, t).select(F.col(c).alias("symbol")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("events", "event_type"))]
    return parts[0].union(parts[1]).union(parts[2]).dropDuplicates()


@register("wn17_first_difference", f"WITH {bars_sql()} SELECT symbol, ts_ms, round(change, 6) AS change FROM (SELECT symbol, ts_ms, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts_ms) AS change FROM bars) WHERE change IS NOT NULL")
def _(spark, d):
    return series.first_difference(bars(spark, d)).select("symbol", "ts_ms", F.round("change", 6).alias("change"))


@register("wn18_forward_returns", f"WITH {bars_sql()} SELECT symbol, ts_ms, round(lead(close, 1) OVER w / close - 1, 8) AS fwd_1, round(lead(close, 6) OVER w / close - 1, 8) AS fwd_6 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)")
def _(spark, d):
    from tidebar.operators.leakage import forward_returns

    return forward_returns(bars(spark, d), [1, 6], ["symbol"], 8)


@register("fn05_value_bars", f"WITH {TICKS} SELECT source, symbol, ts_ms, price AS open, price AS high, price AS low, price AS close, 0.0::DOUBLE AS volume FROM ticks WHERE price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms ORDER BY seq) = 1")
def _(spark, d):
    return series.value_bars(ticks(spark, d).withColumnRenamed("price", "value"), "seq")


@register("fn01_fn02_names", """SELECT n_name || '/x-' || n_nationkey || '_y ' AS raw, replace(replace(replace(upper(trim(n_name || '/x-' || n_nationkey || '_y ')), '/', ''), '-', ''), '_', '') AS symbol,
 CASE n_nationkey % 5 WHEN 0 THEN '1h' WHEN 1 THEN '15m' WHEN 2 THEN '4h' WHEN 3 THEN '3m' ELSE '9x' END AS timeframe FROM nation""")
def _(spark, d):
    n = read(spark, d, "nation")
    raw = F.concat("n_name", F.lit("/x-"), "n_nationkey", F.lit("_y "))
    tf = F.element_at(F.array(*map(F.lit, ["60", "15", "4HR", " 3min", "9x"])), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return n.select(raw.alias("raw"), S.normalize_symbol(raw).alias("symbol"), normalize_timeframe(tf).alias("timeframe"))


@register("fn03_epoch_ms", "SELECT o_orderkey, epoch_ms(o_orderdate) AS a, epoch_ms(o_orderdate) AS b, epoch_ms(o_orderdate) - 7200000 AS c, CAST(NULL AS BIGINT) AS e FROM orders")
def _(spark, d):
    o = read(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", S.epoch_ms(day).alias("a"), S.epoch_ms(F.concat(day, F.lit("T00:00:00Z"))).alias("b"), S.epoch_ms(F.concat(day, F.lit(" 00:00:00+02:00"))).alias("c"), S.epoch_ms(F.lit("soon")).alias("e"))


@register("fn04_expected_open", f"WITH {TICKS} SELECT seq, (ts_ms // {HOUR}) * {HOUR} - {HOUR} AS h1, (ts_ms // 604800000) * 604800000 - 604800000 AS w1, ((ts_ms - 345600000) // 604800000) * 604800000 + 345600000 - 604800000 AS w1_monday FROM ticks")
def _(spark, d):
    t = ticks(spark, d)
    return t.select("seq", S.expected_closed_open(F.col("ts_ms"), F.lit("1h")).alias("h1"), S.expected_closed_open(F.col("ts_ms"), F.lit("1w")).alias("w1"), S.expected_closed_open(F.col("ts_ms"), F.lit("1w"), 345_600_000).alias("w1_monday"))


@register("fn06_fib_prices", f"WITH {bars_sql()} SELECT symbol, ts_ms, " + ", ".join(f"round({'high - ' + str(r) + ' * (high - low)' if r <= 1 else 'low + ' + str(r) + ' * (high - low)'}, 6) AS {S.fib_column(r)}" for r in S.RATIOS) + " FROM bars")
def _(spark, d):
    return bars(spark, d).select("symbol", "ts_ms", *[F.round(S.fib_price(F.col("low"), F.col("high"), r), 6).alias(S.fib_column(r)) for r in S.RATIOS])


@register("fn07_round_grid", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 0.05 + 1e-9 * greatest(1, abs(l_extendedprice / 0.05)))::BIGINT AS steps_down, ceil(l_extendedprice / 0.05 - 1e-9 * greatest(1, abs(l_extendedprice / 0.05)))::BIGINT AS steps_up FROM lineitem")
def _(spark, d):
    p = F.col("l_extendedprice")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.round_grid(p, F.lit(0.05)) / 0.05).cast("long").alias("steps_down"), F.round(S.round_grid(p, F.lit(0.05), "ceil") / 0.05).cast("long").alias("steps_up"))


@register("fn08_fn09_fn11_numbers", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS safe, CASE WHEN event_id % 3 = 0 THEN value ELSE value + 1 END AS picked,
 CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"inf"' WHEN 2 THEN '"-inf"' ELSE '1.5' END AS json FROM events""")
def _(spark, d):
    e, k = read(spark, d, "events"), F.col("event_id")
    text = F.when(k % 4 == 0, F.element_at(F.array(*map(F.lit, ["", "NaN", "inf", "x"])), (k / 4 % 4 + 1).cast("int"))).otherwise(F.col("value").cast("string"))
    odd = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf")).when(k % 4 == 2, float("-inf")).otherwise(1.5)
    return e.select("event_id", S.safe_double(text).alias("safe"), S.first_nonzero(F.when(k % 3 == 0, 0.0).otherwise(F.col("value") + 1), F.col("value")).alias("picked"), S.json_number(odd).alias("json"))


@register("fn10_regex", "SELECT event_id, list_aggregate(regexp_extract_all(props, '[0-9]'), 'string_agg', ',') AS digits, regexp_extract('--pack=' || event_type || ' --symbol ' || user_id, '--symbol[ =](\\S+)', 1) AS symbol FROM events")
def _(spark, d):
    e = read(spark, d, "events")
    flags = F.concat(F.lit("--pack="), "event_type", F.lit(" --symbol "), "user_id")
    return e.select("event_id", F.array_join(F.regexp_extract_all("props", F.lit("[0-9]"), F.lit(0)), ",").alias("digits"), F.regexp_extract(flags, r"--symbol[ =](\S+)", 1).alias("symbol"))


@register("fn13_display", "SELECT event_id, printf('%+.2f%%', value) AS pct, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS at FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", S.show_percent(F.col("value"), 2, True).alias("pct"), S.show_utc(S.utc_ms(F.col("ts"))).alias("at"))


@register("fn14_clock_skew", f"WITH {TICKS} SELECT seq, CASE WHEN ts_ms < {_MID} THEN {_MID} - ts_ms WHEN ts_ms > {_MID} + 86400000 THEN ts_ms - {_MID} - 86400000 ELSE 0 END AS skew FROM ticks")
def _(spark, d):
    return ticks(spark, d).select("seq", S.clock_skew(F.lit(_MID), F.col("ts_ms"), F.lit(_MID + 86_400_000)).alias("skew"))




@register("jn01_asof_backward", f"""WITH {bars_sql()}, e AS (SELECT symbol, ts_ms, last(price ORDER BY seq) AS price, max(seq) AS eseq FROM ticks GROUP BY ALL)
SELECT b.symbol, b.ts_ms, b.close, e.price, e.eseq FROM bars b ASOF LEFT JOIN e ON b.symbol = e.symbol AND b.ts_ms >= e.ts_ms""")
def _(spark, d):
    e = ticks(spark, d).withColumn("eseq", F.col("seq"))
    return asof.asof_join(bars(spark, d).select("symbol", "ts_ms", "close"), e, ["symbol"], "ts_ms", "ts_ms", ["price", "eseq"], "seq")


@register("jn01_asof_blocks", f"""WITH {bars_sql()}, e AS (SELECT symbol, ts_ms, last(price ORDER BY seq) AS price, max(seq) AS eseq FROM ticks GROUP BY ALL)
SELECT b.symbol, b.ts_ms, b.close, e.price, e.eseq FROM bars b ASOF LEFT JOIN e ON b.symbol = e.symbol AND b.ts_ms >= e.ts_ms""")
def _(spark, d):
    e = ticks(spark, d).withColumn("eseq", F.col("seq"))
    return asof.asof_join(bars(spark, d).select("symbol", "ts_ms", "close"), e, ["symbol"], "ts_ms", "ts_ms", ["price", "eseq"], "seq", block_ms=86_400_000)


_NEAR = f"""{bars_sql()}, p AS (SELECT ts_ms, close FROM bars WHERE symbol = 'click'), t AS (SELECT ts_ms, close AS total FROM bars WHERE symbol = 'purchase'),
 b AS (SELECT p.*, t.ts_ms AS tb, t.total AS vb FROM p ASOF LEFT JOIN t ON p.ts_ms >= t.ts_ms), a AS (SELECT b.*, t.ts_ms AS ta, t.total AS va FROM b ASOF LEFT JOIN t ON b.ts_ms <= t.ts_ms),
 n AS (SELECT ts_ms, close, CASE WHEN tb IS NOT NULL AND (ta IS NULL OR ts_ms - tb <= ta - ts_ms) THEN CASE WHEN ts_ms - tb <= 7200000 THEN vb END WHEN ta - ts_ms <= 7200000 THEN va END AS total FROM a)"""


@register("jn02_asof_nearest", f"WITH {_NEAR} SELECT ts_ms, round(close / total * 100, 6) AS pct FROM n")
def _(spark, d):
    b = bars(spark, d)
    part, total = b.where("symbol = 'click'").select("timeframe", "ts_ms", "close"), b.where("symbol = 'purchase'").select("timeframe", "ts_ms", F.col("close").alias("total"))
    return asof.nearest_join(part, total, ["timeframe"], "ts_ms", ["total"], 7_200_000).select("ts_ms", F.round(F.col("close") / F.col("total") * 100, 6).alias("pct"))


@register("jn03_inverse_share", f"WITH {_NEAR} SELECT ts_ms, round(close / (total / 100), 6) AS total FROM n")
def _(spark, d):
    b = bars(spark, d)
    part, dom = b.where("symbol = 'click'").select("timeframe", "ts_ms", "close"), b.where("symbol = 'purchase'").select("timeframe", "ts_ms", F.col("close").alias("dominance"))
    return asof.nearest_join(part, dom, ["timeframe"], "ts_ms", ["dominance"], 7_200_000).select("ts_ms", F.round(F.col("close") / (F.col("dominance") / 100), 6).alias("total"))


@register("jn26_snap", f"""WITH {bars_sql()}, t AS (SELECT symbol, seq, ts_ms FROM ticks), g AS (SELECT symbol, ts_ms AS bar_ms FROM bars),
 b AS (SELECT t.*, bar_ms AS tb FROM t ASOF LEFT JOIN g ON t.symbol = g.symbol AND t.ts_ms >= g.bar_ms), a AS (SELECT b.*, g.bar_ms AS ta FROM b ASOF LEFT JOIN g ON b.symbol = g.symbol AND b.ts_ms <= g.bar_ms)
SELECT seq, CASE WHEN tb IS NOT NULL AND (ta IS NULL OR ts_ms - tb < ta - ts_ms) THEN tb ELSE ta END AS bar_ms FROM a""")
def _(spark, d):
    t = ticks(spark, d).select("symbol", "seq", "ts_ms")
    g = bars(spark, d).select("symbol", "ts_ms", F.col("ts_ms").alias("bar_ms"))
    return asof.nearest_join(t, g, ["symbol"], "ts_ms", ["bar_ms"], 1 << 60, later_wins=True).select("seq", "bar_ms")


@register("jn09_child_coverage", f"""WITH {bars_sql()}, {more_bars('q', '15m')}, c AS (SELECT symbol, (ts_ms // {HOUR}) * {HOUR} AS start, count(DISTINCT ts_ms) AS n, min(ts_ms) AS lo, max(ts_ms) AS hi FROM q GROUP BY ALL)
SELECT b.symbol, b.ts_ms, coalesce(c.n, 0) AS n_sub, coalesce(c.n = 4 AND lo = b.ts_ms AND hi = b.ts_ms + 2700000, false) AS complete FROM bars b LEFT JOIN c ON b.symbol = c.symbol AND b.ts_ms = c.start""")
def _(spark, d):
    return asof.child_coverage(bars(spark, d), bars(spark, d, "15m"), ["symbol"], HOUR, 900_000).select("symbol", "ts_ms", "n_sub", "complete")


_ORD = "o AS (SELECT seq AS order_id, symbol, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS side, price * CASE WHEN seq % 2 = 0 THEN 0.5 ELSE 1.5 END AS limit_price, ts_ms AS start_ms, ts_ms + 14400000 AS end_ms FROM ticks)"


@register("jn10_first_touch", f"""WITH {bars_sql('15m')}, {_ORD} SELECT order_id, min(b.ts_ms) AS touch_ms FROM o LEFT JOIN bars b ON b.symbol = o.symbol AND b.ts_ms >= start_ms AND b.ts_ms < end_ms
 AND CASE WHEN side > 0 THEN low <= limit_price + 1e-12 ELSE high >= limit_price - 1e-12 END GROUP BY order_id""")
def _(spark, d):
    t, even = ticks(spark, d), F.col("seq") % 2 == 0
    o = t.select(F.col("seq").alias("order_id"), "symbol", F.when(even, 1).otherwise(-1).alias("side"), (F.col("price") * F.when(even, 0.5).otherwise(1.5)).alias("limit_price"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 14_400_000).alias("end_ms"))
    return asof.first_touch(o, bars(spark, d, "15m"), ["symbol"], 14_400_000).select("order_id", "touch_ms")


@register("jn25_trades_in_window", f"WITH {TICKS} SELECT seq FROM ticks WHERE ts_ms + 7200000 >= {_MID} AND ts_ms <= {_MID} + 86400000")
def _(spark, d):
    return ticks(spark, d).where((F.col("ts_ms") + 7_200_000 >= _MID) & (F.col("ts_ms") <= _MID + 86_400_000)).select("seq")


@register("srt06_preferred_first", "SELECT n_name AS symbol, row_number() OVER (ORDER BY CASE n_name WHEN 'NATION_7' THEN 1 WHEN 'NATION_3' THEN 2 ELSE 3 END, n_name) AS place FROM (SELECT DISTINCT n_name FROM nation)")
def _(spark, d):
    pref = F.array(F.lit("NATION_7"), F.lit("NATION_3"))
    at = F.nullif(F.array_position(pref, F.col("n_name")), F.lit(0))
    from pyspark.sql import Window

    return read(spark, d, "nation").select("n_name").distinct().select(F.col("n_name").alias("symbol"), F.row_number().over(Window.orderBy(at.asc_nulls_last(), "n_name")).alias("place"))
