"""Freshness and frame queries as batches over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.plans.registry import register
from tidebar.plans.views import NOW_MS, TICKS, bars, bars_sql, more_bars, tick_bars, ticks
from tidebar.streaming import bars as sb

H = 3_600_000


@register("st01_closed_frames", f"WITH {TICKS} SELECT CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS exchange, symbol, ts_ms, price AS close FROM ticks WHERE seq % 5 NOT IN (3, 4)")
def _(spark, d):
    k, p = F.col("seq"), F.col("price").cast("string")
    closed = F.when(k % 5 == 3, "false").otherwise("true")
    a = F.concat(F.lit('{"e":"kline","k":{"t":'), "ts_ms", F.lit(',"s":"'), "symbol", F.lit('","i":"1h","o":"1","h":"2","l":"0.5","c":"'), p, F.lit('","v":"3","x":'), closed, F.lit("}}"))
    b = F.concat(F.lit('{"topic":"kline.60.'), "symbol", F.lit('","data":[{"start":'), "ts_ms", F.lit(',"interval":"60","open":"1","high":"2","low":"0.5","close":"'), p, F.lit('","volume":"3","confirm":'), closed, F.lit("}]}"))
    value = F.when(k % 5 == 4, "pong").when(k % 2 == 0, a).otherwise(b)
    return sb.closed_frames(ticks(spark, d).select(value.alias("value"))).select("exchange", "symbol", "ts_ms", "close")


_LAST = f"{bars_sql()}, l AS (SELECT symbol, timeframe, max(ts_ms) AS last_ms FROM bars GROUP BY ALL)"


@register("st04_tip_state", f"""WITH {_LAST}, w AS (SELECT *, ({NOW_MS} // {H}) * {H} - {H} AS expected_ms FROM l) SELECT symbol, expected_ms, CASE WHEN last_ms >= expected_ms THEN CASE WHEN {NOW_MS} - (last_ms + {H}) > {2 * H} THEN 'stale_after_close' ELSE 'ok' END
 WHEN {NOW_MS} - (expected_ms + {H}) BETWEEN 0 AND 60000 THEN 'awaiting_just_closed' ELSE 'missing_closed_bar' END AS state FROM w""")
def _(spark, d):
    last = bars(spark, d).groupBy("symbol", "timeframe").agg(F.max("ts_ms").alias("last_ms"))
    return sb.tip_state(last, F.lit(NOW_MS), 60_000).select("symbol", "expected_ms", "state")


@register("st05_tip_gate", f"""WITH {TICKS}, x AS (SELECT seq, ts_ms AS server, (ts_ms // 900000) * 900000 - 900000 + (seq % 3 - 1) * 900000 AS tip, CASE WHEN seq % 7 = 0 THEN 60000 ELSE 0 END AS off FROM ticks)
SELECT seq, CASE WHEN seq % 11 = 0 THEN 'CANDLE_MISSING' WHEN off > 5000 THEN 'CLOCK_SKEW' WHEN seq % 3 = 0 THEN 'CANDLE_STALE' WHEN seq % 3 = 2 THEN 'CANDLE_AHEAD' ELSE 'PASS' END AS code FROM x""")
def _(spark, d):
    k, ts = F.col("seq"), F.col("ts_ms")
    off = F.when(k % 7 == 0, 60_000).otherwise(0)
    tip = F.when(k % 11 != 0, (F.floor(ts / 900_000) * 900_000 - 900_000 + (k % 3 - 1) * 900_000).cast("long"))
    x = ticks(spark, d).select("seq", F.lit("15m").alias("timeframe"), tip.alias("tip_ms"), (ts + off).alias("before_ms"), ts.alias("server_ms"), (ts + off + 100).alias("after_ms"))
    return sb.tip_gate(x).select("seq", "code")


@register("st07_flag_listing", f"WITH {TICKS} SELECT seq, CASE WHEN seq % 4 = 0 THEN 'META_PARSE_FAIL' ELSE 'ok' END AS status FROM ticks")
def _(spark, d):
    k = F.col("seq")
    meta = F.when(k % 4 == 0, "{broken").otherwise(F.concat(F.lit('{"reason":"'), "symbol", F.lit('"}')))
    parsed = F.from_json(meta, "struct<reason:string>", {"mode": "PERMISSIVE"})
    return ticks(spark, d).select("seq", F.when(parsed["reason"].isNull(), "META_PARSE_FAIL").otherwise("ok").alias("status"))


@register("st10_uncovered", f"""WITH {TICKS}, w AS (SELECT user_id AS key, min(ts_ms) AS want_from, max(ts_ms) AS want_to FROM ticks GROUP BY 1), h AS (SELECT user_id AS key, min(ts_ms) AS have_from, max(ts_ms) AS have_to FROM ticks WHERE seq % 3 = 0 GROUP BY 1), j AS (SELECT w.*, have_from, have_to FROM w LEFT JOIN h USING (key))
SELECT key, want_from AS from_ms, want_to AS to_ms FROM j WHERE have_from IS NULL UNION ALL SELECT key, want_from, have_from FROM j WHERE want_from < have_from UNION ALL SELECT key, greatest(have_to - 7200000, want_from), want_to FROM j WHERE want_to > have_to""")
def _(spark, d):
    t = ticks(spark, d)
    w = t.groupBy(F.col("user_id").alias("key")).agg(F.min("ts_ms").alias("want_from"), F.max("ts_ms").alias("want_to"))
    h = t.where("seq % 3 = 0").groupBy(F.col("user_id").alias("key")).agg(F.min("ts_ms").alias("have_from"), F.max("ts_ms").alias("have_to"))
    return sb.uncovered(w, h, 7_200_000)


_EXTRA = {"quote_volume": "double", "trades": "long", "taker_buy_base": "double", "taker_buy_quote": "double"}
_VALUES = ["open", "high", "low", "close", "volume", *_EXTRA]


@register("st02_upsert_stream", f"WITH {TICKS}, sent AS (SELECT symbol, ts_ms, price, 2 * seq AS arrival FROM ticks UNION ALL SELECT symbol, ts_ms, price + 1, 2 * seq + 1 FROM ticks WHERE seq % 3 = 0) SELECT symbol, ts_ms, arg_max(price, arrival) AS close FROM sent GROUP BY symbol, ts_ms")
def _(spark, d):
    """The event file as a stream of closed frames that keeps a store; what the store holds afterwards.

    Every third event is sent a second time with a corrected price, in the same batch.
    """
    from tidebar.functions.scalar import utc_ms
    from tidebar.operators.upsert import Store
    from tidebar.plans.views import read
    from tidebar.schemas import LIVE_BARS
    from tidebar.scratch import scratch_path

    e = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    again = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    e = e.withColumn("later", F.explode(again)).withColumn("arrival", 2 * F.col("event_id") + F.col("later"))
    p = (F.col("value") + F.col("later")).cast("string")
    frame = F.concat(F.lit('{"e":"kline","k":{"t":'), utc_ms(F.col("ts")), F.lit(',"s":"'), "event_type", F.lit('","i":"1h","o":"1","h":"2","l":"0.5","c":"'), p, F.lit('","v":"3","x":true}}'))
    frames = sb.closed_frames(e.select(frame.alias("value"), "arrival"), keep=("arrival",)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in _EXTRA.items()])
    store = Store(spark, scratch_path(spark, "live"), ["exchange", "symbol", "timeframe"], LIVE_BARS)
    sb.upsert_stream(frames, store, scratch_path(spark, "cp"), _VALUES, list(_EXTRA), "arrival").start().awaitTermination()
    return store.read().select("symbol", "ts_ms", "close")


@register("st03_refresh_tips", f"""WITH {bars_sql('1h', 'even', 'seq % 2 = 0')}, {more_bars('every', '1h')}, tips AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) <= 5),
 j AS (SELECT coalesce(e.symbol, t.symbol) AS symbol, coalesce(e.ts_ms, t.ts_ms) AS ts_ms, CASE WHEN t.symbol IS NULL THEN e.close ELSE t.close END AS close FROM even e FULL JOIN tips t ON e.symbol = t.symbol AND e.ts_ms = t.ts_ms)
SELECT symbol, ts_ms, close FROM j WHERE ts_ms + {H} <= (SELECT max(ts_ms) FROM every) + {H} - 1""")
def _(spark, d):
    """A store of bars from every other event; the five newest bars of all events are merged, and what still forms goes."""
    from tidebar.operators.upsert import Store
    from tidebar.schemas import LIVE_BARS, conform
    from tidebar.scratch import scratch_path

    t = ticks(spark, d)
    live = lambda b: conform(b.withColumnRenamed("source", "exchange").withColumn("updated_at_ms", F.lit(1)), LIVE_BARS)
    store = Store(spark, scratch_path(spark, "tips"), ["exchange", "symbol", "timeframe"], LIVE_BARS)
    store.write(live(tick_bars(t.where("seq % 2 = 0"), "1h")))
    polled = live(tick_bars(t, "1h"))
    now = polled.agg(F.max("ts_ms")).first()[0] + H - 1
    sb.refresh_tips(store, polled, _VALUES, list(_EXTRA), now)
    return store.read().select("symbol", "ts_ms", "close")


@register("st09_online_resample", f"WITH {bars_sql()}, w AS (SELECT max(ts_ms) - 600000 AS wm FROM ticks) SELECT symbol, ts_ms, open, high, low, close, volume FROM bars, w WHERE ts_ms + {H} <= wm")
def _(spark, d):
    """Hourly bars of the event stream, as far as the watermark has closed them."""
    from tidebar.plans.views import read
    from tidebar.scratch import scratch_path

    e = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    t = e.select(F.col("event_type").alias("symbol"), F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))
    out = scratch_path(spark, "hours")
    sb.online_resample(t, "ts", "1 hour", "10 minutes", ["symbol"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@register("st06_allowed", f"WITH {TICKS}, l AS (SELECT symbol, user_id, seq FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, user_id ORDER BY seq DESC) = 1) SELECT symbol, user_id::VARCHAR AS timeframe, seq % 4 = 0 AS allow FROM l")
def _(spark, d):
    from tidebar.operators.upsert import flags

    t = ticks(spark, d).select(F.lit("x").alias("exchange"), "symbol", F.col("user_id").cast("string").alias("timeframe"), "seq")
    key = ["exchange", "symbol", "timeframe"]
    log = t.select(*key, "seq", F.when(F.col("seq") % 4 != 0, "set").otherwise("clear").alias("action"), F.lit("r").alias("reason"))
    return sb.allowed(t.select(*key).distinct(), flags(log, key), None).select("symbol", "timeframe", "allow")
