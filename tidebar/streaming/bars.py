"""Streams of closed bars: frame parsing, idempotent upserts, online resampling, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.scalar import clock_skew, expected_closed_open, safe_double, skew_limit
from tidebar.timeframes import step_ms


def closed_frames(frames: DataFrame, body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Closed bars of kline frames of two venues; acknowledgements, forming bars and what is no JSON go.

    ``keep``: columns of ``frames`` that stay beside the bars, such as the order of arrival.
    """
    one = "struct<e:string,k:struct<t:bigint,s:string,i:string,o:string,h:string,l:string,c:string,v:string,x:boolean>>"
    two = "struct<topic:string,data:array<struct<start:bigint,interval:string,open:string,high:string,low:string,close:string,volume:string,confirm:boolean>>>"
    read = frames.select(*keep, F.from_json(body, one).alias("a"), F.from_json(body, two).alias("b"))  # each parsed once
    a, b = F.col("a"), F.col("b")
    names = ("open", "high", "low", "close", "volume")
    first = F.when(a["k"]["x"], F.array(F.struct(F.lit("a").alias("exchange"), a["k"]["s"].alias("symbol"), a["k"]["i"].alias("timeframe"), a["k"]["t"].alias("ts_ms"), *[a["k"][k].alias(n) for k, n in zip("ohlcv", names, strict=True)])))
    closed = F.filter(b["data"], lambda x: F.coalesce(x["confirm"], F.lit(False)))
    second = F.transform(closed, lambda x: F.struct(F.lit("b").alias("exchange"), F.element_at(F.split(b["topic"], r"\."), -1).alias("symbol"), x["interval"].alias("timeframe"), x["start"].alias("ts_ms"), *[x[n].alias(n) for n in names]))
    rows = read.select(*keep, F.explode(F.coalesce(first, second)).alias("r"))
    return rows.select(*keep, "r.exchange", "r.symbol", "r.timeframe", "r.ts_ms", *[safe_double(F.col(f"r.{n}")).alias(n) for n in names])


def upsert_stream(stream: DataFrame, store, checkpoint: str, values: list[str], optional: list[str], arrival: str, stamp: str = "updated_at_ms"):
    """A query that keeps the store up to date with closed bars; a repeated batch changes nothing.

    ``arrival`` orders the frames: of several of one bar the last one wins, within a batch as between batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert_changed(batch, values, optional, stamp, F.unix_millis(F.current_timestamp()), arrival)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def refresh_tips(store, polled: DataFrame, values: list[str], optional: list[str], now_ms: int, newest: int = 5, stamp: str = "updated_at_ms") -> DataFrame:
    """Merge the ``newest`` polled bars of every series into the store, then delete bars that still form; the deleted per series."""
    last = Window.partitionBy(*store.key).orderBy(F.desc("ts_ms"))
    tips = polled.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= newest).drop("_n")
    store.upsert_changed(tips, values, optional, stamp, F.lit(now_ms).cast("long"))
    return store.purge(F.col("ts_ms") + step_ms(F.col("timeframe")) > F.lit(now_ms))


def online_resample(stream: DataFrame, time: str, length: str, watermark: str, keys: list[str], start: str | None = None) -> DataFrame:
    """Bars of a larger step, emitted once the watermark has passed their end."""
    at = F.window(time, length, length, start) if start else F.window(time, length)
    o = F.struct(F.col(time))
    agg = stream.withWatermark(time, watermark).groupBy(*keys, at.alias("w")).agg(F.min_by("open", o).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", o).alias("close"), F.sum("volume").alias("volume"))
    return agg.select(*keys, F.unix_millis("w.start").alias("ts_ms"), "open", "high", "low", "close", "volume")


def tip_state(df: DataFrame, now_ms: Column, grace_ms: int, most_steps: float = 2.0) -> DataFrame:
    """ok, stale_after_close, awaiting_just_closed, missing_closed_bar or none, of series with their newest time ``last_ms``."""
    step, want = step_ms(F.col("timeframe")), expected_closed_open(now_ms, F.col("timeframe"))
    late = now_ms - (want + step)
    state = (
        F.when(step.isNull(), "bad_timeframe").when(F.col("last_ms").isNull(), "none")
        .when(F.col("last_ms") >= want, F.when(now_ms - (F.col("last_ms") + step) > F.floor(step * most_steps), "stale_after_close").otherwise("ok"))
        .when(late.between(0, grace_ms), "awaiting_just_closed").otherwise("missing_closed_bar")
    )
    return df.withColumn("state", state).withColumn("expected_ms", want)


def tip_gate(df: DataFrame) -> DataFrame:
    """Code of a tip (timeframe, tip_ms, before_ms, server_ms, after_ms): the first check that fails names it."""
    want = expected_closed_open(F.col("server_ms"), F.col("timeframe"))
    skew = clock_skew(F.col("before_ms"), F.col("server_ms"), F.col("after_ms"))
    code = F.when(F.col("server_ms").isNull(), "NO_SERVER_TIME").when(F.col("tip_ms").isNull(), "CANDLE_MISSING").when(skew > skew_limit(F.col("timeframe")), "CLOCK_SKEW").when(F.col("tip_ms") < want, "CANDLE_STALE").when(F.col("tip_ms") > want, "CANDLE_AHEAD").otherwise("PASS")
    return df.withColumn("code", code)


def allowed(series: DataFrame, flagged: DataFrame, fleet_reason: str | None) -> DataFrame:
    """Series that may be used: a fleet-wide flag blocks all, else each one's own."""
    out = series.join(flagged.select("exchange", "symbol", "timeframe", F.col("reason").alias("_r")), ["exchange", "symbol", "timeframe"], "left")
    why = F.coalesce(F.lit(fleet_reason).cast("string"), F.col("_r"))
    return out.withColumn("blocked_by", why).withColumn("allow", why.isNull()).drop("_r")


def uncovered(wanted: DataFrame, covered: DataFrame, overlap_ms: int) -> DataFrame:
    """Ranges still to fetch: all without coverage, else what lies before it and what follows it, with an overlap."""
    j = wanted.join(covered, "key", "left")
    full = F.array(F.struct(F.col("want_from").alias("from_ms"), F.col("want_to").alias("to_ms")))
    before = F.when(F.col("want_from") < F.col("have_from"), F.struct(F.col("want_from").alias("from_ms"), F.col("have_from").alias("to_ms")))
    after = F.when(F.col("want_to") > F.col("have_to"), F.struct(F.greatest(F.col("have_to") - overlap_ms, F.col("want_from")).alias("from_ms"), F.col("want_to").alias("to_ms")))
    return j.select("key", F.explode(F.when(F.col("have_from").isNull(), full).otherwise(F.array_compact(F.array(before, after)))).alias("r")).select("key", "r.*")
