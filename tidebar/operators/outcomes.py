"""Outcomes of independent signals on bars: scheduling, first barrier, funding, excursions, equity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.asof import asof_join, interval_join
from tidebar.operators.scan import block_scan


def index_bars(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("ts_ms")) - 1)


def schedule(signals: DataFrame, bars: DataFrame, keys: list[str], latency: int = 0, launch_ms: int | None = None) -> DataFrame:
    """Signals with the bar that executes them, 1 + latency bars after their own, or why there is none."""
    b = index_bars(bars, keys)
    own = signals.join(b.select(*keys, "ts_ms", F.col("i").alias("signal_i")), [*keys, "ts_ms"], "left").withColumn("entry_i", F.col("signal_i") + 1 + latency)
    ex = b.select(*keys, F.col("i").alias("entry_i"), F.col("ts_ms").alias("entry_ts_ms"), F.col("open").alias("entry_open"))
    out = own.join(ex, [*keys, "entry_i"], "left")
    early = F.lit(False) if launch_ms is None else F.col("ts_ms") < launch_ms
    return out.withColumn("skip", F.when(F.col("signal_i").isNull(), "no_bar").when(early, "before_launch").when(F.col("entry_ts_ms").isNull(), "past_end"))


def first_barrier(entries: DataFrame, bars: DataFrame, keys: list[str], max_hold: int, same_bar: str = "adverse", stop_market: bool = True) -> DataFrame:
    """First exit of each entry (signal_id, side, entry_i, stop, target): stop, target or time, the entry bar included.

    An open beyond the stop fills at the open (or at the stop, if that is a limit); an open beyond the
    target fills at the target. A bar that reaches both is settled by ``same_bar``. Bars meet entries by
    a bucket of their index, an entry lies in at most two, so no series is searched as a whole.
    """
    b = index_bars(bars, keys).withColumn("_bk", F.floor(F.col("i") / (max_hold + 1)))
    e = entries.withColumn("_bk", F.explode(F.array(F.floor(F.col("entry_i") / (max_hold + 1)), F.floor(F.col("entry_i") / (max_hold + 1)) + 1)))
    j = e.join(b, [*keys, "_bk"]).where("i BETWEEN entry_i AND entry_i + " + str(max_hold))
    up = F.col("side") > 0
    side, o = F.col("side"), F.col("open")
    bad, good = F.when(up, F.col("low")).otherwise(F.col("high")), F.when(up, F.col("high")).otherwise(F.col("low"))
    stop_at = lambda p: F.coalesce(side * p <= side * F.col("stop"), F.lit(False))
    target_at = lambda p: F.coalesce(side * p >= side * F.col("target"), F.lit(False))
    adverse, favour = stop_at(bad), target_at(good)
    both = adverse & favour & ~stop_at(o) & ~target_at(o)
    stop_first = F.lit(same_bar == "adverse")
    reason = F.when(stop_at(o), "stop").when(target_at(o), "target").when(both, F.when(stop_first, "stop").otherwise("target")).when(adverse, "stop").when(favour, "target").when(F.col("i") == F.col("entry_i") + max_hold, "max_hold")
    price = F.when(stop_at(o), o if stop_market else F.col("stop")).when(reason == "stop", F.col("stop")).when(reason == "target", F.col("target")).otherwise(o)
    hit = j.withColumn("reason", reason).withColumn("price", price).withColumn("ambiguous", both)
    # what the position has seen up to its exit
    hit = hit.withColumn("_worst", side * (bad - F.col("entry_open"))).withColumn("_best", side * (good - F.col("entry_open")))
    found = hit.where("reason IS NOT NULL").groupBy("signal_id").agg(F.min(F.struct("i", "ts_ms", "reason", "price", "ambiguous")).alias("x"))
    out = entries.join(found, "signal_id", "left").select(*entries.columns, F.col("x.i").alias("exit_i"), F.col("x.ts_ms").alias("exit_ts_ms"), F.coalesce("x.reason", F.lit("open")).alias("reason"), F.col("x.price").alias("exit_price"), F.coalesce("x.ambiguous", F.lit(False)).alias("ambiguous"))
    seen = hit.join(out.select("signal_id", "exit_i"), "signal_id").where("exit_i IS NULL OR i <= exit_i")
    ex = seen.groupBy("signal_id").agg(F.least(F.min("_worst"), F.lit(0.0)).alias("mae"), F.greatest(F.max("_best"), F.lit(0.0)).alias("mfe"))
    return out.join(ex, "signal_id", "left").withColumn("hold_bars", F.col("exit_i") - F.col("entry_i"))


def replay_ambiguous(outcomes: DataFrame, children: DataFrame, keys: list[str], parent_ms: int, child_ms: int) -> DataFrame:
    """Ambiguous exits settled on the bars of a smaller step, where all of them are there."""
    amb = outcomes.where("ambiguous").select("signal_id", *keys, "side", "stop", "target", F.col("exit_ts_ms").alias("_p"))
    start = (F.floor(F.col("ts_ms") / parent_ms) * parent_ms).cast("long")
    c = children.withColumn("_p", start).join(amb, [*keys, "_p"])
    side = F.col("side")
    bad, good = F.when(side > 0, F.col("low")).otherwise(F.col("high")), F.when(side > 0, F.col("high")).otherwise(F.col("low"))
    s, t = side * bad <= side * F.col("stop"), side * good >= side * F.col("target")
    first = c.groupBy("signal_id").agg(F.count_distinct("ts_ms").alias("_n"), F.min(F.when(s, F.col("ts_ms"))).alias("_s"), F.min(F.when(t, F.col("ts_ms"))).alias("_t"))
    settled = first.where(F.col("_n") == parent_ms // child_ms).where("_s IS NOT NULL OR _t IS NOT NULL").where("_s IS NULL OR _t IS NULL OR _s <> _t")
    settled = settled.select("signal_id", F.when(F.col("_t").isNull() | (F.col("_s") < F.col("_t")), "stop").otherwise("target").alias("_r"))
    out = outcomes.join(settled, "signal_id", "left")
    price = F.when(F.col("_r") == "stop", F.col("stop")).when(F.col("_r") == "target", F.col("target")).otherwise(F.col("exit_price"))
    return out.withColumn("exit_price", price).withColumn("reason", F.coalesce("_r", "reason")).withColumn("ambiguous", F.col("ambiguous") & F.col("_r").isNull()).drop("_r")


def funding(holdings: DataFrame, settlements: DataFrame, bars: DataFrame, width: int) -> DataFrame:
    """Charges of every settlement in [entry, exit) of a holding: -side * |qty| * mark * rate.

    The mark is the open of the bar that opens at the settlement, else the close of the one before;
    before the first bar, that one's open.
    """
    if settlements.groupBy("symbol", "ts_ms").count().where("count > 1").limit(1).count():
        raise ValueError("settlements repeat a time")
    own = bars.select("symbol", "ts_ms", F.col("ts_ms").alias("bar_ts"), "open", "close")
    s = asof_join(settlements, own, ["symbol"], "ts_ms", "ts_ms", ["bar_ts", "open", "close"])
    first = bars.groupBy("symbol").agg(F.min_by("open", "ts_ms").alias("_first"))
    exact = F.coalesce(F.col("bar_ts") == F.col("ts_ms"), F.lit(False))
    s = s.join(first, "symbol", "left").select("symbol", F.col("ts_ms").alias("settle_ms"), "rate", exact.alias("exact"), F.when(exact, F.col("open")).otherwise(F.coalesce("close", "_first")).alias("mark"))
    j = interval_join(s, holdings, ["symbol"], "settle_ms", "entry_ts_ms", "exit_ts_ms", width)
    return j.withColumn("charge", -F.col("side") * F.abs("qty") * F.col("mark") * F.col("rate"))


def mark_equity(trades: DataFrame, bars: DataFrame, width: int, start: float = 0.0, block_ms: int | None = None) -> DataFrame:
    """Per symbol and bar: realised result so far, open result at the close, and their sum. With ``block_ms`` in blocks of time."""
    real = trades.groupBy("symbol", "exit_ts_ms").agg(F.sum("pnl").alias("p"))
    if block_ms:
        real = block_scan(real, ["symbol"], "exit_ts_ms", [], block_ms, {"realised": ("sum", F.col("p"))})
    else:
        real = real.withColumn("realised", F.sum("p").over(Window.partitionBy("symbol").orderBy("exit_ts_ms").rowsBetween(Window.unboundedPreceding, 0)))
    b = asof_join(bars.select("symbol", "ts_ms", "close"), real, ["symbol"], "ts_ms", "exit_ts_ms", ["realised"], block_ms=block_ms)
    open_ = interval_join(bars.select("symbol", "ts_ms", "close"), trades.select("symbol", "side", "qty", "entry_price", "entry_ts_ms", "exit_ts_ms"), ["symbol"], "ts_ms", "entry_ts_ms", "exit_ts_ms", width)
    live: Column = F.sum(F.col("side") * (F.col("close") - F.col("entry_price")) * F.col("qty"))
    u = open_.groupBy("symbol", "ts_ms").agg(live.alias("unrealised"))
    out = b.join(u, ["symbol", "ts_ms"], "left").withColumn("realised", F.coalesce("realised", F.lit(0.0))).withColumn("unrealised", F.coalesce("unrealised", F.lit(0.0)))
    return out.withColumn("equity", start + F.col("realised") + F.col("unrealised"))
