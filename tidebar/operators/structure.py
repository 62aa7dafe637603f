"""Causal price structure: swings, labels, bias, legs, levels and the feature matrix per bar.

Every step is a window on the series key; what becomes known later than its own time carries the time
from which it is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.scalar import RATIOS, RETRACEMENTS, fib_column, fib_price, nearest_ratio, retracement
from tidebar.operators.asof import asof_join, prefix_nearest
from tidebar.operators.scan import block_scan
from tidebar.schemas import KEY
from tidebar.scratch import written


def swings(bars: DataFrame, left: int = 2, right: int = 2, keys: list[str] = KEY) -> DataFrame:
    """Pivots that are the only extreme of ``left`` bars before to ``right`` after, known ``right`` bars later."""
    w = Window.partitionBy(*keys).orderBy("ts_ms")
    before, after = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    full = F.lag("ts_ms", left).over(w).isNotNull() & F.lead("ts_ms", right).over(w).isNotNull()
    high = full & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    low = full & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    at = bars.select(*keys, F.col("ts_ms").alias("pivot_ts_ms"), F.lead("ts_ms", right).over(w).alias("confirm_ts_ms"), (F.row_number().over(w) - 1).alias("pivot_i"), high.alias("is_high"), low.alias("is_low"), "high", "low")
    found = F.filter(F.array(F.when(F.col("is_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"))), F.when(F.col("is_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price")))), lambda x: x.isNotNull())
    rows = at.where("is_high OR is_low").withColumn("s", F.explode(found)).select(*keys, "pivot_i", (F.col("pivot_i") + right).alias("confirm_i"), "pivot_ts_ms", "confirm_ts_ms", "s.kind", "s.price")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("confirm_i", "pivot_i", F.desc("kind"))) - 1
    return rows.withColumn("swing_id", number)


def label_events(found: DataFrame, keys: list[str] = KEY, block_ms: int | None = None) -> DataFrame:
    """Each swing's label against the last of its kind (HH, LH, HL, LL, first SH or SL) and the bias after it, with the sum that it is the sign of.

    With ``block_ms`` in blocks of the time from which swings are known.
    """
    before = {"_last": F.col("price"), "prev_swing_id": F.col("swing_id")}
    if block_ms:
        e = block_scan(found, [*keys, "kind"], "confirm_ts_ms", ["swing_id"], block_ms, {n: ("lag", c) for n, c in before.items()})
    else:
        e = found.withColumns({n: F.lag(c).over(Window.partitionBy(*keys, "kind").orderBy("swing_id")) for n, c in before.items()})
    last = F.col("_last")
    label = F.when(F.col("kind") == "high", F.when(last.isNull(), "SH").when(F.col("price") > last, "HH").otherwise("LH")).otherwise(F.when(last.isNull(), "SL").when(F.col("price") > last, "HL").otherwise("LL"))
    out = e.select(*keys, "swing_id", "kind", "price", "pivot_i", "pivot_ts_ms", "confirm_ts_ms", label.alias("label"), "prev_swing_id")
    step = F.when(F.col("label").isin("HH", "HL"), 1).when(F.col("label").isin("LH", "LL"), -1).otherwise(0)
    if block_ms:
        out = block_scan(out, keys, "confirm_ts_ms", ["swing_id"], block_ms, {"bias_sum": ("sum", step)})
    else:
        out = out.withColumn("bias_sum", F.sum(step).over(Window.partitionBy(*keys).orderBy("swing_id").rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("bias_sum", F.col("bias_sum").cast("long")).withColumn("bias", F.signum("bias_sum").cast("int"))


def legs(events: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Moves between swings of different kinds that follow each other, with the next leg's retracement of them."""
    w = Window.partitionBy(*keys).orderBy("pivot_i", F.desc("kind"))
    lag = lambda c: F.lag(c).over(w)
    e = events.select(
        *keys, "kind", lag("kind").alias("start_kind"), F.col("swing_id").alias("end_swing_id"), lag("swing_id").alias("start_swing_id"), F.col("pivot_ts_ms").alias("end_ts_ms"), lag("pivot_ts_ms").alias("start_ts_ms"),
        F.col("price").alias("end_price"), lag("price").alias("start_price"), F.greatest("confirm_ts_ms", lag("confirm_ts_ms")).alias("known_ts_ms"), "bias", F.row_number().over(w).alias("_n"),
    ).where("kind <> start_kind")
    up = F.col("end_price") > F.col("start_price")
    size, mid = F.abs(F.col("end_price") - F.col("start_price")), 0.5 * (F.abs("end_price") + F.abs("start_price"))
    e = e.withColumn("direction", F.when(up, "up").otherwise("down")).withColumn("length_abs", size).withColumn("length_pct", F.when(mid > 0, size / mid))
    e = e.withColumn("leg_kind", F.when(F.col("bias") == 0, "unknown").when((F.col("bias") > 0) == up, "impulse").otherwise("correction"))
    nxt = Window.partitionBy(*keys).orderBy("_n")
    e = e.withColumn("retrace_pct", retracement(F.col("start_price"), F.col("end_price"), F.lead("end_price").over(nxt))).withColumn("leg_id", F.row_number().over(nxt) - 1)
    by_known = Window.partitionBy(*keys).orderBy("known_ts_ms", "leg_id")
    e = e.withColumn("fib_label", nearest_ratio(F.abs("retrace_pct"))).withColumn("retrace_known_ms", F.lead("known_ts_ms").over(by_known))
    return e.drop("_n", "kind", "start_kind", "bias")


def levels(found: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Every swing low is support, every swing high resistance, from when it is confirmed."""
    return found.select(*keys, F.col("swing_id").alias("level_id"), F.when(F.col("kind") == "high", "resistance").otherwise("support").alias("kind"), "price", F.col("pivot_ts_ms").alias("origin_ts_ms"), "confirm_ts_ms")


def nearest_levels(bars: DataFrame, lv: DataFrame, keys: list[str] = KEY, counts: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Nearest confirmed support at or below and resistance at or above the close, with distances.

    ``counts``: columns of ``bars`` with the numbers of supports and of resistances known by then, if it has them.
    """
    out = prefix_nearest(bars, lv.where("kind = 'support'"), keys, "ts_ms", "close", "confirm_ts_ms", "price", "level_id", True, "nearest_support", counts[0])
    out = prefix_nearest(out, lv.where("kind = 'resistance'"), keys, "ts_ms", "close", "confirm_ts_ms", "price", "level_id", False, "nearest_resistance", counts[1])
    c = F.nullif(F.col("close"), F.lit(0.0))
    return out.withColumn("dist_support_pct", (F.col("close") - F.col("nearest_support")) / c).withColumn("dist_resistance_pct", (F.col("nearest_resistance") - F.col("close")) / c)


def last_swings(bars: DataFrame, found: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Price, time and distance of the last confirmed swing high and low at every bar."""
    out = bars
    for kind, name in (("high", "sh"), ("low", "sl")):
        own = found.where(F.col("kind") == kind).select(*keys, "confirm_ts_ms", "swing_id", F.col("price").alias(f"last_{name}_price"), F.col("pivot_ts_ms").alias(f"last_{name}_ts_ms"))
        out = asof_join(out, own, keys, "ts_ms", "confirm_ts_ms", [f"last_{name}_price", f"last_{name}_ts_ms"], "swing_id")
        out = out.withColumn(f"dist_last_{name}_pct", (F.col("close") - F.col(f"last_{name}_price")) / F.col("close"))
    return out


def last_label(bars: DataFrame, events: DataFrame, keys: list[str] = KEY) -> DataFrame:
    own = events.select(*keys, "confirm_ts_ms", "swing_id", F.col("label").alias("last_structure_label"), F.col("bias").alias("structure_bias"))
    out = asof_join(bars, own, keys, "ts_ms", "confirm_ts_ms", ["last_structure_label", "structure_bias"], "swing_id")
    return out.withColumn("structure_bias", F.coalesce("structure_bias", F.lit(0)))


def last_leg(bars: DataFrame, made: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Last known leg at every bar: direction, kind, length, Fibonacci prices and distances to them."""
    own = made.select(*keys, "known_ts_ms", "leg_id", F.col("direction").alias("last_leg_dir"), F.col("leg_kind").alias("last_leg_kind"), F.col("length_pct").alias("last_leg_len_pct"), F.col("start_price").alias("_a"), F.col("end_price").alias("_b"))
    out = asof_join(bars, own, keys, "ts_ms", "known_ts_ms", ["last_leg_dir", "last_leg_kind", "last_leg_len_pct", "_a", "_b"], "leg_id")
    price = {r: fib_price(F.col("_a"), F.col("_b"), r) for r in RATIOS}
    return out.select(*bars.columns, "last_leg_dir", "last_leg_kind", "last_leg_len_pct", *[p.alias(fib_column(r)) for r, p in price.items()], *[((price[r] - F.col("close")) / F.col("close")).alias(f"dist_{fib_column(r)}_pct") for r in RETRACEMENTS])


def last_retracement(bars: DataFrame, made: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """A leg's retracement, shown only once the leg after it is known."""
    own = made.where("retrace_known_ms IS NOT NULL").select(*keys, "retrace_known_ms", "leg_id", F.col("retrace_pct").alias("last_retrace_pct"), F.col("fib_label").alias("last_retrace_fib"))
    return asof_join(bars, own, keys, "ts_ms", "retrace_known_ms", ["last_retrace_pct", "last_retrace_fib"], "leg_id")


def bar_features(bars: DataFrame, left: int = 2, right: int = 2, keys: list[str] = KEY) -> DataFrame:
    """The causal feature matrix: what was known of the structure at every bar.

    Swings with their labels are written once. Bars and everything that becomes known are put into
    one union, and a single window gives every bar the last of each and the numbers of known levels.
    """
    events = written(label_events(swings(bars, left, right, keys), keys), "events")
    made = legs(events, keys)
    out = known_at_bars(bars, events, made, keys)
    return nearest_levels(out, levels(events, keys), keys, ("_supports", "_resistances")).drop("_supports", "_resistances")


def known_at_bars(bars: DataFrame, events: DataFrame, made: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """What was known of swings, labels and legs at every bar, and of how many supports and resistances."""
    high = F.col("kind") == "high"
    price = F.struct(F.col("price"), F.col("pivot_ts_ms").alias("ts"))
    leg = F.struct(F.col("direction"), F.col("leg_kind"), F.col("length_pct"), F.col("start_price"), F.col("end_price"))
    row = lambda time, seq, *columns: [*keys, F.col(time).alias("ts_ms"), F.lit(0).alias("_bar"), F.col(seq).cast("long").alias("_seq"), *columns]
    known = events.select(*row("confirm_ts_ms", "swing_id", F.when(high, price).alias("_sh"), F.when(~high, price).alias("_sl"), F.struct("label", "bias").alias("_label")))
    known = known.unionByName(made.select(*row("known_ts_ms", "leg_id", leg.alias("_leg"))), allowMissingColumns=True)
    shown = made.where("retrace_known_ms IS NOT NULL")
    known = known.unionByName(shown.select(*row("retrace_known_ms", "leg_id", F.struct("retrace_pct", "fib_label").alias("_retrace"))), allowMissingColumns=True)
    every = known.unionByName(bars.select(*keys, "ts_ms", F.lit(1).alias("_bar"), "close"), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("ts_ms", "_bar", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(c, True).over(upto).alias(c) for c in ("_sh", "_sl", "_label", "_leg", "_retrace")]
    counts = [F.count("_sl").over(upto).alias("_supports"), F.count("_sh").over(upto).alias("_resistances")]
    at = every.select(*keys, "ts_ms", "close", "_bar", *last, *counts).where("_bar = 1")
    c = F.col("close")
    price = {r: fib_price(F.col("_leg.start_price"), F.col("_leg.end_price"), r) for r in RATIOS}
    return at.select(
        *keys, "ts_ms", "close",
        *[x for n in ("sh", "sl") for x in (F.col(f"_{n}.price").alias(f"last_{n}_price"), F.col(f"_{n}.ts").alias(f"last_{n}_ts_ms"), ((c - F.col(f"_{n}.price")) / c).alias(f"dist_last_{n}_pct"))],
        F.col("_label.label").alias("last_structure_label"), F.coalesce("_label.bias", F.lit(0)).alias("structure_bias"),
        F.col("_leg.direction").alias("last_leg_dir"), F.col("_leg.leg_kind").alias("last_leg_kind"), F.col("_leg.length_pct").alias("last_leg_len_pct"),
        *[p.alias(fib_column(r)) for r, p in price.items()], *[((price[r] - c) / c).alias(f"dist_{fib_column(r)}_pct") for r in RETRACEMENTS],
        F.col("_retrace.retrace_pct").alias("last_retrace_pct"), F.col("_retrace.fib_label").alias("last_retrace_fib"), "_supports", "_resistances",
    )
