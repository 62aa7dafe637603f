"""As-of, nearest, range and prefix-nearest joins as equi-joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.timeframes import bucket


def asof_join(bars: DataFrame, events: DataFrame, keys: list[str], bar_time: str, event_time: str, values: list[str], event_seq: str | None = None, prefix: str = "", block_ms: int | None = None) -> DataFrame:
    """Each bar with the values of the last event at or before it; of events at one time the last in ``event_seq``.

    One union and one window per key. With ``block_ms`` a long series is worked on in time blocks:
    a block looks within itself, and what a block has before its first event comes from a carry
    table of one row per block, so no task holds a whole series.
    """
    seq = F.col(event_seq) if event_seq else F.lit(0)
    payload = F.struct(*values)
    b = bars.withColumn("_t", F.col(bar_time)).withColumn("_is_bar", F.lit(1)).withColumn("_seq", F.lit(0).cast("long"))
    e = events.select(*keys, F.col(event_time).alias("_t"), F.lit(0).alias("_is_bar"), seq.cast("long").alias("_seq"), payload.alias("_v"))
    both = b.unionByName(e, allowMissingColumns=True)
    order = ["_t", "_is_bar", "_seq"]
    if block_ms is None:
        found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        both = both.withColumn("_block", bucket(F.col("_t"), block_ms))
        own = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_block").orderBy(*order))
        tail = both.groupBy(*keys, "_block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_carry"))
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        tail = tail.withColumn("_carry", F.last("_carry", ignorenulls=True).over(before))
        found = both.withColumn("_v", own).join(tail, [*keys, "_block"], "left").withColumn("_v", F.coalesce("_v", "_carry")).drop("_block", "_carry")
    out = found.where("_is_bar = 1")
    return out.select(*bars.columns, *[F.col(f"_v.{v}").alias(f"{prefix}{v}") for v in values])


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], tolerance: int, later_wins: bool = False) -> DataFrame:
    """Each left row with the right row nearest in time within ``tolerance``; ties go backward, or forward."""
    l = left.withColumn("_side", F.lit(1))  # noqa: E741
    r = right.select(*keys, time, F.lit(0).alias("_side"), F.struct(F.col(time).alias("t"), *values).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy(time, "_side")
    ahead = Window.partitionBy(*keys).orderBy(F.desc(time), "_side")
    both = both.withColumn("_b", F.last("_v", ignorenulls=True).over(back)).withColumn("_a", F.last("_v", ignorenulls=True).over(ahead)).where("_side = 1")
    db, da = F.col(time) - F.col("_b.t"), F.col("_a.t") - F.col(time)
    first = (da.isNull() | (db < da if later_wins else db <= da)) & db.isNotNull()
    pick = F.when(first & (db <= tolerance), F.col("_b")).when(~F.coalesce(first, F.lit(False)) & (da <= tolerance), F.col("_a"))
    both = both.withColumn("_p", pick)
    return both.select(*left.columns, *[F.col(f"_p.{v}").alias(v) for v in values])


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, width: int, closed_end: bool = False) -> DataFrame:
    """Pairs of a point and an interval [start, end) that holds it.

    Time is cut into buckets of ``width``; an interval meets every bucket that it touches, a point
    its own, so the join is an equi-join on key and bucket.
    """
    last = F.col(end) if closed_end else F.col(end) - 1
    i = intervals.where(last >= F.col(start)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start), width), bucket(last, width), F.lit(width).cast("long"))))
    p = points.withColumn("_bucket", bucket(F.col(point), width))
    inside = (F.col(point) >= F.col(start)) & ((F.col(point) <= F.col(end)) if closed_end else (F.col(point) < F.col(end)))
    return p.join(i, [*keys, "_bucket"]).where(inside).drop("_bucket")


def prefix_nearest(bars: DataFrame, levels: DataFrame, keys: list[str], time: str, value: str, known: str, price: str, level_id: str, below: bool, out: str, count: str | None = None) -> DataFrame:
    """Each bar with the nearest level price below (or above) its value among levels known by its time.

    A bar is known by its key and time. ``count`` names a column of ``bars`` that already tells how many
    levels are known by then.

    The levels of a key, ranked by when they are known, that a bar may see are a prefix. Every prefix
    is a union of aligned power-of-two blocks, those of the set bits of its length,
    and every level lies in one block per bit. So bars and levels meet in blocks by an equi-key, and a
    running maximum (or minimum) by price inside a block finds the nearest one: O((n + m) log m).
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(known, level_id)) - 1
    pos = levels.select(*keys, F.col(known).alias("_t"), F.col(price).alias("_p"), rank.alias("_pos"))
    if count:
        seen = bars.withColumn("_k", F.col(count).cast("long"))
    else:
        last = pos.groupBy(*keys, F.col("_t")).agg((F.max("_pos") + 1).alias("_k"))
        seen = asof_join(bars, last, keys, time, "_t", ["_k"])
    bits = lambda n: F.sequence(F.lit(0), F.length(F.bin(n)) - 1)  # noqa: E731  the binary places of a number
    set_bits = F.filter(bits(F.col("_k")), lambda x: F.call_function("shiftright", F.col("_k"), x).bitwiseAND(1) == 1)
    parts = seen.where("_k > 0").select(*keys, F.col(time).alias("_row"), F.col(value).alias("_c"), F.explode(set_bits).alias("_x"), "_k").withColumn("_blk", F.expr("shiftright(_k, _x) - 1"))
    most = pos.groupBy(*keys).agg(F.max("_pos").alias("_m"))
    # a block is asked for only if it lies within the number of levels
    blocks = pos.join(most, keys).select(*keys, "_p", "_pos", "_m", F.explode(bits(F.col("_m") + 1)).alias("_x")).withColumn("_blk", F.expr("shiftright(_pos, _x)"))
    both = blocks.select(*keys, "_x", "_blk", F.col("_p").alias("_o"), F.col("_p").alias("_lv"), F.lit(0).alias("_bar"), F.lit(None).cast("long").alias("_row"))
    both = both.unionByName(parts.select(*keys, "_x", "_blk", F.col("_c").alias("_o"), F.lit(None).cast("double").alias("_lv"), F.lit(1).alias("_bar"), "_row"))
    w = Window.partitionBy(*keys, "_x", "_blk").orderBy(F.col("_o") if below else F.desc("_o"), "_bar")
    near = (F.max("_lv") if below else F.min("_lv")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hits = both.withColumn("_near", near).where("_bar = 1").groupBy(*keys, F.col("_row").alias(time)).agg((F.max("_near") if below else F.min("_near")).alias(out))
    return seen.join(hits, [*keys, time], "left").select(*bars.columns, out)


def first_touch(orders: DataFrame, bars: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Orders (order_id, side, limit_price, start_ms, end_ms) with the first bar in [start, end) that touches the limit."""
    hit: Column = F.when(F.col("side") > 0, F.col("low") <= F.col("limit_price") + 1e-12).otherwise(F.col("high") >= F.col("limit_price") - 1e-12)
    pairs = interval_join(bars.select(*keys, "ts_ms", "high", "low"), orders, keys, "ts_ms", "start_ms", "end_ms", width)
    found = pairs.where(hit).groupBy("order_id").agg(F.min("ts_ms").alias("touch_ms"))
    return orders.join(found, "order_id", "left")


def child_coverage(parents: DataFrame, children: DataFrame, keys: list[str], parent_ms: int, child_ms: int) -> DataFrame:
    """Parents with ``complete``: every child step of their window is there."""
    start = bucket(F.col("ts_ms"), parent_ms)
    c = children.groupBy(*keys, start.alias("_start")).agg(F.count_distinct("ts_ms").alias("n_sub"), F.min("ts_ms").alias("_lo"), F.max("ts_ms").alias("_hi"))
    out = parents.join(c.withColumnRenamed("_start", "ts_ms"), [*keys, "ts_ms"], "left")
    full = (F.col("n_sub") == parent_ms // child_ms) & (F.col("_lo") == F.col("ts_ms")) & (F.col("_hi") == F.col("ts_ms") + parent_ms - child_ms)
    return out.withColumn("complete", F.coalesce(full, F.lit(False))).withColumn("n_sub", F.coalesce("n_sub", F.lit(0)).cast("long")).drop("_lo", "_hi")
