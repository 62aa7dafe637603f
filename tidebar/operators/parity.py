"""Matching of two trade sets, and of trades to decisions."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.scan import block_scan
from tidebar.scratch import written


def diff_trades(left: DataFrame, right: DataFrame, fields: list[str], time: str = "entry_ts_ms", tie: str = "trade_id", tol: float = 1e-9, window_ms: int = 0, block_ms: int = 30 * 86_400_000) -> DataFrame:
    """One-to-one matches on entry time with the first field that differs, and what only one side has.

    Without ``window_ms`` the n-th trades of a time match. With it, trades are matched greedily in order of time and
    ``tie``: a left trade takes the first right one within the window that none before it has taken. Entries of both sides that
    follow each other within the window form a component, numbered by the time of its first entry; components
    are dealt to tasks, and in each one pass over both sides matches it.
    """
    w = Window.partitionBy(time).orderBy(tie)
    if not window_ms:
        l, r = (d.withColumn("_n", F.row_number().over(w)).select(F.col(time).alias("_t"), "_n", F.struct(tie, time, *fields).alias(n)) for d, n in ((left, "l"), (right, "r")))  # noqa: E741
        j = l.join(r, ["_t", "_n"], "full_outer")
    else:
        sides = [d.select(F.col(time).alias("_t"), F.lit(s).alias("_side"), F.col(tie).alias("_id"), *[F.col(f).cast("double").alias(f) for f in fields]) for d, s in ((left, 0), (right, 1))]
        both = block_scan(sides[0].unionByName(sides[1]), [], "_t", ["_side", "_id"], block_ms, {"_before": ("lag", F.col("_t"))})
        starts = F.when(F.col("_before").isNull() | (F.col("_t") - F.col("_before") > window_ms), F.col("_t"))
        both = block_scan(both, [], "_t", ["_side", "_id"], block_ms, {"_c": ("last", starts)})
        kinds = dict(left.dtypes)[tie]
        out = ", ".join(f"{s}_{c} {k}" for s in "lr" for c, k in [("id", kinds), *((f, "double") for f in fields)])
        rows = both.select("_c", "_t", "_side", "_id", *fields).repartition("_c").sortWithinPartitions("_c", "_t", "_side", "_id")
        m = rows.mapInPandas(_matched(window_ms, fields), out)
        side = lambda s: F.when(F.col(f"{s}_id").isNotNull(), F.struct(F.col(f"{s}_id").alias(tie), *[F.col(f"{s}_{f}").alias(f) for f in fields])).alias(s)
        j = m.select(side("l"), side("r"))
    outcome = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right")
    for f in fields:
        outcome = outcome.when(F.abs(F.col(f"l.{f}") - F.col(f"r.{f}")) > tol, f)
    return j.select(F.col(f"l.{tie}").alias("left_id"), F.col(f"r.{tie}").alias("right_id"), outcome.otherwise("same").alias("outcome"))


def _matched(window_ms: int, fields: list[str]):
    """Rows ordered by component and time to matches: both sides wait in queues that the window keeps short."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lefts: deque = deque()
        rights: deque = deque()
        names = [f"{s}_{c}" for s in "lr" for c in ("id", *fields)]
        none = (None,) * (1 + len(fields))

        def settle(now: float, out: list[tuple]) -> None:
            # a left trade is settled once no right one within its window can still come
            while lefts and lefts[0][0] + window_ms < now:
                t, own = lefts.popleft()
                while rights and rights[0][0] < t - window_ms:
                    out.append((*none, *rights.popleft()[1]))
                out.append((*own, *(rights.popleft()[1] if rights and rights[0][0] <= t + window_ms else none)))

        last = None
        for part in parts:
            out: list[tuple] = []
            for c, t, side, *own in part.itertuples(index=False, name=None):
                settle(t if c == last else math.inf, out)
                if c != last:
                    out += [(*none, *r) for _, r in rights]
                    rights.clear()
                    last = c
                (rights if side else lefts).append((t, tuple(own)))
            yield pd.DataFrame(out, columns=names)
        out = []
        settle(math.inf, out)
        yield pd.DataFrame(out + [(*none, *r) for _, r in rights], columns=names)

    return run


def newest_decision(positions: DataFrame, decisions: DataFrame, slack: float = 1e-4) -> DataFrame:
    """Positions (position_id, symbol, side, qty) with the newest filled decision (decide_id, symbol, side, qty, bar_ms) that agrees.

    Symbol and side agree where they are equal or one of them is missing; a position may be smaller than its
    decision, as it is after a part has been closed, but larger by ``slack`` at most; a missing quantity agrees with any. Of
    decisions of one bar the one of the least sufficient quantity wins, then the smaller identifier.

    Sorted by quantity from above, what agrees with a position is what stands before it, so a running maximum per symbol and
    side finds it: no pairs are made. A missing symbol or side is looked up under keys of its own. Only distinct
    quantities are sorted, dealt into ranges that may cut a symbol and side; what stands before a range is a row of its own.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    # a known value meets its own kind and decisions without one; an unknown value meets all
    asked = lambda c: F.when(some(c).isNotNull(), F.array(F.concat(F.lit("="), c), F.lit("none"))).otherwise(F.array(F.lit("any")))
    told = lambda c: F.array(F.coalesce(F.concat(F.lit("="), some(c)), F.lit("none")), F.lit("any"))
    pairs = lambda how, df: df.withColumn("_k", F.explode(how("symbol"))).withColumn("_s", F.explode(how("side")))
    own = ["symbol", "side", "qty"]
    limit = F.coalesce(F.col("qty") + F.greatest(F.lit(1e-9), F.abs("qty") * slack), F.lit(math.inf))
    best = F.struct(F.col("bar_ms").alias("bar_ms"), (-F.coalesce("qty", F.lit(math.inf))).alias("least"), (-F.col("decide_id")).alias("id"))
    some_told = decisions.where("bar_ms IS NOT NULL AND bar_ms <> 0").groupBy(*own, "bar_ms").agg(F.min("decide_id").alias("decide_id"))  # the smaller identifier wins
    d = pairs(told, some_told).select("_k", "_s", limit.alias("_q"), F.lit(0).alias("_asks"), best.alias("_best"))
    p = pairs(asked, positions.select(*own).distinct()).select("_k", "_s", F.coalesce("qty", F.lit(-math.inf)).alias("_q"), F.lit(1).alias("_asks"), *own)
    by = ["_k", "_s", F.desc("_q"), "_asks"]
    both = written(d.unionByName(p, allowMissingColumns=True), "asked")  # ranges are drawn from a sample: computed once
    dealt = written(both.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("_k", "_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy("_k", "_s", "_range").agg(F.max("_best").alias("_top")).select("_k", "_s", "_range", F.max("_top").over(before).alias("_best"), F.lit(0).alias("_asks"), F.lit(math.nan).alias("_q"))  # NaN is above all
    w = Window.partitionBy("_k", "_s", "_range").orderBy(F.desc("_q"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.unionByName(tops, allowMissingColumns=True).withColumn("_top", F.max("_best").over(w)).where("_asks = 1")
    found = written(seen.groupBy(*own).agg(F.max("_top").alias("_top")), "found").select(*[F.col(c).alias(f"_f_{c}") for c in own], "_top")
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    return positions.join(found, same, "left").select(*positions.columns, (-F.col("_top.id")).alias("decide_id"), F.col("_top.bar_ms").alias("bar_ms"))


def soft_match(trades: DataFrame, decisions: DataFrame, price_tol: float, before_ms: int = 300_000, after_ms: int = 43_200_000) -> DataFrame:
    """Each trade with the decision of its symbol that is nearest in time, within the window and price tolerance."""
    width = before_ms + after_ms
    bucket = lambda c: F.floor(c / width)
    t = trades.withColumn("_b", F.explode(F.sequence(bucket(F.col("ts_ms") - after_ms), bucket(F.col("ts_ms") + before_ms))))
    d = decisions.select("decide_id", "symbol", F.col("ts_ms").alias("_d"), F.col("price").alias("_p"), bucket(F.col("ts_ms")).alias("_b"))
    gap = F.col("ts_ms") - F.col("_d")
    ok = gap.between(-before_ms, after_ms) & (F.abs(F.col("price") - F.col("_p")) <= price_tol * F.col("_p"))
    return t.join(d, ["symbol", "_b"]).where(ok).groupBy("trade_id").agg(F.min_by("decide_id", F.struct(F.abs(gap), F.col("decide_id"))).alias("decide_id"))
