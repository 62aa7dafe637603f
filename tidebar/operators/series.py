"""Bar series: conforming, cleaning, validating, resampling, coverage, gaps, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.scan import block_scan
from tidebar.schemas import BAR_VALUES, BARS, KEY, conform
from tidebar.timeframes import MONDAY_MS, STEP_MS, bucket, step_ms


def last_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The row of every key that is last in ``order``; a total order makes it one and the same."""
    by = [(F.col(o) if isinstance(o, str) else o).desc_nulls_last() for o in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def conform_bars(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """OHLCV bars of one row per key and open time; ``ts_ms`` comes from ``timestamp`` where missing."""
    missing = {"open", "high", "low", "close"} - set(df.columns)
    if missing or not {"ts_ms", "timestamp"} & set(df.columns):
        raise ValueError(f"no bars: {sorted(missing) or 'no time'}")
    if "ts_ms" not in df.columns:
        df = df.withColumn("ts_ms", F.unix_millis("timestamp"))
    order = F.col(seq) if seq in df.columns else F.lit(0)
    out = conform(df, BARS).withColumn("_seq", order) if seq not in df.columns else df.select(*conform(df, BARS).columns, order.alias("_seq"))
    return last_per_key(out, [*KEY, "ts_ms"], "_seq").drop("_seq")


def drop_forming(df: DataFrame, now_ms: Column) -> DataFrame:
    """Bars that are closed at ``now_ms``; those of unknown timeframes stay."""
    step = step_ms(F.col("timeframe"))
    return df.where(step.isNull() | (F.col("ts_ms") + step <= now_ms))


def is_junk() -> Column:
    """Flat without volume, or a broken range; comparisons with null are no reason."""
    o, h, l, c, v = (F.when(~F.isnan(x), F.col(x)) for x in BAR_VALUES)
    flat = (o == h) & (h == l) & (l == c) & (F.coalesce(v, F.lit(0.0)) <= 0)
    broken = (h < F.greatest(o, c)) | (l > F.least(o, c)) | (h < l)
    return F.coalesce(flat, F.lit(False)) | F.coalesce(broken, F.lit(False))


def drop_junk(df: DataFrame) -> DataFrame:
    return df.where(~is_junk())


def violations(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """(key, ts_ms, rule) for every rule that a bar breaks, in order of arrival ``seq``."""
    w = Window.partitionBy(*KEY).orderBy(seq)
    prev = F.lag("ts_ms").over(w)
    step = step_ms(F.col("timeframe"))
    o, h, l, c = (F.col(x) for x in BAR_VALUES[:4])
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rules = {
        "not_increasing": F.col("ts_ms") <= prev,
        "off_grid": (F.col("ts_ms") > prev) & (F.pmod(F.col("ts_ms") - prev, step) != 0),
        "not_finite": bad(o) | bad(h) | bad(l) | bad(c),
        "not_positive": F.least(o, h, l, c) <= 0,
        "high_below_body": h < F.greatest(o, c) - 1e-12,
        "low_above_body": l > F.least(o, c) + 1e-12,
        "high_below_low": h < l,
    }
    found = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return df.select(*KEY, "ts_ms", found.alias("rules")).select(*KEY, "ts_ms", F.explode("rules").alias("rule"))


def check_bars(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """``df`` itself; reading it fails where a bar breaks a rule."""
    bad = violations(df, seq).groupBy(*KEY, "ts_ms").agg(F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("_rules"))
    out = df.join(bad, [*KEY, "ts_ms"], "left")
    return out.where(F.when(F.col("_rules").isNotNull(), F.raise_error(F.concat(F.lit("bar "), F.col("ts_ms").cast("string"), F.lit(": "), F.col("_rules"))).cast("boolean")).otherwise(True)).drop("_rules")


def contract(df: DataFrame, expect: dict[str, object], same: list[tuple[str, str]], step: int = 60_000) -> DataFrame:
    """Per symbol: bars, range, missing steps, distinct values of the named constants, rows that break them."""
    missing = [c for c in [*expect, *(x for p in same for x in p)] if c not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    wrong = F.lit(False)
    for c, v in expect.items():
        wrong = wrong | ~F.col(c).eqNullSafe(F.lit(v))
    for a, b in same:
        wrong = wrong | ~F.col(a).eqNullSafe(F.col(b))
    return df.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.min("ts_ms").alias("min_ts"), F.max("ts_ms").alias("max_ts"),
        ((F.max("ts_ms") - F.min("ts_ms")) / step + 1 - F.count("*")).cast("long").alias("missing"),
        *[F.count_distinct(c).alias(f"{c}_values") for c in expect],
        F.count_if(wrong).alias("invalid"),
    )


def resample(df: DataFrame, timeframe: str, step: int | None = None, offset: int | None = None) -> DataFrame:
    """Bars of a larger step, left-closed and labelled by their start; empty ones do not appear.

    Open and close skip nulls; missing volume counts 0; a bar without open, high, low or close is
    dropped. ``n_children`` tells how many bars went in. Partial aggregates move, not bars.
    """
    step = step or STEP_MS[timeframe]
    offset = (MONDAY_MS if timeframe == "1w" else 0) if offset is None else offset
    start = bucket(F.col("ts_ms"), step, offset)
    agg = df.groupBy("source", "symbol", start.alias("ts_ms_")).agg(
        F.min_by(F.col("open"), F.when(F.col("open").isNotNull(), F.col("ts_ms"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by(F.col("close"), F.when(F.col("close").isNotNull(), F.col("ts_ms"))).alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"), F.count("*").alias("n_children"),
    )
    return agg.select("source", "symbol", F.lit(timeframe).alias("timeframe"), F.col("ts_ms_").alias("ts_ms"), *BAR_VALUES, "n_children").dropna(subset=BAR_VALUES[:4])


def derive_higher(minutes: DataFrame) -> DataFrame:
    """1h, 4h, 1d and 1w bars of 1-minute bars: hours feed 4h, days feed weeks."""
    h1, d1 = resample(minutes, "1h"), resample(minutes, "1d")
    out = h1
    for part in (resample(h1, "4h"), d1, resample(d1, "1w")):
        out = out.unionByName(part)
    return out.drop("n_children")


def coverage(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("bars"), F.min("ts_ms").alias("min_ts_ms"), F.max("ts_ms").alias("max_ts_ms"))


def pick_series(df: DataFrame, symbols: list[str] | None = None, timeframes: list[str] | None = None, sources: list[str] | None = None, min_bars: int = 50) -> DataFrame:
    """Coverage of the series asked for that have enough bars."""
    out = coverage(df).where(F.col("bars") >= min_bars)
    if symbols:
        out = out.where(F.upper("symbol").isin([s.upper() for s in symbols]))
    if timeframes:
        out = out.where(F.col("timeframe").isin(timeframes))
    return out.where(F.col("source").isin(sources)) if sources else out


def dominant_source(df: DataFrame, preferred: str = "binance") -> DataFrame:
    """(symbol, timeframe, source): the preferred one if it has bars, else the one with most."""
    n = df.groupBy("symbol", "timeframe", "source").count()
    w = Window.partitionBy("symbol", "timeframe").orderBy((F.col("source") == preferred).desc(), F.desc("count"), "source")
    return n.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("symbol", "timeframe", "source", F.col("count").alias("bars"))


def freshness(df: DataFrame, now_ms: Column, keys: list[str] = KEY, slack: float = 2.5) -> DataFrame:
    """Lag of each series' newest bar; stale beyond ``slack`` steps (an unknown timeframe counts as 1h)."""
    step = F.coalesce(step_ms(F.col("timeframe")), F.lit(STEP_MS["1h"]))
    out = coverage(df, keys).withColumn("lag_s", (now_ms - F.col("max_ts_ms")) / 1000.0)
    return out.withColumn("stale", F.col("lag_s") * 1000 > slack * step)


#: Hours within which a series' last bar counts as fresh, by timeframe; 24 for others.
FRESH_HOURS = {"1m": 2, "5m": 2, "15m": 4, "1h": 6, "4h": 18, "1d": 40, "1w": 192}


def ingest_plan(df: DataFrame, now_ms: Column, wanted_from_ms: Column, late_ms: int = 7 * 86_400_000) -> DataFrame:
    """What to fetch per series: nothing if fresh, from an overlap before the last bar, or all if history starts late.

    A history is late where it starts more than ``late_ms`` after what is wanted. The overlap is six hours of
    minutes and five days of any other timeframe.
    """
    tf, hour = F.col("timeframe"), 3_600_000
    out = coverage(df)
    limits = F.create_map(*[F.lit(x) for pair in FRESH_HOURS.items() for x in pair])
    late = F.col("min_ts_ms") > wanted_from_ms + late_ms
    fresh = now_ms - F.col("max_ts_ms") <= F.coalesce(F.try_element_at(limits, tf), F.lit(24)) * hour
    action = F.when(late, "restart").when(fresh, "skip").otherwise("append")
    start = F.when(late, wanted_from_ms).when(~fresh, F.col("max_ts_ms") - F.when(tf == "1m", 6 * hour).otherwise(120 * hour))
    return out.select(*KEY, action.alias("action"), start.cast("long").alias("start_ms"))


def gaps(df: DataFrame, step: int, keys: list[str] = KEY, block_ms: int | None = None) -> DataFrame:
    """Missing ranges (start_ms, end_ms, missing) with the bars at their edges (before_ms, after_ms). With ``block_ms`` in blocks of time."""
    if block_ms:
        out = block_scan(df.select(*keys, "ts_ms"), keys, "ts_ms", [], block_ms, {"next": ("lead", F.col("ts_ms"))})
    else:
        out = df.select(*keys, "ts_ms", F.lead("ts_ms").over(Window.partitionBy(*keys).orderBy("ts_ms")).alias("next"))
    out = out.where(F.col("next") - F.col("ts_ms") > step)
    return out.select(
        *keys, F.col("ts_ms").alias("before_ms"), F.col("next").alias("after_ms"),
        (F.col("ts_ms") + step).alias("start_ms"), (F.col("next") - step).alias("end_ms"), ((F.col("next") - F.col("ts_ms")) / step - 1).cast("long").alias("missing"),
    )


def repair_gaps(df: DataFrame, candidates: DataFrame, step: int, tolerance: float = 1e-9) -> DataFrame:
    """Bars of ``candidates`` that fill gaps of ``df``; none where the candidate at an edge has another close."""
    found = gaps(df, step)
    edges = found.select(*KEY, "before_ms", F.explode(F.array("before_ms", "after_ms")).alias("ts_ms"))
    have = edges.join(df.select(*KEY, "ts_ms", F.col("close").alias("have")), [*KEY, "ts_ms"])
    bad = have.join(candidates.select(*KEY, "ts_ms", F.col("close").alias("cand")), [*KEY, "ts_ms"]).where(F.abs(F.col("have") - F.col("cand")) > tolerance * F.greatest(F.lit(1.0), F.abs("have")))
    fine = found.join(bad.select(*KEY, "before_ms").distinct(), [*KEY, "before_ms"], "left_anti")
    wanted = fine.select(*KEY, F.explode(F.sequence("start_ms", "end_ms", F.lit(step))).alias("ts_ms"))
    return candidates.join(wanted, [*KEY, "ts_ms"], "left_semi")


def ordered_union(parts: list[DataFrame], keys: list[str], place: str) -> DataFrame:
    """Rows of all parts once a key, with ``part`` and ``place`` of the first mention, which order them.

    ``place``: the column that orders a part's rows. A key counts where an earlier part has it first.
    """
    both = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        both = both.unionByName(p.withColumn("part", F.lit(i)))
    first = both.groupBy(*keys).agg(F.min(F.struct("part", F.col(place).alias("place"))).alias("x"))
    return first.select(*keys, "x.part", "x.place")


def export_coverage(df: DataFrame, path: str) -> DataFrame:
    """Coverage of every series as one CSV file with a header, in the order of the key; returns what is in it.

    A row a series, so one task writes it.
    """
    out = coverage(df)
    out.repartition(1).sortWithinPartitions(*KEY).write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(out.schema).option("header", True).csv(path)


def daily_last(df: DataFrame, value: str = "close") -> DataFrame:
    """One bar a UTC day of the last non-null value, as open, high, low and close."""
    day = bucket(F.col("ts_ms"), STEP_MS["1d"])
    out = df.where(F.col(value).isNotNull()).groupBy("source", "symbol", day.alias("day")).agg(F.max_by(value, "ts_ms").alias("v"))
    return out.select("source", "symbol", F.lit("1d").alias("timeframe"), F.col("day").alias("ts_ms"), *[F.col("v").alias(c) for c in BAR_VALUES[:4]], F.lit(0.0).alias("volume"))


def value_bars(df: DataFrame, seq: str) -> DataFrame:
    """A value series as bars: open, high, low and close are the value; finite ones at positive times; first of a time."""
    ok = df.where((F.col("ts_ms") > 0) & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    one = last_per_key(ok, ["source", "symbol", "ts_ms"], -F.col(seq))
    return one.select("source", "symbol", "ts_ms", *[F.col("value").alias(c) for c in BAR_VALUES[:4]], F.lit(0.0).alias("volume"))


def first_difference(df: DataFrame, value: str = "close") -> DataFrame:
    """Change of ``value`` from bar to bar; the first bar has none and is dropped."""
    w = Window.partitionBy(*KEY).orderBy("ts_ms")
    return df.withColumn("change", F.col(value) - F.lag(value).over(w)).where("change IS NOT NULL")


def priority_union(*parts: DataFrame) -> DataFrame:
    """All bars of the parts; of several at one time the later part's stays."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return last_per_key(out, [*KEY, "ts_ms"], "_part").drop("_part")


def tips(df: DataFrame, now_ms: Column, keys: list[str] = KEY) -> DataFrame:
    """Newest closed bar of every series."""
    closed = drop_forming(df, now_ms)
    return closed.groupBy(*keys).agg(F.max("ts_ms").alias("ts_ms"), F.max_by(F.struct(*BAR_VALUES[:4]), "ts_ms").alias("t")).select(*keys, "ts_ms", "t.*")


def compare_tips(left: DataFrame, right: DataFrame, now_ms: Column, keys: list[str], tol: float = 1e-9) -> DataFrame:
    """Per series whether the newest closed bars agree, and the first reason why not."""
    l = tips(left, now_ms, keys).select(*keys, F.struct("ts_ms", *BAR_VALUES[:4]).alias("l"))  # noqa: E741
    r = tips(right, now_ms, keys).select(*keys, F.struct("ts_ms", *BAR_VALUES[:4]).alias("r"))
    reason = F.when(F.col("l").isNull(), "missing_left").when(F.col("r").isNull(), "missing_right").when(F.col("l.ts_ms") != F.col("r.ts_ms"), "ts_mismatch")
    for c in BAR_VALUES[:4]:
        reason = reason.when(F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) > tol, f"{c}_mismatch")
    return l.join(r, keys, "full_outer").select(*keys, F.coalesce(reason, F.lit("ok")).alias("reason"))


def compare_history(left: DataFrame, right: DataFrame, keys: list[str], tol: float = 1e-9, examples: int = 5) -> DataFrame:
    """Per series: bars on both sides, on one only, that differ, and the first times that differ."""
    pk = [*keys, "ts_ms"]
    l, r = (d.select(*pk, F.struct(*BAR_VALUES[:4]).alias(n)) for d, n in ((left, "l"), (right, "r")))  # noqa: E741
    differs = F.lit(False)
    for c in BAR_VALUES[:4]:
        differs = differs | (F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) > tol)
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    j = l.join(r, pk, "full_outer").withColumn("bad", both & differs)
    nth = F.row_number().over(Window.partitionBy(*keys, "bad").orderBy("ts_ms"))
    j = j.withColumn("example", F.when(F.col("bad") & (nth <= examples), F.col("ts_ms")))
    return j.groupBy(*keys).agg(
        F.count_if(both).alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"),
        F.count_if("bad").alias("different"), F.array_join(F.transform(F.sort_array(F.collect_list("example")), lambda x: x.cast("string")), ",").alias("examples"),
    )


def last_n(df: DataFrame, n: int, keys: list[str] = KEY) -> DataFrame:
    """Newest ``n`` bars of every series."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts_ms"))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Times that both have, as an intersection of sets."""
    return left.select(*keys, "ts_ms").intersect(right.select(*keys, "ts_ms"))


def timeline(*parts: DataFrame) -> DataFrame:
    """Distinct times over several series."""
    out = parts[0].select("ts_ms")
    for p in parts[1:]:
        out = out.union(p.select("ts_ms"))
    return out.distinct()


def downsample(df: DataFrame, keys: list[str], order: list[str], points: int) -> DataFrame:
    """Evenly spaced rows of each series, the first and the last among them."""
    n = F.count("*").over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    ranked = df.withColumn("_i", i).withColumn("_n", n)
    # row i is kept if it is floor(k * (n - 1) / (points - 1)) for some k: its own k is the least that reaches it
    k = F.ceil(F.col("_i") * (points - 1) / (F.col("_n") - 1))
    hit = F.floor(k * (F.col("_n") - 1) / (points - 1)) == F.col("_i")
    return ranked.where((F.col("_n") <= points) | hit).drop("_i", "_n")
