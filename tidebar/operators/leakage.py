"""Look-ahead audits of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_returns(df: DataFrame, horizons: list[int], keys: list[str], digits: int | None = None) -> DataFrame:
    """close[t + h] / close[t] - 1 per horizon, as fwd_h."""
    w = Window.partitionBy(*keys).orderBy("ts_ms")
    r = lambda c: F.round(c, digits) if digits is not None else c
    return df.select(*keys, "ts_ms", *[r(F.lead("close", h).over(w) / F.col("close") - 1).alias(f"fwd_{h}") for h in horizons])


def _numbers(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c, t in df.dtypes if c not in keys and t in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")]


def frame_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str] | None = None, both_ways: bool = True) -> DataFrame:
    """Per column: largest absolute difference and rows where only one side is null (``both_ways``) or only the left one."""
    cols = columns or [c for c in _numbers(left, keys) if c in right.columns]
    long = lambda d, n: d.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, "column", n)
    j = long(left, "a").join(long(right, "b"), [*keys, "column"])
    one = (F.col("a").isNull() != F.col("b").isNull()) if both_ways else (F.col("a").isNull() & F.col("b").isNotNull())
    return j.groupBy("column").agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("max_diff"), F.count_if(one).alias("null_mismatch"))


def _finding(df: DataFrame, check: str, severity, message) -> DataFrame:
    return df.select(F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), "column", (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _ranked(bars: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Bars with their place in time over all, and how many there are."""
    if keys:
        w = Window.partitionBy(*keys).orderBy("ts_ms")
        out = bars.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    else:
        out = bars.withColumn("_i", F.row_number().over(Window.orderBy("ts_ms"))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return out


def prefix_invariance(bars: DataFrame, build, keys: list[str], cuts: tuple[float, ...] = (0.7, 0.81, 0.92), compare: int = 50, tol: float = 1e-9) -> DataFrame:
    """Columns whose last values before a cut change when the bars after it are taken away."""
    ranked = _ranked(bars, keys)
    whole = build(bars)
    worst = None
    for cut in cuts:
        upto = ranked.where(F.col("_i") <= F.floor(F.col("_n") * cut))
        tail = upto.where(F.col("_i") > F.floor(F.col("_n") * cut) - compare).select(*keys, "ts_ms")
        part = build(upto.drop("_i", "_n")).join(tail, [*keys, "ts_ms"], "left_semi")
        d = frame_diff(part, whole, [*keys, "ts_ms"], both_ways=False).unionByName(frame_diff(part, whole, [*keys, "ts_ms"]).withColumn("null_mismatch", F.lit(0).cast("long")))
        worst = d if worst is None else worst.unionByName(d)
    bad = worst.groupBy("column").agg(F.max("max_diff").alias("d"), F.max("null_mismatch").alias("n")).where((F.col("d") > tol) | (F.col("n") > 0))
    return _finding(bad, "prefix_invariance", "HARD", "changes when later bars are removed")


def future_mutation(bars: DataFrame, build, keys: list[str], cut: float = 0.8, tol: float = 1e-9) -> DataFrame:
    """Columns whose past changes when prices after the cut are multiplied by ten."""
    ranked = _ranked(bars, keys)
    past = ranked.where(F.col("_i") <= F.floor(F.col("_n") * cut)).select(*keys, "ts_ms")
    later, x10 = F.col("_i") > F.floor(F.col("_n") * cut), F.col("close") * 10
    mutated = ranked.withColumns({c: F.when(later, x10).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}).drop("_i", "_n")
    d = frame_diff(build(bars).join(past, [*keys, "ts_ms"], "left_semi"), build(mutated), [*keys, "ts_ms"])
    return _finding(d.where((F.col("max_diff") > tol) | (F.col("null_mismatch") > 0)), "future_mutation", "HARD", "past changes with the future")


def responsiveness(bars: DataFrame, build, keys: list[str], tip: int = 40, tol: float = 1e-12) -> DataFrame:
    """Columns that stay as they are when the last bars' path of returns is turned around; all of them: the builder is frozen."""
    ranked = _ranked(bars, keys)
    w = Window.partitionBy(*keys).orderBy("_i")
    r = ranked.withColumn("_tip", F.col("_i") > F.col("_n") - tip).withColumn("_r", F.log(F.col("close") / F.lag("close").over(w)))
    back = r.where("_tip").select(*keys, (2 * F.col("_n") - tip + 1 - F.col("_i")).alias("_i"), F.col("_r").alias("_rr"))
    base = r.where(F.col("_i") == F.col("_n") - tip).select(*keys, F.col("close").alias("_base"))
    new = r.join(back, [*keys, "_i"], "left").join(base, keys, "left") if keys else r.join(back, "_i", "left").crossJoin(F.broadcast(base))
    moved = F.col("_base") * F.exp(F.sum(F.coalesce("_rr", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    scale = F.when(F.col("_tip"), moved / F.col("close")).otherwise(1.0)
    new = new.withColumn("_scale", scale).withColumns({c: F.col(c) * F.col("_scale") for c in ("open", "high", "low", "close")}).select(*bars.columns)
    tips_ = r.where("_tip").select(*keys, "ts_ms")
    d = frame_diff(build(bars).join(tips_, [*keys, "ts_ms"], "left_semi"), build(new), [*keys, "ts_ms"])
    stuck = d.withColumn("_stuck", (F.col("max_diff") <= tol) & (F.col("null_mismatch") == 0))
    n = stuck.agg(F.count("*").alias("_all"), F.count_if("_stuck").alias("_bad"))
    out = stuck.crossJoin(F.broadcast(n)).where("_stuck")
    severity = F.when(F.col("_bad") == F.col("_all"), "HARD").otherwise("ADVISORY")
    return _finding(out.where((F.col("_bad") == F.col("_all")) | (F.col("_bad") >= F.greatest(F.lit(3), F.col("_all") * 0.5))), "responsiveness", severity, "does not move with the last bars")


def _texts(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c, t in df.dtypes if c not in keys and t == "string"]


def streaming_tip(batch: DataFrame, stream: DataFrame, keys: list[str], tol: float = 1e-9) -> DataFrame:
    """Columns that a bar-by-bar run and a batch run give differently at the run's last bar that both have.

    Numbers are compared within ``tol``, text as it stands; null on one side only is a difference. A series without
    a common bar is one finding on all columns. The run may end before the batch does, so that
    columns that need later bars differ.
    """
    at = [*keys, "ts_ms"]
    last = stream.select(*at).join(batch.select(*at), at).groupBy(*keys).agg(F.max("ts_ms").alias("ts_ms"))
    b, s = (df.join(last, at, "left_semi") for df in (batch, stream))
    d = frame_diff(b, s, at).where((F.col("max_diff") > tol) | (F.col("null_mismatch") > 0)).select("column")
    if texts := [c for c in _texts(b, at) if c in s.columns]:
        long = lambda df, name: df.select(*at, *texts).unpivot(at, texts, "column", name)
        told = long(b, "a").join(long(s, "b"), [*at, "column"]).where(~F.col("a").eqNullSafe(F.col("b")))
        d = d.unionByName(told.select("column").distinct())
    missing = batch.select(*keys).distinct().join(last.select(*keys), keys, "left_anti").select(F.lit("*").alias("column")).distinct()
    out = _finding(d, "streaming_tip", "HARD", "stream and batch disagree")
    return out.unionByName(_finding(missing, "streaming_tip", "HARD", "the stream has no bar of the batch"))


def forward_correlation(features: DataFrame, bars: DataFrame, keys: list[str], horizons: list[int], hard: float = 0.5, advisory: float = 0.2, least_rows: int = 100, least_finite: int = 50, check: str = "forward_corr") -> DataFrame:
    """Per column its strongest correlation with a forward return, and how bad that is."""
    fwd = forward_returns(bars, horizons, keys)
    cols = _numbers(features, [*keys, "ts_ms"])
    names = [f"fwd_{h}" for h in horizons]
    x = features.select(*keys, "ts_ms", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([*keys, "ts_ms"], cols, "column", "x")
    y = fwd.unpivot([*keys, "ts_ms"], names, "horizon", "y")
    ok = F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y")
    g = x.join(y, [*keys, "ts_ms"]).groupBy("column", "horizon").agg(F.count("*").alias("_all"), F.count_if(ok).alias("n"), F.corr(F.when(ok, F.col("x")), F.when(ok, F.col("y"))).alias("corr"), F.stddev_samp(F.when(ok, F.col("x"))).alias("_sd"))
    g = g.where((F.col("_all") >= least_rows) & (F.col("n") >= least_finite) & (F.col("_sd") >= 1e-15) & F.col("corr").isNotNull())
    top = g.groupBy("column").agg(F.max_by(F.struct("horizon", "corr", "n"), F.struct(F.abs("corr"), "horizon")).alias("t")).select("column", "t.*")
    level = F.when(F.abs("corr") >= hard, "HARD").when(F.abs("corr") >= advisory, "ADVISORY")
    return top.withColumn("severity", level).withColumn("check", F.lit(check))


#: Parts of names that labels and outcomes bear, and a pattern of names that look ahead.
HARD_TOKENS = ("net_return", "gross_return", "is_win", "outcome", "tp_touch", "sl_touch", "holding_ms", "trade_id", "label_", "_label", "target_", "y_true", "y_hat")
ADVISORY_PATTERN = r"(?i)(future|fwd_|forward_|lookahead|look_ahead|next_ret|ret_fwd)"

#: Columns of the feature matrix and the record whose known time they must wait for.
PUBLICATION_RULES = {
    "last_sh_price": "swing_high", "last_sl_price": "swing_low", "dist_last_sh_pct": "swing_high", "dist_last_sl_pct": "swing_low",
    "nearest_support": "level", "nearest_resistance": "level", "dist_support_pct": "level", "dist_resistance_pct": "level",
    "structure_bias": "event", "last_structure_label": "event",
    "last_leg_dir": "leg", "last_leg_kind": "leg", "last_leg_len_pct": "leg",
    "last_retrace_pct": "successor_leg", "last_retrace_fib": "successor_leg", "fib_0000": "leg", "fib_1000": "leg",
}


#: Ruled columns that show a record's own value, and how it follows from the record; the others are made with the close.
_SHOWN = {
    "swing_high": {"last_sh_price": "price"}, "swing_low": {"last_sl_price": "price"},
    "support": {"nearest_support": "price"}, "resistance": {"nearest_resistance": "price"},
    "event": {"structure_bias": "bias", "last_structure_label": "label"},
    "leg": {"last_leg_dir": "direction", "last_leg_kind": "leg_kind", "last_leg_len_pct": "length_pct", "fib_0000": "end_price", "fib_1000": "end_price - 1D * (end_price - start_price)"},
    "successor_leg": {"last_retrace_pct": "retrace_pct", "last_retrace_fib": "fib_label"},
}
_MADE = {"swing_high": ("dist_last_sh_pct",), "swing_low": ("dist_last_sl_pct",), "support": ("dist_support_pct",), "resistance": ("dist_resistance_pct",)}


def known_records(events: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column, value, known_ms): from when a value may stand in a ruled column; ``*`` for any value of it."""
    high = F.col("kind") == "high"
    rows = {"swing_high": events.where(high), "swing_low": events.where(~high), "support": events.where(~high), "resistance": events.where(high), "event": events, "leg": made, "successor_leg": made.where("retrace_known_ms IS NOT NULL")}
    time = {"leg": "known_ts_ms", "successor_leg": "retrace_known_ms"}
    out = None
    for record, df in rows.items():
        values = [F.struct(F.lit(c).alias("column"), F.expr(v).cast("string").alias("value")) for c, v in _SHOWN[record].items()]
        values += [F.struct(F.lit(c).alias("column"), F.lit("*").alias("value")) for c in _MADE.get(record, ())]
        part = df.select(*keys, F.explode(F.array(*values)).alias("x"), F.col(time.get(record, "confirm_ts_ms")).alias("known_ms"))
        part = part.groupBy(*keys, "x.column", "x.value").agg(F.min("known_ms").alias("known_ms"))
        out = part if out is None else out.unionByName(part)
    return out


def publication(features: DataFrame, known: DataFrame, keys: list[str], rules: dict[str, str] = PUBLICATION_RULES) -> DataFrame:
    """Per series and ruled column: how many of its values stand before a record with them is known, and a verdict.

    missing: the feature table has no such column. early: a value other than null (of the bias, other than 0) stands at a
    bar before any record of that value is known, be it the first record or a later one; a value that no
    record has is early wherever it stands. ok: else. ``known`` is what ``known_records`` gives.
    """
    there = [c for c in rules if c in features.columns]
    made = {c for columns in _MADE.values() for c in columns}
    series = features.select(*keys).distinct()
    told = features.sparkSession.createDataFrame(list(rules.items()), "column string, record string")
    every = series.join(F.broadcast(told))  # the rules are a fixed short list
    if not there:
        return every.select(*keys, "column", "record", F.lit(0).cast("long").alias("early_values"), F.lit("missing").alias("verdict"))
    own = lambda c: F.when(F.col(c).isNotNull(), F.lit("*")) if c in made else F.when(F.col(c) != 0, F.col(c).cast("string")) if c == "structure_bias" else F.col(c).cast("string")
    shown = features.select(*keys, "ts_ms", *[own(c).alias(c) for c in there]).unpivot([*keys, "ts_ms"], there, "column", "value").where("value IS NOT NULL")
    first = shown.groupBy(*keys, "column", "value").agg(F.min("ts_ms").alias("visible_ms")).join(known, [*keys, "column", "value"], "left")
    early = first.groupBy(*keys, "column").agg(F.count_if(F.col("known_ms").isNull() | (F.col("visible_ms") < F.col("known_ms"))).alias("early_values"))
    out = every.join(early, [*keys, "column"], "left").withColumn("early_values", F.coalesce("early_values", F.lit(0)))
    verdict = F.when(~F.col("column").isin(there), "missing").when(F.col("early_values") > 0, "early").otherwise("ok")
    return out.select(*keys, "column", "record", "early_values", verdict.alias("verdict"))


def name_scan(names: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Findings on column names (column)."""
    hard = F.lit(False)
    for t in (*HARD_TOKENS, *extra):
        hard = hard | F.lower("column").contains(t.lower())
    level = F.when(hard, "HARD").when(F.col("column").rlike(ADVISORY_PATTERN), "ADVISORY")
    message = F.when(F.col("_l") == "HARD", "the name is a label's or an outcome's").otherwise("the name looks ahead")
    return _finding(names.withColumn("_l", level).where("_l IS NOT NULL"), "name_scan", F.col("_l"), message)


def split_geometry(train: DataFrame, test: DataFrame, min_gap_ms: int, same_source: bool = False) -> DataFrame:
    """One finding: same source, empty, overlap, order, gap, or OK (advisory)."""
    t, s = train.agg(F.count("*").alias("n1"), F.max("ts_ms").alias("hi1")), test.agg(F.count("*").alias("n2"), F.min("ts_ms").alias("lo2"))
    both = train.select("ts_ms").intersect(test.select("ts_ms")).agg(F.count("*").alias("common"))
    one = t.crossJoin(s).crossJoin(both)  # three rows of one
    message = F.when(F.lit(same_source), "same source").when((F.col("n1") == 0) | (F.col("n2") == 0), "empty").when(F.col("common") > 0, "overlap").when(F.col("hi1") >= F.col("lo2"), "order").when(F.col("lo2") - F.col("hi1") < min_gap_ms, "gap").otherwise("ok")
    return one.select(F.lit("split_geometry").alias("check"), F.when(message == "ok", "ADVISORY").otherwise("HARD").alias("severity"), F.lit("*").alias("column"), message.alias("message"), "common")


def audit(bars: DataFrame, build, keys: list[str], horizons: list[int], stream: DataFrame | None = None, train: DataFrame | None = None, test: DataFrame | None = None, min_gap_ms: int = 0) -> DataFrame:
    """All checks' findings (check, severity, column, message); none HARD: no leakage was found.

    ``stream`` holds the features of a bar-by-bar run, ``train`` and ``test`` the times of a split. A check that lacks
    its input is itself a finding: HARD for the streaming tip, which decides, ADVISORY for the split.
    """
    features = build(bars)
    spark = bars.sparkSession
    names = spark.createDataFrame([(c,) for c in features.columns if c not in (*keys, "ts_ms")], "column string")
    out = prefix_invariance(bars, build, keys)
    for part in (future_mutation(bars, build, keys), responsiveness(bars, build, keys), name_scan(names)):
        out = out.unionByName(part)
    for check, bounds in (("forward_corr", (0.5, 0.2, 100, 50)), ("near_label", (0.95, 0.8, 80, 50))):
        corr = forward_correlation(features, bars, keys, horizons, *bounds, check).where("severity IS NOT NULL")
        out = out.unionByName(_finding(corr, check, F.col("severity"), F.concat(F.lit("correlates with "), F.col("horizon"))))
    skipped = lambda check, severity: spark.createDataFrame([(check, severity, "*", "the check was skipped")], out.schema)
    out = out.unionByName(streaming_tip(features, stream, keys) if stream is not None else skipped("streaming_tip", "HARD"))
    if train is None or test is None:
        return out.unionByName(skipped("split_geometry", "ADVISORY"))
    return out.unionByName(split_geometry(train, test, min_gap_ms).drop("common"))


def audit_verdict(findings: DataFrame) -> DataFrame:
    """One row: ok (nothing HARD), numbers of HARD and ADVISORY findings, and the columns with leakage potential in order."""
    hard = F.col("severity") == "HARD"
    columns = F.array_sort(F.collect_set(F.when(hard & (F.col("column") != "*"), F.col("column"))))
    return findings.agg((F.count_if(hard) == 0).alias("ok"), F.count_if(hard).alias("hard"), F.count_if(~hard).alias("advisory"), columns.alias("potential"))


def registry_marks(findings: DataFrame, seen_ms: int, symbol: str, timeframe: str) -> DataFrame:
    """What ``upsert.merge_registry`` takes up of an audit: its HARD findings on columns, in the order of checks and messages."""
    own = findings.where("severity = 'HARD' AND column <> '*'").select("column", F.concat_ws(": ", "check", "message").alias("reason")).distinct()
    number = F.row_number().over(Window.partitionBy("column").orderBy("reason")).cast("long")
    return own.select("column", number.alias("seq"), "reason", F.lit(seen_ms).cast("long").alias("seen"), F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"))


def marked(columns: DataFrame, registry: DataFrame) -> DataFrame:
    """``columns`` (column) with ``refused`` and the registry's reasons: those with leakage potential."""
    known = registry.groupBy("column").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    return columns.join(known, "column", "left").withColumn("refused", F.col("reasons").isNotNull())


def refuse(columns: list[str], registry: DataFrame) -> None:
    """Fail if one of the columns is in the registry; all of those are named."""
    bad = [r["column"] for r in registry.where(F.col("column").isin(columns)).select("column").distinct().collect()]
    if bad:
        raise ValueError(f"features with leakage potential: {sorted(bad)}")
