"""Leakage audit queries on features of the bar view, one of them with a planted look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators import leakage as lk
from tidebar.plans.registry import ORACLE, register
from tidebar.plans.structure import _LG
from tidebar.plans.views import TICKS, bars, bars_sql, ticks

K = ["symbol"]


def features(b: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    return b.select("symbol", "ts_ms", F.round(F.col("close") / F.lag("close").over(w) - 1, 8).alias("ret_1"), F.round(F.avg("close").over(w.rowsBetween(-5, 0)), 8).alias("sma_6"), F.lead("close").over(w).alias("future_close"), F.round(F.avg("close").over(w.rowsBetween(-2, 2)), 8).alias("centred"))


_F = f"""{bars_sql()}, f AS (SELECT symbol, ts_ms, round(close / lag(close) OVER w - 1, 8) AS ret_1, lead(close) OVER w AS future_close, round(lead(close, 1) OVER w / close - 1, 8) AS fwd_1, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))"""


def _b(spark, d):
    return bars(spark, d).select("symbol", "ts_ms", "open", "high", "low", "close", "volume")


_COLUMNS = ("ret_1", "sma_6", "future_close", "centred")


def _features_sql(source: str) -> str:
    return f"""(SELECT symbol, ts_ms, close / lag(close) OVER w - 1 AS ret_1, avg(close) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS sma_6, lead(close) OVER w AS future_close, avg(close) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS centred
 FROM ({source}) WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))"""


def _changed_sql(check: str, message: str, ctes: list[tuple[str, str, str]]) -> str:
    """Columns of which some value of (part, whole, where) differs; tolerance above rounding."""
    parts = [
        f"SELECT '{c}' AS c FROM {part} a JOIN {whole} z USING (symbol, ts_ms) WHERE ({where}) AND (abs(a.{c} - z.{c}) > 1e-6 OR (a.{c} IS NULL) <> (z.{c} IS NULL))"
        for part, whole, where in ctes for c in _COLUMNS
    ]
    return f"""SELECT DISTINCT '{check}' AS "check", 'HARD' AS severity, c AS "column", '{message}' AS message FROM ({' UNION ALL '.join(parts)})"""


_B = f"""{bars_sql()}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), whole AS {_features_sql('SELECT * FROM b')}"""
_CUTS = (0.7, 0.81, 0.92)
_PREFIXES = ", ".join(f"p{k} AS {_features_sql(f'SELECT * FROM b WHERE i <= floor(n * {c}::DOUBLE)')}" for k, c in enumerate(_CUTS))
_TAIL = "(symbol, ts_ms) IN (SELECT (symbol, ts_ms) FROM b WHERE i > floor(n * {c}::DOUBLE) - 50)"


@register("lk01_prefix_invariance", f"WITH {_B}, {_PREFIXES} " + _changed_sql("prefix_invariance", "changes when later bars are removed", [(f"p{k}", "whole", _TAIL.format(c=c)) for k, c in enumerate(_CUTS)]))
def _(spark, d):
    return lk.prefix_invariance(_b(spark, d), features, K)


_MUTATED = _features_sql("SELECT symbol, ts_ms, CASE WHEN i > floor(n * 0.8::DOUBLE) THEN close * 10 ELSE close END AS close FROM b")


@register("lk02_future_mutation", f"WITH {_B}, m AS {_MUTATED} " + _changed_sql("future_mutation", "past changes with the future", [("m", "whole", "(symbol, ts_ms) IN (SELECT (symbol, ts_ms) FROM b WHERE i <= floor(n * 0.8::DOUBLE))")]))
def _(spark, d):
    return lk.future_mutation(_b(spark, d), features, K)


_SLOW = ("ret_1", "frozen", "clock", "hour")


def _slow_sql(source: str) -> str:
    return f"(SELECT symbol, ts_ms, close / lag(close) OVER w - 1 AS ret_1, 1.0::DOUBLE AS frozen, ts_ms % 7 AS clock, (ts_ms // 3600000) % 24 AS hour FROM ({source}) WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms))"


_TURNED = """t0 AS (SELECT symbol, ts_ms, i, n, close, CASE WHEN i > n - 40 THEN ln(close / lag(close) OVER w) END AS r, max(CASE WHEN i = n - 40 THEN close END) OVER (PARTITION BY symbol) AS base FROM b WINDOW w AS (PARTITION BY symbol ORDER BY i)),
 t1 AS (SELECT t.symbol, t.ts_ms, t.i, t.n, t.close AS old, t.base, coalesce(u.r, 0) AS rr FROM t0 t LEFT JOIN t0 u ON u.symbol = t.symbol AND t.i > t.n - 40 AND u.i = 2 * t.n - 39 - t.i),
 turned AS (SELECT symbol, ts_ms, CASE WHEN i > n - 40 THEN base * exp(sum(rr) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)) ELSE old END AS close FROM t1)"""


def _stuck_sql(columns: tuple[str, ...], old: str, new: str) -> str:
    """Findings on columns that stay when the tip's path is turned around."""
    parts = " UNION ALL ".join(f"SELECT '{c}' AS c, max(coalesce(abs(o.{c} - z.{c}), 0)) <= 1e-12 AND count(*) FILTER (WHERE (o.{c} IS NULL) <> (z.{c} IS NULL)) = 0 AS stuck FROM {old} o JOIN {new} z USING (symbol, ts_ms) JOIN b USING (symbol, ts_ms) WHERE i > n - 40" for c in columns)
    return f"""SELECT 'responsiveness' AS "check", CASE WHEN bad = total THEN 'HARD' ELSE 'ADVISORY' END AS severity, c AS "column", 'does not move with the last bars' AS message
 FROM (SELECT *, count(*) OVER () AS total, count(*) FILTER (WHERE stuck) OVER () AS bad FROM ({parts})) WHERE stuck AND (bad = total OR bad >= greatest(3, total * 0.5))"""


@register("lk03_responsiveness", f"WITH {_B}, {_TURNED}, o AS {_slow_sql('SELECT symbol, ts_ms, close FROM b')}, z AS {_slow_sql('SELECT * FROM turned')} " + _stuck_sql(_SLOW, "o", "z"))
def _(spark, d):
    """Three of four columns do not look at prices."""
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    hour = F.floor(F.col("ts_ms") / 3_600_000) % 24
    build = lambda b: b.select("symbol", "ts_ms", (F.col("close") / F.lag("close").over(w) - 1).alias("ret_1"), F.lit(1.0).alias("frozen"), (F.col("ts_ms") % 7).alias("clock"), hour.alias("hour"))
    return lk.responsiveness(_b(spark, d), build, K)


#: A bar-by-bar run ends this many bars before the batch does.
_BEHIND = 20


def _behind(b: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("ts_ms"))
    return b.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > _BEHIND).drop("_n")


_SLICES = [1_705_276_800_000, 1_705_280_400_000, 1 << 50]


@register("lk04_streaming_tip", f"""WITH s AS ({ORACLE["wn07_last_label"]}), l AS ({ORACLE["wn06_last_swings"]}), e AS (SELECT s.symbol, s.ts_ms, last_structure_label, structure_bias, last_sl_price, lag(last_structure_label, 24) OVER w AS old_label, lag(last_sl_price, 24) OVER w AS old_low, row_number() OVER (PARTITION BY s.symbol ORDER BY s.ts_ms DESC) AS n
 FROM s JOIN l USING (symbol, ts_ms) WINDOW w AS (PARTITION BY s.symbol ORDER BY s.ts_ms)), tip AS (SELECT * FROM e WHERE n = {_BEHIND + 1}),
 bad AS (SELECT 'last_structure_label' AS c FROM tip WHERE last_structure_label IS DISTINCT FROM old_label UNION SELECT 'last_sl_price' FROM tip WHERE last_sl_price IS DISTINCT FROM old_low UNION SELECT 'structure_bias' FROM tip WHERE symbol < 'm')
SELECT 'streaming_tip' AS "check", 'HARD' AS severity, c AS "column", 'stream and batch disagree' AS message FROM bad""")
def _(spark, d):
    """The feature matrix bar by bar, from a state per series over landed slices, against the batch at the run's last bar.

    The run itself agrees in every column. Two faults are planted in it: label and last low stand still for a day, the bias is off by one for some symbols.
    """
    from tidebar.operators import structure as st
    from tidebar.scratch import scratch_path
    from tidebar.streaming.features import replay, stream_features

    b = _b(spark, d).select("symbol", "ts_ms", "high", "low", "close")
    run = replay(_behind(b), _SLICES, lambda s: stream_features(s, K), scratch_path(spark, "bar-by-bar"))
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    wrong = run.withColumns({c: F.lag(c, 24).over(w) for c in ("last_structure_label", "last_sl_price")}).withColumn("structure_bias", F.col("structure_bias") + F.when(F.col("symbol") < "m", 1).otherwise(0))
    return lk.streaming_tip(st.bar_features(b, keys=K), wrong, K)


@register("jn16_frame_diff", f"WITH {_F} SELECT 'ret_1' AS \"column\", 0.5::DOUBLE AS max_diff, count(*) FILTER (WHERE (ret_1 IS NULL) <> (CASE WHEN ts_ms % 10800000 <> 0 THEN ret_1 END IS NULL)) AS null_mismatch FROM f")
def _(spark, d):
    f = features(_b(spark, d)).select("symbol", "ts_ms", "ret_1")
    g = f.withColumn("ret_1", F.when(F.col("ts_ms") % 10_800_000 != 0, F.col("ret_1") + 0.5))
    return lk.frame_diff(f, g, ["symbol", "ts_ms"]).withColumn("max_diff", F.round("max_diff", 6))


_CORR = f"""WITH {_F}, y AS (SELECT symbol, ts_ms, lead(close, 1) OVER w / close - 1 AS fwd_1, lead(close, 3) OVER w / close - 1 AS fwd_3 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
 c AS (SELECT 'ret_1' AS "column", 'fwd_1' AS horizon, corr(ret_1, y.fwd_1) AS corr, count(*) FILTER (WHERE ret_1 IS NOT NULL AND y.fwd_1 IS NOT NULL) AS n FROM f JOIN y USING (symbol, ts_ms) UNION ALL
  SELECT 'ret_1', 'fwd_3', corr(ret_1, y.fwd_3), count(*) FILTER (WHERE ret_1 IS NOT NULL AND y.fwd_3 IS NOT NULL) FROM f JOIN y USING (symbol, ts_ms) UNION ALL
  SELECT 'future_close', 'fwd_1', corr(future_close, y.fwd_1), count(*) FILTER (WHERE future_close IS NOT NULL AND y.fwd_1 IS NOT NULL) FROM f JOIN y USING (symbol, ts_ms) UNION ALL
  SELECT 'future_close', 'fwd_3', corr(future_close, y.fwd_3), count(*) FILTER (WHERE future_close IS NOT NULL AND y.fwd_3 IS NOT NULL) FROM f JOIN y USING (symbol, ts_ms)),
 t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY abs(corr) DESC) = 1)
SELECT "column", horizon, round(corr, 6) AS corr, n, CASE WHEN abs(corr) >= {{hard}} THEN 'HARD' WHEN abs(corr) >= {{adv}} THEN 'ADVISORY' END AS severity, '{{check}}' AS "check" FROM t"""


@register("lk05_forward_corr", _CORR.format(hard=0.5, adv=0.2, check="forward_corr"))
def _(spark, d):
    b = _b(spark, d)
    return lk.forward_correlation(features(b).select("symbol", "ts_ms", "ret_1", "future_close"), b, K, [1, 3]).withColumn("corr", F.round("corr", 6))


@register("lk06_near_label", _CORR.format(hard=0.95, adv=0.8, check="near_label"))
def _(spark, d):
    b = _b(spark, d)
    return lk.forward_correlation(features(b).select("symbol", "ts_ms", "ret_1", "future_close"), b, K, [1, 3], 0.95, 0.8, 80, 50, "near_label").withColumn("corr", F.round("corr", 6))


#: Beginnings of names, and what the scan must say of them.
_NAMES = [("net_return", "HARD"), ("is_win_", "HARD"), ("TP_touch_", "HARD"), ("my_label_", "HARD"), ("target_", "HARD"), ("y_hat_", "HARD"), ("future_", "ADVISORY"), ("Fwd_", "ADVISORY"), ("lookahead", "ADVISORY"), ("next_ret_", "ADVISORY"), ("next_", None), ("lead_", None), ("sma_", None)]
_NAMED = ", ".join(f"({i}, '{n}', {'NULL' if s is None else repr(s)})" for i, (n, s) in enumerate(_NAMES))


@register("lk07_name_scan", f"""WITH p(i, name, severity) AS (VALUES {_NAMED}) SELECT DISTINCT 'name_scan' AS "check", severity, name || event_type AS "column", CASE severity WHEN 'HARD' THEN 'the name is a label''s or an outcome''s' ELSE 'the name looks ahead' END AS message
FROM events JOIN p ON i = user_id % {len(_NAMES)} WHERE severity IS NOT NULL""")
def _(spark, d):
    from tidebar.plans.views import read

    name = F.element_at(F.array(*[F.lit(n) for n, _ in _NAMES]), (F.col("user_id") % len(_NAMES) + 1).cast("int"))
    return lk.name_scan(read(spark, d, "events").select(F.concat(name, "event_type").alias("column")).distinct())


@register("lk08_split_geometry", f"""WITH {bars_sql()}, c(cut, least) AS (SELECT 1705276800000, 86400000 UNION ALL SELECT 1705276800000, 0 UNION ALL SELECT 0, 0), t AS (SELECT cut, least, count(*) FILTER (WHERE ts_ms < cut) AS n1, count(*) FILTER (WHERE ts_ms >= cut) AS n2, max(ts_ms) FILTER (WHERE ts_ms < cut) AS hi, min(ts_ms) FILTER (WHERE ts_ms >= cut) AS lo FROM bars, c GROUP BY ALL),
 r AS (SELECT CASE WHEN n1 = 0 OR n2 = 0 THEN 'empty' WHEN hi >= lo THEN 'order' WHEN lo - hi < least THEN 'gap' ELSE 'ok' END AS message, 0::BIGINT AS common FROM t
  UNION ALL SELECT 'overlap', count(DISTINCT ts_ms) FROM bars WHERE ts_ms < 1705276800000)
SELECT 'split_geometry' AS "check", CASE message WHEN 'ok' THEN 'ADVISORY' ELSE 'HARD' END AS severity, '*' AS "column", message, common FROM r""")
def _(spark, d):
    """Four splits of the bars: too near, far enough, an empty side, and one that shares its times."""
    b, at = _b(spark, d), 1_705_276_800_000
    early, late = b.where(F.col("ts_ms") < at), b.where(F.col("ts_ms") >= at)
    out = lk.split_geometry(early, late, 86_400_000).unionByName(lk.split_geometry(early, late, 0))
    return out.unionByName(lk.split_geometry(b.where("ts_ms < 0"), b, 0)).unionByName(lk.split_geometry(b, early, 0))


@register("lk10_registry_gate", f"""WITH {TICKS}, reg AS (SELECT symbol AS c, list_sort(list(DISTINCT 'r' || (user_id % 3))) AS reasons FROM ticks WHERE seq % 2 = 0 AND symbol < 'm' GROUP BY symbol)
SELECT DISTINCT symbol AS "column", reg.c IS NOT NULL AS refused, array_to_string(reasons, ',') AS reasons FROM ticks LEFT JOIN reg ON reg.c = symbol""")
def _(spark, d):
    t = ticks(spark, d)
    registry = t.where("seq % 2 = 0 AND symbol < 'm'").groupBy(F.col("symbol").alias("column")).agg(F.collect_set(F.concat(F.lit("r"), F.col("user_id") % 3)).alias("reasons"))
    return lk.marked(t.select(F.col("symbol").alias("column")).distinct(), registry).select("column", "refused", F.array_join("reasons", ",").alias("reasons"))


def _running(held: dict, bar: dict) -> dict:
    """The same features from the closes seen so far: what lies ahead is not there yet."""
    seen = held.setdefault("closes", [])
    seen.append(bar["close"])
    del seen[:-6]
    return {"ret_1": round(seen[-1] / seen[-2] - 1, 8) if len(seen) > 1 else None, "sma_6": round(sum(seen) / len(seen), 8), "future_close": None, "centred": round(sum(seen[-3:]) / len(seen[-3:]), 8)}


def _findings(spark, d) -> DataFrame:
    from tidebar.scratch import scratch_path
    from tidebar.streaming.features import replay, stepped

    b, at = _b(spark, d), 1_705_276_800_000
    build = lambda s: stepped(s, K, _running, ", ".join(f"{c} double" for c in _COLUMNS), ("close",))
    run = replay(_behind(b).select("symbol", "ts_ms", "close"), _SLICES, build, scratch_path(spark, "bar-by-bar"))
    return lk.audit(b, features, K, [1, 3], run, b.where(F.col("ts_ms") < at), b.where(F.col("ts_ms") >= at), 86_400_000)


def _correlated_sql(check: str, hard: float, advisory: float, least: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS c, 'fwd_{h}' AS h, corr({c}, fwd_{h}) AS r, count(*) AS total, count(*) FILTER (WHERE {c} IS NOT NULL AND fwd_{h} IS NOT NULL) AS n FROM whole JOIN y USING (symbol, ts_ms)" for c in _COLUMNS for h in (1, 3)
    )
    return f"""SELECT '{check}', CASE WHEN abs(r) >= {hard} THEN 'HARD' ELSE 'ADVISORY' END, c, 'correlates with ' || h FROM (SELECT * FROM ({parts}) WHERE total >= {least} AND n >= 50 AND r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c ORDER BY abs(r) DESC, h DESC) = 1) WHERE abs(r) >= {advisory}"""


_TIPS = " UNION ".join(f"SELECT '{c}' AS c FROM part a JOIN whole z USING (symbol, ts_ms) JOIN b USING (symbol, ts_ms) WHERE i = n - {_BEHIND} AND (abs(a.{c} - z.{c}) > 1e-6 OR (a.{c} IS NULL) <> (z.{c} IS NULL))" for c in _COLUMNS)
_HARD_NAMES = " OR ".join(f"contains(lower(c), '{t}')" for t in lk.HARD_TOKENS)
_FINDINGS = f"""{_B}, {_PREFIXES}, m AS {_MUTATED}, {_TURNED}, z AS {_features_sql('SELECT * FROM turned')}, part AS {_features_sql(f'SELECT symbol, ts_ms, close FROM b WHERE i <= n - {_BEHIND}')},
 y AS (SELECT symbol, ts_ms, lead(close, 1) OVER w / close - 1 AS fwd_1, lead(close, 3) OVER w / close - 1 AS fwd_3 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
 sides AS (SELECT count(*) FILTER (WHERE ts_ms < {_SLICES[0]}) AS n1, count(*) FILTER (WHERE ts_ms >= {_SLICES[0]}) AS n2, max(ts_ms) FILTER (WHERE ts_ms < {_SLICES[0]}) AS hi, min(ts_ms) FILTER (WHERE ts_ms >= {_SLICES[0]}) AS lo FROM b),
 split AS (SELECT CASE WHEN n1 = 0 OR n2 = 0 THEN 'empty' WHEN hi >= lo THEN 'order' WHEN lo - hi < 86400000 THEN 'gap' ELSE 'ok' END AS message FROM sides),
 findings AS ({_changed_sql("prefix_invariance", "changes when later bars are removed", [(f"p{k}", "whole", _TAIL.format(c=c)) for k, c in enumerate(_CUTS)])}
  UNION ALL {_changed_sql("future_mutation", "past changes with the future", [("m", "whole", "(symbol, ts_ms) IN (SELECT (symbol, ts_ms) FROM b WHERE i <= floor(n * 0.8::DOUBLE))")])}
  UNION ALL {_stuck_sql(_COLUMNS, "whole", "z")}
  UNION ALL SELECT 'name_scan', CASE WHEN {_HARD_NAMES} THEN 'HARD' ELSE 'ADVISORY' END, c, CASE WHEN {_HARD_NAMES} THEN 'the name is a label''s or an outcome''s' ELSE 'the name looks ahead' END FROM (VALUES {', '.join(f"('{c}')" for c in _COLUMNS)}) v(c) WHERE {_HARD_NAMES} OR regexp_matches(c, '{lk.ADVISORY_PATTERN}')
  UNION ALL {_correlated_sql("forward_corr", 0.5, 0.2, 100)} UNION ALL {_correlated_sql("near_label", 0.95, 0.8, 80)}
  UNION ALL SELECT 'streaming_tip', 'HARD', c, 'stream and batch disagree' FROM ({_TIPS})
  UNION ALL SELECT 'split_geometry', CASE message WHEN 'ok' THEN 'ADVISORY' ELSE 'HARD' END, '*', message FROM split)"""


@register("lk09_audit", f"WITH {_FINDINGS} SELECT * FROM findings")
def _(spark, d):
    """The whole battery on features of which two look ahead: checks on the batch, and a bar-by-bar run that ends before the batch does."""
    return _findings(spark, d)


_POTENTIAL = """SELECT count(*) FILTER (WHERE severity = 'HARD') = 0 AS ok, count(*) FILTER (WHERE severity = 'HARD') AS hard, count(*) FILTER (WHERE severity <> 'HARD') AS advisory, (SELECT string_agg(DISTINCT "column", ',' ORDER BY "column") FROM findings WHERE severity = 'HARD' AND "column" <> '*') AS potential FROM findings"""


@register("lk09_verdict", f"WITH {_FINDINGS} {_POTENTIAL}")
def _(spark, d):
    return lk.audit_verdict(_findings(spark, d)).withColumn("potential", F.array_join("potential", ","))


@register("lk09_registry_mark", f"""WITH {_FINDINGS}, reasons AS (SELECT DISTINCT "column", "check" || ': ' || message AS reason FROM findings WHERE severity = 'HARD' AND "column" <> '*')
SELECT "column", CASE WHEN "column" = 'centred' THEN 'seen before,' ELSE '' END || string_agg(reason, ',' ORDER BY reason) AS reasons, CASE WHEN "column" = 'centred' THEN 5 ELSE 9 END::BIGINT AS first_seen, 9::BIGINT AS last_seen FROM reasons GROUP BY "column" """)
def _(spark, d):
    """The battery's columns with leakage potential taken up by the registry, which already holds one of them."""
    from tidebar.operators.upsert import merge_registry

    kept = spark.createDataFrame([("centred", ["seen before"], 5, 5, "*", "1h")], "column string, reasons array<string>, first_seen long, last_seen long, symbol string, timeframe string")
    out = merge_registry(kept, lk.registry_marks(_findings(spark, d), 9, "*", "1h"))
    return out.select("column", F.array_join("reasons", ",").alias("reasons"), "first_seen", "last_seen")


_RECORDS = {
    "swing_high": ("events_", "kind = 'high'", "confirm_ts_ms", {"last_sh_price": "price"}, ("dist_last_sh_pct",)),
    "swing_low": ("events_", "kind = 'low'", "confirm_ts_ms", {"last_sl_price": "price"}, ("dist_last_sl_pct",)),
    "support": ("events_", "kind = 'low'", "confirm_ts_ms", {"nearest_support": "price"}, ()),
    "resistance": ("events_", "kind = 'high'", "confirm_ts_ms", {"nearest_resistance": "price"}, ()),
    "event": ("events_", "true", "confirm_ts_ms", {"structure_bias": "bias", "last_structure_label": "label"}, ()),
    "leg": ("legs", "true", "known_ts_ms", {"last_leg_dir": "direction", "last_leg_kind": "leg_kind", "last_leg_len_pct": "round(length_pct, 6)", "fib_0000": "round(end_price, 6)", "fib_1000": "round(start_price, 6)"}, ()),
    "successor_leg": ("legs", "retrace_known_ms IS NOT NULL", "retrace_known_ms", {"last_retrace_pct": "round(retrace_pct, 6)", "last_retrace_fib": "fib_label"}, ()),
}
_KNOWN = " UNION ALL ".join(
    f"SELECT symbol, '{c}' AS c, {v}::VARCHAR AS v, {time} AS known FROM {table} WHERE {where}"
    for table, where, time, values, made in _RECORDS.values() for c, v in [*values.items(), *((m, "'*'") for m in made)]
)
#: What a value stands as in SQL; the two distances to levels are there where the levels are.
_STANDS = {"dist_last_sh_pct": "CASE WHEN dist_last_sh_pct IS NOT NULL THEN '*' END", "dist_last_sl_pct": "CASE WHEN dist_last_sl_pct IS NOT NULL THEN '*' END", "dist_support_pct": "nearest_support::VARCHAR", "dist_resistance_pct": "nearest_resistance::VARCHAR", "structure_bias": "nullif(structure_bias, 0)::VARCHAR"}
_RULED = [c for c in lk.PUBLICATION_RULES if c != "last_retrace_fib"]
_FIRST = " UNION ALL ".join(f"SELECT symbol, '{c}' AS c, {_STANDS.get(c, f'{c}::VARCHAR')} AS v, min(ts_ms) AS seen FROM shown GROUP BY ALL" for c in _RULED)
_SAME = {"dist_support_pct": "nearest_support", "dist_resistance_pct": "nearest_resistance"}


@register("lk11_publication_rules", f"""WITH {_LG}, f AS ({ORACLE["src04_bar_features"]}), w AS (SELECT *, lead(last_sh_price) OVER o AS next_price, lead(last_leg_dir, 3) OVER o AS next_dir FROM f WINDOW o AS (PARTITION BY symbol ORDER BY ts_ms)),
 shown AS (SELECT * REPLACE (CASE WHEN symbol < 'm' THEN coalesce(next_price, last_sh_price) ELSE last_sh_price END AS last_sh_price, coalesce(next_dir, last_leg_dir) AS last_leg_dir) FROM w),
 k AS (SELECT symbol, c, v, min(known) AS known FROM ({_KNOWN}) GROUP BY ALL), first AS (SELECT * FROM ({_FIRST}) WHERE v IS NOT NULL),
 early AS (SELECT first.symbol, first.c, count(*) FILTER (WHERE known IS NULL OR seen < known) AS n FROM first LEFT JOIN k ON k.symbol = first.symbol AND k.v = first.v AND k.c = CASE first.c {' '.join(f"WHEN '{c}' THEN '{x}'" for c, x in _SAME.items())} ELSE first.c END GROUP BY ALL),
 p("column", record) AS (VALUES {", ".join(f"('{c}', '{r}')" for c, r in lk.PUBLICATION_RULES.items())})
SELECT s.symbol, p."column", p.record, coalesce(n, 0) AS early_values, CASE WHEN p."column" = 'last_retrace_fib' THEN 'missing' WHEN n > 0 THEN 'early' ELSE 'ok' END AS verdict FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN p LEFT JOIN early ON early.symbol = s.symbol AND early.c = p."column" """)
def _(spark, d):
    """Every ruled column of the bar features against the records behind its values.

    Planted: one column is missing, swing highs of some symbols are shown a bar early, the leg's direction three bars.
    """
    from tidebar.operators import structure as st

    b = _b(spark, d).drop("volume")
    events = st.label_events(st.swings(b, keys=K), K)
    known = lk.known_records(events, st.legs(events, K), K)
    w = Window.partitionBy("symbol").orderBy("ts_ms")
    f = st.bar_features(b, keys=K).drop("last_retrace_fib")
    ahead = F.coalesce(F.lead("last_sh_price").over(w), "last_sh_price")
    f = f.withColumns({"last_sh_price": F.when(F.col("symbol") < "m", ahead).otherwise(F.col("last_sh_price")), "last_leg_dir": F.coalesce(F.lead("last_leg_dir", 3).over(w), "last_leg_dir")})
    return lk.publication(f, known, K)
