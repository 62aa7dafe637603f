"""Price-structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions.scalar import RATIOS, RETRACEMENTS, fib_column, fib_label
from tidebar.operators import structure as st
from tidebar.plans.registry import ORACLE, register
from tidebar.plans.views import bars, bars_sql

_K = ["symbol"]

_SW = f"""{bars_sql()}, n AS (SELECT symbol, ts_ms, close, high, low, row_number() OVER w - 1 AS i, lag(ts_ms, 2) OVER w AS l2, lead(ts_ms, 2) OVER w AS r2,
  greatest(lag(high, 1) OVER w, lag(high, 2) OVER w, lead(high, 1) OVER w, lead(high, 2) OVER w) AS h4, least(lag(low, 1) OVER w, lag(low, 2) OVER w, lead(low, 1) OVER w, lead(low, 2) OVER w) AS l4
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts_ms)),
 s0 AS (SELECT symbol, i AS pivot_i, ts_ms AS pivot_ts_ms, r2 AS confirm_ts_ms, 'high' AS kind, high AS price FROM n WHERE l2 IS NOT NULL AND r2 IS NOT NULL AND high > h4
  UNION ALL SELECT symbol, i, ts_ms, r2, 'low', low FROM n WHERE l2 IS NOT NULL AND r2 IS NOT NULL AND low < l4),
 swings AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pivot_i, kind DESC) - 1 AS swing_id FROM s0)"""
_EV = f"""{_SW}, e0 AS (SELECT *, lag(price) OVER k AS lp, lag(swing_id) OVER k AS prev_swing_id FROM swings WINDOW k AS (PARTITION BY symbol, kind ORDER BY swing_id)),
 e1 AS (SELECT *, CASE WHEN kind = 'high' THEN CASE WHEN lp IS NULL THEN 'SH' WHEN price > lp THEN 'HH' ELSE 'LH' END ELSE CASE WHEN lp IS NULL THEN 'SL' WHEN price > lp THEN 'HL' ELSE 'LL' END END AS label FROM e0),
 events_ AS (SELECT *, sign(sum(CASE WHEN label IN ('HH', 'HL') THEN 1 WHEN label IN ('LH', 'LL') THEN -1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY swing_id ROWS UNBOUNDED PRECEDING))::INTEGER AS bias FROM e1)"""
_NEAREST = "CASE WHEN retrace_pct IS NULL THEN NULL ELSE list_sort([" + ", ".join(f"{{'e': abs({r} - abs(retrace_pct)), 'i': {i}, 'l': '{fib_label(r)}'}}" for i, r in enumerate(RETRACEMENTS)) + "])[1].l END"
_LG = f"""{_EV}, l0 AS (SELECT symbol, kind, lag(kind) OVER w AS start_kind, swing_id AS end_swing_id, lag(swing_id) OVER w AS start_swing_id, pivot_ts_ms AS end_ts_ms, lag(pivot_ts_ms) OVER w AS start_ts_ms, price AS end_price,
  lag(price) OVER w AS start_price, greatest(confirm_ts_ms, lag(confirm_ts_ms) OVER w) AS known_ts_ms, bias FROM events_ WINDOW w AS (PARTITION BY symbol ORDER BY swing_id)),
 l1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY end_swing_id) - 1 AS leg_id, lead(end_price) OVER (PARTITION BY symbol ORDER BY end_swing_id) AS nxt, lead(known_ts_ms) OVER (PARTITION BY symbol ORDER BY end_swing_id) AS retrace_known_ms FROM l0 WHERE kind <> start_kind),
 l2 AS (SELECT *, CASE WHEN end_price > start_price THEN 'up' ELSE 'down' END AS direction, abs(end_price - start_price) AS length_abs, abs(end_price - start_price) / nullif(0.5 * (abs(end_price) + abs(start_price)), 0) AS length_pct,
  CASE WHEN bias = 0 THEN 'unknown' WHEN (bias > 0) = (end_price > start_price) THEN 'impulse' ELSE 'correction' END AS leg_kind, CASE WHEN abs(end_price - start_price) >= 1e-15 THEN (end_price - nxt) / (end_price - start_price) END AS retrace_pct FROM l1),
 legs AS (SELECT *, {_NEAREST} AS fib_label FROM l2)"""


def _prep(spark, d):
    b = bars(spark, d).select("symbol", "ts_ms", "high", "low", "close")
    return b, st.swings(b, keys=_K)


@register("wn01_swings", f"WITH {_SW} SELECT symbol, swing_id, kind, pivot_i, pivot_i + 2 AS confirm_i, pivot_ts_ms, confirm_ts_ms, price FROM swings")
def _(spark, d):
    return _prep(spark, d)[1]


@register("wn02_wn03_labels", f"WITH {_EV} SELECT symbol, swing_id, label, prev_swing_id, bias, price, confirm_ts_ms FROM events_")
def _(spark, d):
    return st.label_events(_prep(spark, d)[1], _K, 7 * 86_400_000).select("symbol", "swing_id", "label", "prev_swing_id", "bias", "price", "confirm_ts_ms")


@register("wn04_wn05_legs", f"WITH {_LG} SELECT symbol, leg_id, direction, leg_kind, start_swing_id, end_swing_id, start_ts_ms, end_ts_ms, known_ts_ms, retrace_known_ms, round(length_abs, 6) AS length_abs, round(length_pct, 6) AS length_pct, round(retrace_pct, 6) AS retrace_pct, fib_label FROM legs")
def _(spark, d):
    made = st.legs(st.label_events(_prep(spark, d)[1], _K), _K)
    return made.select("symbol", "leg_id", "direction", "leg_kind", "start_swing_id", "end_swing_id", "start_ts_ms", "end_ts_ms", "known_ts_ms", "retrace_known_ms", *[F.round(c, 6).alias(c) for c in ("length_abs", "length_pct", "retrace_pct")], "fib_label")


def _asof(table: str, where: str, time: str, order: str, values: str) -> str:
    return f"(SELECT symbol, {time} AS t, {values} FROM {table} WHERE {where} QUALIFY row_number() OVER (PARTITION BY symbol, {time} ORDER BY {order} DESC) = 1)"


@register("wn06_last_swings", f"""WITH {_SW} SELECT b.symbol, b.ts_ms, h.price AS last_sh_price, h.pivot_ts_ms AS last_sh_ts_ms, round((b.close - h.price) / b.close, 6) AS dist_last_sh_pct, l.price AS last_sl_price, l.pivot_ts_ms AS last_sl_ts_ms, round((b.close - l.price) / b.close, 6) AS dist_last_sl_pct
FROM bars b ASOF LEFT JOIN {_asof('swings', "kind = 'high'", 'confirm_ts_ms', 'swing_id', 'price, pivot_ts_ms')} h ON b.symbol = h.symbol AND b.ts_ms >= h.t ASOF LEFT JOIN {_asof('swings', "kind = 'low'", 'confirm_ts_ms', 'swing_id', 'price, pivot_ts_ms')} l ON b.symbol = l.symbol AND b.ts_ms >= l.t""")
def _(spark, d):
    b, s = _prep(spark, d)
    out = st.last_swings(b.select("symbol", "ts_ms", "close"), s, _K)
    return out.drop("close").withColumns({c: F.round(c, 6) for c in ("dist_last_sh_pct", "dist_last_sl_pct")})


@register("wn07_last_label", f"""WITH {_EV} SELECT b.symbol, b.ts_ms, e.label AS last_structure_label, coalesce(e.bias, 0) AS structure_bias FROM bars b ASOF LEFT JOIN {_asof('events_', 'true', 'confirm_ts_ms', 'swing_id', 'label, bias')} e ON b.symbol = e.symbol AND b.ts_ms >= e.t""")
def _(spark, d):
    b, s = _prep(spark, d)
    return st.last_label(b.select("symbol", "ts_ms"), st.label_events(s, _K), _K)


_FIB = ", ".join(f"round({'e.end_price - ' + str(r) + ' * (e.end_price - e.start_price)' if r <= 1 else 'e.start_price + ' + str(r) + ' * (e.end_price - e.start_price)'}, 6) AS {fib_column(r)}" for r in RATIOS)


@register("wn08_last_leg", f"""WITH {_LG} SELECT b.symbol, b.ts_ms, e.direction AS last_leg_dir, e.leg_kind AS last_leg_kind, round(e.length_pct, 6) AS last_leg_len_pct, {_FIB},
 round((e.end_price - 0.618 * (e.end_price - e.start_price) - b.close) / b.close, 6) AS dist_fib_0618_pct FROM bars b ASOF LEFT JOIN {_asof('legs', 'true', 'known_ts_ms', 'leg_id', 'direction, leg_kind, length_pct, start_price, end_price')} e ON b.symbol = e.symbol AND b.ts_ms >= e.t""")
def _(spark, d):
    b, s = _prep(spark, d)
    out = st.last_leg(b.select("symbol", "ts_ms", "close"), st.legs(st.label_events(s, _K), _K), _K)
    return out.select("symbol", "ts_ms", "last_leg_dir", "last_leg_kind", *[F.round(c, 6).alias(c) for c in ("last_leg_len_pct", *map(fib_column, RATIOS), "dist_fib_0618_pct")])


@register("wn09_last_retracement", f"""WITH {_LG} SELECT b.symbol, b.ts_ms, round(e.retrace_pct, 6) AS last_retrace_pct, e.fib_label AS last_retrace_fib FROM bars b ASOF LEFT JOIN {_asof('legs', 'retrace_known_ms IS NOT NULL', 'retrace_known_ms', 'leg_id', 'retrace_pct, fib_label')} e ON b.symbol = e.symbol AND b.ts_ms >= e.t""")
def _(spark, d):
    b, s = _prep(spark, d)
    return st.last_retracement(b.select("symbol", "ts_ms"), st.legs(st.label_events(s, _K), _K), _K).withColumn("last_retrace_pct", F.round("last_retrace_pct", 6))


@register("jn04_nearest_levels", f"""WITH {_SW} SELECT b.symbol, b.ts_ms, max(price) FILTER (WHERE kind = 'low' AND price <= close) AS nearest_support, min(price) FILTER (WHERE kind = 'high' AND price >= close) AS nearest_resistance
FROM bars b LEFT JOIN swings s ON b.symbol = s.symbol AND s.confirm_ts_ms <= b.ts_ms GROUP BY b.symbol, b.ts_ms""")
def _(spark, d):
    b, s = _prep(spark, d)
    return st.nearest_levels(b.select("symbol", "ts_ms", "close"), st.levels(s, _K), _K).select("symbol", "ts_ms", "nearest_support", "nearest_resistance")


_PARTS = ("wn06_last_swings", "wn07_last_label", "wn08_last_leg", "wn09_last_retracement", "jn04_nearest_levels")


@register("src04_bar_features", "SELECT * FROM " + " JOIN ".join(f"({ORACLE[n]}) AS p{i}" + (" USING (symbol, ts_ms)" if i else "") for i, n in enumerate(_PARTS)))
def _(spark, d):
    """The feature matrix written by series and scanned again; the SQL joins what its parts' queries say."""
    from tidebar.scratch import scratch_path

    b, _ = _prep(spark, d)
    path = scratch_path(spark, "features")
    st.bar_features(b, keys=_K).write.partitionBy("symbol").parquet(path)
    exact = {"last_sh_price", "last_sl_price", "nearest_support", "nearest_resistance"}
    scanned = spark.read.parquet(path).where("symbol IS NOT NULL AND ts_ms > 0")
    dropped = ["close", "dist_support_pct", "dist_resistance_pct", *[f"dist_{fib_column(r)}_pct" for r in RETRACEMENTS if r != 0.618]]
    out = scanned.drop(*dropped)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in out.dtypes])


@register("src04_indicator_update", ORACLE["src04_bar_features"])
def _(spark, d):
    """The indicator store filled with the first half of the bars and carried on with the rest; its features scanned by key and time."""
    from tidebar.operators.indicators import IndicatorStore
    from tidebar.scratch import scratch_path, written

    b = written(_prep(spark, d)[0], "bars")
    store = IndicatorStore(spark, scratch_path(spark, "indicators"), _K)
    store.replace(b.where(F.col("ts_ms") < 1_705_276_800_000))
    store.update(b)
    exact = {"last_sh_price", "last_sl_price", "nearest_support", "nearest_resistance"}
    out = store.scan("bar_features", 0, 1 << 41).drop("close", "dist_support_pct", "dist_resistance_pct", *[f"dist_{fib_column(r)}_pct" for r in RETRACEMENTS if r != 0.618])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in out.dtypes])


_SIX = "symbol < 'm' AND seq % 2 = 0 AND ts_ms < 1705276800000 OR symbol >= 'm'"


@register("snk04_indicator_tables", f"""WITH {_LG.replace(bars_sql(), bars_sql('1h', 'bars', _SIX))}, t AS (SELECT symbol, 'swings' AS name, count(*) AS n, min(confirm_ts_ms) AS from_ms, max(confirm_ts_ms) AS to_ms FROM swings GROUP BY symbol UNION ALL SELECT symbol, 'structure_events', count(*), min(confirm_ts_ms), max(confirm_ts_ms) FROM events_ GROUP BY symbol
 UNION ALL SELECT symbol, 'levels', count(*), min(confirm_ts_ms), max(confirm_ts_ms) FROM swings GROUP BY symbol UNION ALL SELECT symbol, 'legs', count(*), min(known_ts_ms), max(known_ts_ms) FROM legs GROUP BY symbol
 UNION ALL SELECT symbol, 'bar_features', count(*), min(ts_ms), max(ts_ms) FROM bars GROUP BY symbol UNION ALL SELECT symbol, 'series', 1, min(ts_ms), min(ts_ms) FROM bars GROUP BY symbol) SELECT * FROM t""")
def _(spark, d):
    """Six tables of all series, then replaced for some of them by a run over half the time and every other event: what each table holds."""
    from tidebar.operators.indicators import IndicatorStore
    from tidebar.plans.views import tick_bars, ticks
    from tidebar.scratch import scratch_path

    t = ticks(spark, d)
    store = IndicatorStore(spark, scratch_path(spark, "indicators"), _K)
    store.replace(tick_bars(t, "1h"))
    store.replace(tick_bars(t.where("symbol < 'm' AND seq % 2 = 0 AND ts_ms < 1705276800000"), "1h"))
    out = None
    for name, table in store.tables.items():
        part = table.read().groupBy("symbol").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.min(table.time).alias("from_ms"), F.max(table.time).alias("to_ms"))
        out = part if out is None else out.unionByName(part)
    return out
