"""Outcome queries: every seventh tick is a signal on hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import outcomes as oc
from tidebar.plans.registry import register
from tidebar.plans.views import bars, bars_sql, more_bars, ticks

H = 3_600_000
HOLD = 12

_SIG = f"""{bars_sql()}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_ms) - 1 AS i FROM bars),
 sig AS (SELECT seq AS signal_id, symbol, (ts_ms // {H}) * {H} + CASE WHEN seq % 5 = 0 THEN {H} ELSE 0 END AS ts_ms, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS side FROM ticks),
 s0 AS (SELECT sig.*, b.i + 1 AS entry_i, b.i IS NULL AS nobar FROM sig LEFT JOIN b ON b.symbol = sig.symbol AND b.ts_ms = sig.ts_ms),
 sched AS (SELECT s0.*, e.ts_ms AS entry_ts_ms, e.open AS entry_open, CASE WHEN nobar THEN 'no_bar' WHEN e.ts_ms IS NULL THEN 'past_end' END AS skip FROM s0 LEFT JOIN b e ON e.symbol = s0.symbol AND e.i = s0.entry_i)"""


def _signals(spark, d):
    k = F.col("seq")
    ts = (F.floor(F.col("ts_ms") / H) * H + F.when(k % 5 == 0, H).otherwise(0)).cast("long")
    return ticks(spark, d).select(k.alias("signal_id"), "symbol", ts.alias("ts_ms"), F.when(k % 2 == 0, 1).otherwise(-1).alias("side"))


@register("jn05_schedule", f"WITH {_SIG} SELECT signal_id, CASE WHEN nobar THEN NULL ELSE entry_i END AS entry_i, entry_ts_ms, entry_open, skip FROM sched")
def _(spark, d):
    return oc.schedule(_signals(spark, d), bars(spark, d), ["symbol"]).select("signal_id", "entry_i", "entry_ts_ms", "entry_open", "skip")


def _entries(spark, d):
    b = bars(spark, d)
    s = oc.schedule(_signals(spark, d), b, ["symbol"]).where("skip IS NULL")
    c = F.col
    return s.select("signal_id", "symbol", "side", "entry_i", "entry_ts_ms", "entry_open", (c("entry_open") - c("side") * 15).alias("stop"), (c("entry_open") + c("side") * 25).alias("target")), b


_BAR = f"""{_SIG}, en AS (SELECT signal_id, symbol, side, entry_i, entry_open, entry_open - side * 15 AS stop, entry_open + side * 25 AS target FROM sched WHERE skip IS NULL),
 j AS (SELECT en.*, b.i, b.ts_ms, b.open, CASE WHEN side > 0 THEN low ELSE high END AS bad, CASE WHEN side > 0 THEN high ELSE low END AS good FROM en JOIN b ON b.symbol = en.symbol AND b.i BETWEEN entry_i AND entry_i + {HOLD}),
 r AS (SELECT *, side * open <= side * stop AS so, side * open >= side * target AS t_o, side * bad <= side * stop AS sb, side * good >= side * target AS tb FROM j),
 x AS (SELECT *, sb AND tb AND NOT so AND NOT t_o AS amb, CASE WHEN so THEN 'stop' WHEN t_o THEN 'target' WHEN sb THEN 'stop' WHEN tb THEN 'target' WHEN i = entry_i + {HOLD} THEN 'max_hold' END AS reason FROM r),
 f AS (SELECT signal_id, symbol, side, stop, target, i AS exit_i, ts_ms AS exit_ts_ms, reason, CASE WHEN so THEN open WHEN reason = 'stop' THEN stop WHEN reason = 'target' THEN target ELSE open END AS exit_price, amb AS ambiguous FROM x WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY i) = 1),
 m AS (SELECT x.signal_id, least(min(x.side * (bad - entry_open)), 0) AS mae, greatest(max(x.side * (good - entry_open)), 0) AS mfe FROM x LEFT JOIN f ON f.signal_id = x.signal_id WHERE f.exit_i IS NULL OR x.i <= f.exit_i GROUP BY x.signal_id)"""


@register("jn11_wn20_wn22_first_barrier", f"WITH {_BAR} SELECT en.signal_id, f.exit_ts_ms, coalesce(f.reason, 'open') AS reason, round(f.exit_price, 6) AS exit_price, coalesce(f.ambiguous, false) AS ambiguous, round(mae, 6) AS mae, round(mfe, 6) AS mfe, f.exit_i - en.entry_i AS hold_bars FROM en LEFT JOIN f ON f.signal_id = en.signal_id LEFT JOIN m ON m.signal_id = en.signal_id")
def _(spark, d):
    e, b = _entries(spark, d)
    out = oc.first_barrier(e, b, ["symbol"], HOLD)
    return out.select("signal_id", "exit_ts_ms", "reason", F.round("exit_price", 6).alias("exit_price"), "ambiguous", F.round("mae", 6).alias("mae"), F.round("mfe", 6).alias("mfe"), "hold_bars")


@register("jn12_replay_ambiguous", f"""WITH {_BAR}, {more_bars('c', '15m')}, k AS (SELECT f.signal_id, count(DISTINCT c.ts_ms) AS n, min(c.ts_ms) FILTER (WHERE f.side * CASE WHEN f.side > 0 THEN c.low ELSE c.high END <= f.side * f.stop) AS s, min(c.ts_ms) FILTER (WHERE f.side * CASE WHEN f.side > 0 THEN c.high ELSE c.low END >= f.side * f.target) AS t
  FROM f JOIN c ON c.symbol = f.symbol AND (c.ts_ms // {H}) * {H} = f.exit_ts_ms WHERE f.ambiguous GROUP BY f.signal_id),
 z AS (SELECT signal_id, CASE WHEN t IS NULL OR s < t THEN 'stop' ELSE 'target' END AS r FROM k WHERE n = 4 AND (s IS NOT NULL OR t IS NOT NULL) AND (s IS NULL OR t IS NULL OR s <> t))
SELECT en.signal_id, coalesce(z.r, f.reason, 'open') AS reason, coalesce(f.ambiguous, false) AND z.r IS NULL AS ambiguous FROM en LEFT JOIN f ON f.signal_id = en.signal_id LEFT JOIN z ON z.signal_id = en.signal_id""")
def _(spark, d):
    e, b = _entries(spark, d)
    out = oc.replay_ambiguous(oc.first_barrier(e, b, ["symbol"], HOLD), bars(spark, d, "15m"), ["symbol"], H, 900_000)
    return out.select("signal_id", "reason", "ambiguous")


_HOLD = f"h AS (SELECT seq AS trade_id, symbol, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS side, 2.0::DOUBLE AS qty, price AS entry_price, ts_ms AS entry_ts_ms, ts_ms + (seq % 40) * {H} AS exit_ts_ms, round((seq % 11 - 5) * 1.5::DOUBLE, 1) AS pnl FROM ticks)"


def _holdings(spark, d):
    k = F.col("seq")
    return ticks(spark, d).select(k.alias("trade_id"), "symbol", F.when(k % 2 == 0, 1).otherwise(-1).alias("side"), F.lit(2.0).alias("qty"), F.col("price").alias("entry_price"), F.col("ts_ms").alias("entry_ts_ms"), (F.col("ts_ms") + (k % 40) * H).alias("exit_ts_ms"), F.round((k % 11 - 5) * 1.5, 1).alias("pnl"))


_SET = f"st AS (SELECT symbol, ts_ms + 600000 * (ts_ms // {H} % 2) AS settle_ms, 0.0001::DOUBLE * (ts_ms // {H} % 7) AS rate FROM bars WHERE ts_ms % {8 * H} = 0)"


@register("jn06_jn07_jn08_funding", f"""WITH {bars_sql()}, {_HOLD}, {_SET}, mk AS (SELECT st.*, b.ts_ms = st.settle_ms AS exact, CASE WHEN b.ts_ms = st.settle_ms THEN b.open ELSE b.close END AS mark FROM st ASOF LEFT JOIN bars b ON b.symbol = st.symbol AND st.settle_ms >= b.ts_ms)
SELECT trade_id, count(*) AS charges, count(*) FILTER (WHERE exact) AS exact, round(sum(-side * qty * mark * rate), 6) AS funding FROM h JOIN mk ON mk.symbol = h.symbol AND settle_ms >= entry_ts_ms AND settle_ms < exit_ts_ms GROUP BY trade_id""")
def _(spark, d):
    b = bars(spark, d)
    st = b.where(f"ts_ms % {8 * H} = 0").select("symbol", (F.col("ts_ms") + 600_000 * (F.floor(F.col("ts_ms") / H) % 2)).alias("ts_ms"), (0.0001 * (F.floor(F.col("ts_ms") / H) % 7)).alias("rate"))
    out = oc.funding(_holdings(spark, d), st, b, 40 * H)
    return out.groupBy("trade_id").agg(F.count("*").alias("charges"), F.count_if("exact").alias("exact"), F.round(F.sum("charge"), 6).alias("funding"))


@register("jn27_mark_equity", f"""WITH {bars_sql()}, {_HOLD}, r AS (SELECT symbol, exit_ts_ms, sum(p) OVER (PARTITION BY symbol ORDER BY exit_ts_ms ROWS UNBOUNDED PRECEDING) AS realised FROM (SELECT symbol, exit_ts_ms, sum(pnl) AS p FROM h GROUP BY ALL)),
 u AS (SELECT b.symbol, b.ts_ms, sum(side * (close - entry_price) * qty) AS unrealised FROM bars b JOIN h ON h.symbol = b.symbol AND b.ts_ms >= entry_ts_ms AND b.ts_ms < exit_ts_ms GROUP BY ALL)
SELECT b.symbol, b.ts_ms, round(coalesce(r.realised, 0), 4) AS realised, round(coalesce(u.unrealised, 0), 4) AS unrealised FROM bars b ASOF LEFT JOIN r ON r.symbol = b.symbol AND b.ts_ms >= r.exit_ts_ms LEFT JOIN u ON u.symbol = b.symbol AND u.ts_ms = b.ts_ms""")
def _(spark, d):
    out = oc.mark_equity(_holdings(spark, d), bars(spark, d), 40 * H, block_ms=7 * 24 * H)
    return out.select("symbol", "ts_ms", F.round("realised", 4).alias("realised"), F.round("unrealised", 4).alias("unrealised"))
