"""Trade analytics queries over the closed trades that line items and orders stand for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.functions import scalar as S
from tidebar.operators import series, trades as tr
from tidebar.plans.registry import register
from tidebar.plans.views import TRADES, bars, bars_sql, read, trades
from tidebar.scratch import written

A, ORDER, O = ["account"], ["exit_ts_ms", "trade_id"], "exit_ts_ms, trade_id"
_EQ = f"{TRADES}, eq AS (SELECT *, round(sum(pnl) OVER (PARTITION BY account ORDER BY {O} ROWS UNBOUNDED PRECEDING), 4) AS equity FROM trades)"


def _r(df, digits=4, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])

#: Time of a block of running values: two years.
BLOCK = 730 * 86_400_000


def eq(spark, d):
    return tr.equity_curve(trades(spark, d), A, ORDER, block_ms=BLOCK).withColumn("equity", F.round("equity", 4))


@register("wn15_equity_curve", f"WITH {_EQ} SELECT account, trade_id, exit_ts_ms, round(equity, 4) AS equity FROM eq")
def _(spark, d):
    return eq(spark, d).select("account", "trade_id", "exit_ts_ms", F.round("equity", 4).alias("equity"))


@register("wn15_equity_by_symbol", f"WITH {TRADES} SELECT account, symbol, trade_id, round(sum(pnl) OVER (PARTITION BY account, symbol ORDER BY {O} ROWS UNBOUNDED PRECEDING), 4) AS equity FROM trades")
def _(spark, d):
    return tr.equity_curve(trades(spark, d), ["account", "symbol"], ORDER, block_ms=BLOCK).select("account", "symbol", "trade_id", F.round("equity", 4).alias("equity"))


_DD = f"""{_EQ}, p AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY {O} ROWS UNBOUNDED PRECEDING) AS peak, row_number() OVER (PARTITION BY account ORDER BY {O}) AS i FROM eq),
 q AS (SELECT *, peak - equity AS dr, CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END AS fr FROM p),
 ra AS (SELECT account, i - row_number() OVER (PARTITION BY account ORDER BY i) AS g FROM q WHERE equity < peak - 1e-12), la AS (SELECT account, max(n) AS duration FROM (SELECT account, g, count(*) AS n FROM ra GROUP BY ALL) GROUP BY account),
 rr AS (SELECT account, i - row_number() OVER (PARTITION BY account ORDER BY i) AS g FROM q WHERE fr > 1e-12), lr AS (SELECT account, avg(n) AS avg_length FROM (SELECT account, g, count(*) AS n FROM rr GROUP BY ALL) GROUP BY account)"""


@register("wn11_wn12_drawdown", f"WITH {_DD} SELECT q.account, round(max(dr), 4) AS magnitude, round(max(fr), 4) AS fraction, round(coalesce(avg(fr) FILTER (WHERE fr > 1e-12), 0), 4) AS avg_fraction, coalesce(max(duration), 0) AS duration, round(coalesce(max(avg_length), 0), 4) AS avg_length FROM q LEFT JOIN la ON q.account = la.account LEFT JOIN lr ON q.account = lr.account GROUP BY q.account")
def _(spark, d):
    return _r(tr.drawdown(eq(spark, d), A, ORDER, block_ms=BLOCK))


_STREAK = f"{TRADES}, s AS (SELECT account, sign(pnl) AS s, row_number() OVER (PARTITION BY account ORDER BY {O}) - row_number() OVER (PARTITION BY account, sign(pnl) ORDER BY {O}) AS g FROM trades), n AS (SELECT account, s, g, count(*) AS n FROM s GROUP BY ALL)"


@register("wn13_streaks", f"WITH {_STREAK} SELECT account, coalesce(max(n) FILTER (WHERE s = 1), 0) AS wins, coalesce(max(n) FILTER (WHERE s = -1), 0) AS losses FROM n GROUP BY account")
def _(spark, d):
    return tr.streaks(trades(spark, d), A, ORDER, block_ms=BLOCK)


_START = 100_000.0
_RET = f"""{_EQ}, de AS (SELECT account, (exit_ts_ms // 86400000) * 86400000 AS day_ms, last(equity ORDER BY {O}) + {_START} AS equity FROM eq GROUP BY ALL),
 r0 AS (SELECT account, day_ms, equity / nullif(lag(equity) OVER (PARTITION BY account ORDER BY day_ms), 0) - 1 AS r FROM de), r AS (SELECT * FROM r0 WHERE r IS NOT NULL AND isfinite(r))"""


def _daily(spark, d):
    return tr.daily_equity(eq(spark, d), A, ORDER).withColumn("equity", F.col("equity") + _START)


@register("ag08_daily_equity", f"WITH {_RET} SELECT account, day_ms, round(equity, 4) AS equity FROM de")
def _(spark, d):
    return _r(_daily(spark, d), 4)


@register("wn14_daily_returns", f"WITH {_RET} SELECT account, day_ms, round(r, 6) AS r FROM r")
def _(spark, d):
    return _r(tr.daily_returns(_daily(spark, d), A), 6)


@register("ag12_ag14_ag15_sharpe", f"""WITH {_RET}, a AS (SELECT account, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(r * r) FILTER (WHERE r < 0)) AS dn FROM r GROUP BY account)
SELECT account, n, round(CASE WHEN n >= 2 AND s > 0 THEN m / s END, 6) AS sharpe, round(CASE WHEN n >= 2 AND s > 0 THEN m / s * sqrt(365.0::DOUBLE) END, 6) AS sharpe_annual,
 round(CASE WHEN dn > 0 THEN m / dn * sqrt(365.0::DOUBLE) WHEN m > 0 THEN 'inf'::DOUBLE END, 6) AS sortino, round(CASE WHEN n >= 2 THEN s * sqrt(365.0::DOUBLE) END, 6) AS volatility FROM a""")
def _(spark, d):
    return _r(tr.sharpe(tr.daily_returns(_daily(spark, d), A), A), 6)


_LAGS = "\n UNION ALL ".join(f"SELECT account, {k} AS k, x * lag(x, {k}) OVER (PARTITION BY account ORDER BY day_ms) AS c FROM x" for k in range(1, 13))


@register("ag13_hac_sharpe", f"""WITH {_RET}, x AS (SELECT account, day_ms, r, r - avg(r) OVER (PARTITION BY account) AS x, count(*) OVER (PARTITION BY account) AS n FROM r),
 b AS (SELECT account, max(n) AS n, greatest(1, floor(4 * pow(max(n) / 100.0, 2.0 / 9.0)))::BIGINT AS lag_, avg(r) AS m, sum(x * x) AS g0 FROM x GROUP BY account), c AS ({_LAGS}),
 g AS (SELECT c.account, sum(2 * (1 - k / (lag_ + 1.0::DOUBLE)) * c) AS g FROM c JOIN b ON b.account = c.account WHERE k <= lag_ GROUP BY c.account),
 v AS (SELECT b.*, (g0 + coalesce(g, 0)) / n AS v FROM b LEFT JOIN g ON b.account = g.account)
SELECT account, n, lag_ AS lag, round(CASE WHEN n >= 2 AND v > 0 THEN m / sqrt(v) END, 6) AS sharpe_hac, round(CASE WHEN n >= 2 AND v > 0 THEN m / sqrt(v) * sqrt(365.0::DOUBLE) END, 6) AS sharpe_hac_annual FROM v""")
def _(spark, d):
    return _r(tr.hac_sharpe(tr.daily_returns(_daily(spark, d), A), A), 6)


_W = "(wins / n::DOUBLE)"


@register("ag10_ag11_ag16_ag19_distribution", f"""WITH {TRADES}, a AS (SELECT account, symbol, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses, avg(pnl) AS mean, stddev_samp(pnl) AS s,
  avg(pnl) FILTER (WHERE pnl > 0) AS mean_win, avg(pnl) FILTER (WHERE pnl < 0) AS mean_loss, median(pnl) FILTER (WHERE pnl > 0) AS median_win, median(pnl) FILTER (WHERE pnl < 0) AS median_loss, max(pnl) AS best, min(pnl) AS worst,
  coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gain, coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS loss FROM trades GROUP BY ALL),
 b AS (SELECT *, {_W} AS wr, CASE WHEN abs(mean_loss) > 1e-12 THEN mean_win / abs(mean_loss) END AS payoff FROM a)
SELECT account, symbol, n, wins, losses, round(mean, 4) AS mean, round(mean_win, 4) AS mean_win, round(mean_loss, 4) AS mean_loss, round(median_win, 5) AS median_win, round(median_loss, 5) AS median_loss, best, worst,
 round(CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 'inf'::DOUBLE END, 4) AS profit_factor, round(wr, 4) AS win_rate, round(payoff, 4) AS payoff,
 round(greatest(0.0, (wr + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(wr * (1 - wr) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 4) AS wilson_lo,
 round(least(1.0, (wr + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(wr * (1 - wr) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)), 4) AS wilson_hi,
 round(CASE WHEN n >= 2 AND s > 0 THEN sqrt(n) * mean / s END, 4) AS sqn, round(CASE WHEN payoff > 0 THEN wr - (1 - wr) / payoff END, 4) AS kelly FROM b""")
def _(spark, d):
    out = tr.distribution(trades(spark, d), ["account", "symbol"])
    medians = {c: F.round(c, 5) for c in ("median_win", "median_loss")}
    return _r(out.withColumns(medians), 4, ("best", "worst", *medians))


@register("ag17_cvar", f"WITH {TRADES}, x AS (SELECT account, pnl, row_number() OVER (PARTITION BY account ORDER BY pnl, trade_id) AS i, greatest(1, ceil(0.05 * count(*) OVER (PARTITION BY account))) AS k FROM trades) SELECT account, round(avg(pnl), 4) AS cvar, count(*) AS tail FROM x WHERE i <= k GROUP BY account")
def _(spark, d):
    return _r(tr.cvar(trades(spark, d), A))


@register("ag18_holding", f"""WITH {TRADES} SELECT account, round(avg((exit_ts_ms - entry_ts_ms) / 3600000.0::DOUBLE), 4) AS hours_avg, round(min((exit_ts_ms - entry_ts_ms) / 3600000.0::DOUBLE), 4) AS hours_min, round(max((exit_ts_ms - entry_ts_ms) / 3600000.0::DOUBLE), 4) AS hours_max,
 count(*) FILTER (WHERE side > 0) AS n_long, round(coalesce(sum(pnl) FILTER (WHERE side > 0), 0), 4) AS pnl_long, round(avg((pnl > 0)::INT) FILTER (WHERE side > 0), 4) AS win_rate_long,
 count(*) FILTER (WHERE side < 0) AS n_short, round(coalesce(sum(pnl) FILTER (WHERE side < 0), 0), 4) AS pnl_short, round(avg((pnl > 0)::INT) FILTER (WHERE side < 0), 4) AS win_rate_short FROM trades GROUP BY account""")
def _(spark, d):
    return _r(tr.holding(trades(spark, d), A))


@register("ag20_exit_reasons", f"WITH {TRADES} SELECT reason, count(*) AS n, round(sum(pnl), 4) AS pnl FROM trades GROUP BY reason")
def _(spark, d):
    return _r(trades(spark, d).groupBy("reason").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl")), 4)


#: Reasons of exits and their buckets, as the operator's rule states them one by one.
_REASONS = [
    ("target", "tp"), ("target_entry_bar", "tp"), ("target_2", "tp"), ("TP1", "tp"), ("stop", "sl"), ("stop_entry_bar", "sl"), ("trailing_stop", "sl"), ("break_even_stop", "sl"), ("emergency_stop", "sl"),
    ("liquidation", "other"), ("liquidation_entry_bar", "other"), ("max_hold", "other"), ("end_of_data", "other"), ("signal_exit", "other"), ("", "other"), (None, "other"),
]
_TOLD = ", ".join(f"({i}, {'NULL' if r is None else repr(r)}, '{b}')" for i, (r, b) in enumerate(_REASONS))


@register("pf17_exit_buckets", f"WITH {TRADES}, r(i, reason, bucket) AS (VALUES {_TOLD}) SELECT r.reason, r.bucket, count(*) AS n, round(sum(pnl), 4) AS pnl FROM trades JOIN r ON r.i = trade_id % {len(_REASONS)} GROUP BY ALL")
def _(spark, d):
    told = F.element_at(F.array(*map(F.lit, (r for r, _ in _REASONS))), (F.col("trade_id") % len(_REASONS) + 1).cast("int"))
    t = trades(spark, d).select(told.alias("reason"), "pnl")
    return _r(t.groupBy("reason", S.exit_bucket(F.col("reason")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl")), 4)


_CONC = f"""{TRADES}, e0 AS (SELECT account, entry_ts_ms AS ts, 1 AS delta, (side > 0)::INT AS l FROM trades UNION ALL SELECT account, CASE WHEN exit_ts_ms <= entry_ts_ms THEN entry_ts_ms + 1 ELSE exit_ts_ms END, -1, (side > 0)::INT FROM trades),
 e AS (SELECT account, ts, delta, sum(delta) AS d, sum(delta * l) AS dl FROM e0 GROUP BY ALL),
 c AS (SELECT account, ts, sum(d) OVER w AS c, sum(dl) OVER w AS l, lead(ts) OVER (PARTITION BY account ORDER BY ts, delta) - ts AS dt FROM e WINDOW w AS (PARTITION BY account ORDER BY ts, delta ROWS UNBOUNDED PRECEDING))"""


@register("ag21_concurrency", f"""WITH {_CONC} SELECT account, max(c)::BIGINT AS max_total, round(sum(c * dt) / (max(ts) - min(ts))::DOUBLE, 4) AS avg_total, max(l)::BIGINT AS max_long, round(sum(l * dt) / (max(ts) - min(ts))::DOUBLE, 4) AS avg_long,
 max(c - l)::BIGINT AS max_short, round(sum((c - l) * dt) / (max(ts) - min(ts))::DOUBLE, 4) AS avg_short FROM c GROUP BY account""")
def _(spark, d):
    return _r(tr.concurrency(trades(spark, d), A))


_CM = f"""{TRADES}, c0 AS (SELECT *, sum(pnl) OVER (PARTITION BY account, symbol ORDER BY {O} ROWS UNBOUNDED PRECEDING) AS eq FROM trades),
 c1 AS (SELECT *, max(eq) OVER (PARTITION BY account, symbol ORDER BY {O} ROWS UNBOUNDED PRECEDING) AS pk FROM c0),
 m AS (SELECT account, symbol, count(*) AS n_trades, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses, sum(pnl) AS realized_pnl, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gross_profit,
  coalesce(abs(sum(pnl) FILTER (WHERE pnl < 0)), 0) AS gross_loss, avg(pnl) AS avg_pnl, avg(pnl) FILTER (WHERE pnl > 0) AS avg_win, avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss, stddev_samp(pnl) AS s, min(eq - pk) AS max_drawdown,
  first(pk ORDER BY eq - pk, exit_ts_ms, trade_id) AS at_ FROM c1 GROUP BY ALL)"""
_PF = "CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss WHEN gross_profit > 0 THEN 'inf'::DOUBLE END"


@register("ag23_closed_metrics", f"""WITH {_CM} SELECT account, symbol, n_trades, wins, losses, round(realized_pnl, 4) AS realized_pnl, round(gross_profit, 4) AS gross_profit, round(gross_loss, 4) AS gross_loss, round({_PF}, 4) AS profit_factor, round(avg_pnl, 4) AS avg_pnl,
 round(avg_win, 4) AS avg_win, round(avg_loss, 4) AS avg_loss, round(max_drawdown, 4) AS max_drawdown, round(wins / n_trades::DOUBLE, 4) AS winrate, round(CASE WHEN abs(avg_loss) > 1e-12 THEN avg_win / abs(avg_loss) END, 4) AS payoff,
 round(CASE WHEN s > 1e-12 THEN avg_pnl / s END, 4) AS sharpe, round(CASE WHEN abs(max_drawdown) > 1e-6 THEN realized_pnl / abs(max_drawdown) WHEN realized_pnl > 0 THEN 'inf'::DOUBLE END, 4) AS recovery_factor FROM m""")
def _(spark, d):
    return _r(tr.closed_metrics(trades(spark, d), ["account", "symbol"], ORDER).drop("max_dd_pct"), 4)


@register("ag24_account_symbol_pnl", f"""WITH {TRADES}, u AS (SELECT DISTINCT account, s.symbol FROM trades, (SELECT DISTINCT symbol FROM trades UNION SELECT 'Z') s), g AS (SELECT account, symbol, count(*) AS n, sum(pnl) AS pnl FROM trades GROUP BY ALL),
 j AS (SELECT u.account, u.symbol, coalesce(n, 0) AS n, coalesce(pnl, 0) AS pnl FROM u LEFT JOIN g ON u.account = g.account AND u.symbol = g.symbol)
SELECT account, symbol, sum(n)::BIGINT AS n_trades, round(sum(pnl), 4) AS pnl FROM j GROUP BY GROUPING SETS ((account, symbol), (account))""")
def _(spark, d):
    t = trades(spark, d)
    u = t.select("account", F.explode(F.array(*map(F.lit, ["A", "N", "R", "Z"]))).alias("symbol")).distinct()
    return _r(tr.by_account_and_symbol(t, u), 4)


@register("ag25_fleet_totals", f"WITH {TRADES} SELECT symbol, count(DISTINCT account) AS accounts, count(*) AS n_trades, round(sum(pnl), 4) AS pnl FROM trades GROUP BY ROLLUP (symbol)")
def _(spark, d):
    return _r(trades(spark, d).rollup("symbol").agg(F.count_distinct("account").alias("accounts"), F.count("*").alias("n_trades"), F.sum("pnl").alias("pnl")), 4)


@register("srt03_ag27_leaderboard", f"""WITH {_CM}, f AS (SELECT account, symbol, n_trades, realized_pnl, {_PF} AS pf FROM m), k AS (SELECT *, CASE WHEN pf IS NULL THEN 3 WHEN isinf(pf) THEN CASE WHEN n_trades >= 5 THEN 0 ELSE 2 END ELSE 1 END AS tier FROM f)
SELECT account, symbol, n_trades, round(realized_pnl, 4) AS realized_pnl, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN -round(pf, 6) ELSE 0 END, n_trades DESC, round(realized_pnl, 4) DESC, account, symbol) AS place FROM k""")
def _(spark, d):
    m = tr.closed_metrics(trades(spark, d), ["account", "symbol"], ORDER)
    m = m.withColumn("profit_factor", F.round("profit_factor", 6)).withColumn("realized_pnl", F.round("realized_pnl", 4))
    return tr.ranked(m, ["account", "symbol"]).select("account", "symbol", "n_trades", "realized_pnl", "place")


@register("ag28_median_levels", f"WITH {TRADES} SELECT symbol, round(median(abs(pnl / (qty * entry_price))) FILTER (WHERE pnl < 0), 6) AS sl_pct, round(median(abs(pnl / (qty * entry_price))) FILTER (WHERE pnl > 0), 6) AS tp_pct FROM trades GROUP BY symbol")
def _(spark, d):
    share = F.abs(F.col("pnl") / (F.col("qty") * F.col("entry_price")))
    return _r(trades(spark, d).groupBy("symbol").agg(F.median(F.when(F.col("pnl") < 0, share)).alias("sl_pct"), F.median(F.when(F.col("pnl") > 0, share)).alias("tp_pct")), 6)


@register("ag29_constant_levels", f"WITH {TRADES} SELECT account, count(DISTINCT (symbol, side)) = 1 AS constant, count(DISTINCT (symbol, side)) AS signatures FROM trades GROUP BY account")
def _(spark, d):
    n = F.count_distinct(F.struct("symbol", "side"))
    return trades(spark, d).groupBy("account").agg((n == 1).alias("constant"), n.alias("signatures"))


_H = "list_aggregate(list_transform(list_sort(list({'i': i, 'h': h})), lambda x: x.h), 'string_agg', '')"


@register("ag30_fingerprint", f"""WITH {TRADES}, r AS (SELECT account, row_number() OVER (PARTITION BY account ORDER BY {O}) - 1 AS i, sha256(trade_id::VARCHAR || '|' || symbol || '|' || side::VARCHAR || '|' || exit_ts_ms::VARCHAR || '|' || CAST(round(pnl * 10000) AS BIGINT)::VARCHAR) AS h FROM trades),
 b AS (SELECT account, i // 256 AS i, sha256({_H}) AS h, count(*) AS n FROM r GROUP BY account, i // 256) SELECT account, sum(n)::BIGINT AS rows, sha256({_H}) AS fingerprint FROM b GROUP BY account""")
def _(spark, d):
    t = trades(spark, d).withColumn("cents", F.round(F.col("pnl") * 10000).cast("long"))
    return tr.fingerprint(t, A, ORDER, ["trade_id", "symbol", "side", "exit_ts_ms", "cents"], 256)


@register("ag31_ruin", f"WITH {_EQ} SELECT account, coalesce(bool_or(equity + 5000 <= 0), false) AS ruined, min(exit_ts_ms) FILTER (WHERE equity + 5000 <= 0) AS ruin_ts_ms FROM eq GROUP BY account")
def _(spark, d):
    bad = F.col("equity") + 5000 <= 0
    return eq(spark, d).groupBy("account").agg(F.bool_or(bad).alias("ruined"), F.min(F.when(bad, F.col("exit_ts_ms"))).alias("ruin_ts_ms"))


@register("ag22_run_quality", f"""WITH {TRADES} SELECT account, round(avg((exit_ts_ms = entry_ts_ms)::INT), 4) AS entry_bar_exit_rate, round(avg((trade_id % 9 = 0)::INT), 4) AS ambiguous_rate,
 CASE WHEN avg((exit_ts_ms = entry_ts_ms)::INT) > 0.25 THEN 'entry_bar_exits' ELSE '' END || CASE WHEN avg((trade_id % 9 = 0)::INT) > 0.1 THEN 'ambiguous_bars' ELSE '' END AS warnings FROM trades GROUP BY account""")
def _(spark, d):
    a, b = F.avg((F.col("exit_ts_ms") == F.col("entry_ts_ms")).cast("int")), F.avg((F.col("trade_id") % 9 == 0).cast("int"))
    return _r(trades(spark, d).groupBy("account").agg(a.alias("entry_bar_exit_rate"), b.alias("ambiguous_rate"), F.concat_ws("", F.when(a > 0.25, "entry_bar_exits"), F.when(b > 0.1, "ambiguous_bars")).alias("warnings")))


@register("wn19_round_trips", f"""WITH RECURSIVE {TRADES}, o AS (SELECT account, symbol, side, entry_price, qty, pnl, trade_id, exit_ts_ms, row_number() OVER (PARTITION BY account, symbol, side, entry_price ORDER BY {O}) AS i FROM trades),
 f AS (SELECT o.*, exit_ts_ms AS first_ts FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN o.exit_ts_ms - f.first_ts > 604800000 THEN o.exit_ts_ms ELSE f.first_ts END FROM o JOIN f ON o.account = f.account AND o.symbol = f.symbol AND o.side = f.side AND o.entry_price = f.entry_price AND o.i = f.i + 1)
SELECT account, symbol, side, entry_price, sum(qty) AS qty, round(sum(pnl), 4) AS pnl, count(*) AS leg_count, first_ts AS first_ts_ms, max(exit_ts_ms) AS last_ts_ms, first(trade_id ORDER BY {O}) AS first_trade_id FROM f GROUP BY account, symbol, side, entry_price, first_ts""")
def _(spark, d):
    return tr.round_trips(trades(spark, d), ["account", "symbol"]).withColumn("pnl", F.round("pnl", 4))


@register("pf08_pf09_since", f"""WITH {TRADES}, fl AS (SELECT DISTINCT account, 852076800000 + account * 86400000 AS a FROM trades), fs AS (SELECT DISTINCT account, symbol, 867715200000 AS s FROM trades WHERE symbol = 'R')
SELECT t.account, t.symbol, count(*) AS n, round(sum(pnl), 4) AS pnl, min(exit_ts_ms) AS earliest_ms FROM trades t JOIN fl ON fl.account = t.account LEFT JOIN fs ON fs.account = t.account AND fs.symbol = t.symbol WHERE exit_ts_ms >= greatest(a, coalesce(s, a)) GROUP BY ALL""")
def _(spark, d):
    t = trades(spark, d)
    lines = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("account"), F.col("l_returnflag").alias("symbol"))  # dates need no trades
    fl = lines.select("account").distinct().select("account", F.lit(None).cast("string").alias("symbol"), (852_076_800_000 + F.col("account") * 86_400_000).alias("since_ms"))
    fs = lines.where("symbol = 'R'").distinct().withColumn("since_ms", F.lit(867_715_200_000))
    return _r(tr.since_filter(t, written(fl.unionByName(fs), "floors")).groupBy("account", "symbol").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.min("exit_ts_ms").alias("earliest_ms")), 4)


@register("pf10_live_symbols", f"WITH {TRADES} SELECT trade_id FROM trades WHERE symbol IN (SELECT symbol FROM trades GROUP BY symbol HAVING sum(pnl) <= 0 OR symbol <> 'N')")
def _(spark, d):
    t = trades(spark, d)
    live = t.groupBy("symbol").agg(F.sum("pnl").alias("s")).where("s <= 0 OR symbol <> 'N'")
    return t.join(live, "symbol", "left_semi").select("trade_id")


@register("pf12_normalised_trades", f"WITH {TRADES} SELECT trade_id, account, symbol, side, CASE WHEN side > 0 THEN 'Buy' ELSE 'Sell' END AS side_name, entry_price * (1 + side * pnl / (qty * entry_price)) AS exit_price, (exit_ts_ms - entry_ts_ms) // 60000 AS minutes FROM trades")
def _(spark, d):
    exit_price = F.col("entry_price") * (1 + F.col("side") * F.col("pnl") / (F.col("qty") * F.col("entry_price")))
    return trades(spark, d).select("trade_id", "account", "symbol", "side", F.when(F.col("side") > 0, "Buy").otherwise("Sell").alias("side_name"), exit_price.alias("exit_price"), F.floor((F.col("exit_ts_ms") - F.col("entry_ts_ms")) / 60000).alias("minutes"))


@register("pf18_level_percents", f"WITH {TRADES} SELECT trade_id, (side * -2.0)::DOUBLE AS sl_pct, '2.0,4.0' AS ladder FROM trades")
def _(spark, d):
    sl = F.col("side") * (F.col("entry_price") * 0.98 - F.col("entry_price")) / F.col("entry_price") * 100
    ladder = F.transform(F.array(F.lit(1.02), F.lit(1.04)), lambda x: F.round((x - 1) * 100, 6).cast("string"))
    return trades(spark, d).select("trade_id", F.round(sl, 6).alias("sl_pct"), F.array_join(ladder, ",").alias("ladder"))


@register("pf19_drop_parents", f"WITH {TRADES} SELECT DISTINCT account, symbol FROM trades t WHERE symbol <> 'N' OR NOT EXISTS (SELECT 1 FROM trades u WHERE u.account = t.account AND u.symbol = 'R')")
def _(spark, d):
    t = trades(spark, d).select("account", "symbol").distinct()
    has_child = t.where("symbol = 'R'").select("account")
    return t.where("symbol <> 'N'").unionByName(t.where("symbol = 'N'").join(has_child, "account", "left_anti"))


@register("pf20_hidden_accounts", f"WITH {TRADES} SELECT account, count(*) AS n FROM trades WHERE account NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY account")
def _(spark, d):
    hidden = read(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("account"))
    return trades(spark, d).join(hidden, "account", "left_anti").groupBy("account").agg(F.count("*").alias("n"))


@register("srt04_downsample", f"""WITH {_EQ}, r AS (SELECT account, trade_id, row_number() OVER (PARTITION BY account ORDER BY {O}) - 1 AS i, count(*) OVER (PARTITION BY account) AS n FROM eq)
SELECT account, trade_id FROM r WHERE n <= 50 OR i IN (SELECT (k * (n - 1)) // 49 FROM range(50) t(k))""")
def _(spark, d):
    return series.downsample(eq(spark, d), A, ORDER, 50).select("account", "trade_id")


@register("srt05_last_event", f"WITH {TRADES}, u AS (SELECT account, entry_ts_ms AS ts, 1 AS live, trade_id FROM trades WHERE trade_id % 5 = 0 UNION ALL SELECT account, exit_ts_ms, 0, trade_id FROM trades) SELECT account, ts, live, trade_id FROM u QUALIFY row_number() OVER (PARTITION BY account ORDER BY ts DESC, live DESC, trade_id DESC) = 1")
def _(spark, d):
    t = trades(spark, d)
    u = t.where("trade_id % 5 = 0").select("account", F.col("entry_ts_ms").alias("ts"), F.lit(1).alias("live"), "trade_id").unionByName(t.select("account", F.col("exit_ts_ms").alias("ts"), F.lit(0).alias("live"), "trade_id"))
    return u.groupBy("account").agg(F.max(F.struct("ts", "live", "trade_id")).alias("x")).select("account", "x.*")


@register("srt09_positions_by_pnl", f"WITH {TRADES} SELECT trade_id, account, pnl FROM trades ORDER BY abs(pnl) DESC, trade_id")
def _(spark, d):
    return trades(spark, d).orderBy(F.abs("pnl").desc(), "trade_id").select("trade_id", "account", "pnl")


@register("srt10_recent_trades", f"WITH {TRADES} SELECT trade_id, account, exit_ts_ms FROM trades ORDER BY exit_ts_ms DESC, trade_id DESC LIMIT 10")
def _(spark, d):
    return trades(spark, d).orderBy(F.desc("exit_ts_ms"), F.desc("trade_id")).limit(10).select("trade_id", "account", "exit_ts_ms")


@register("srt07_clip_window", f"WITH {bars_sql()}, s AS (SELECT symbol, min(ts_ms) + 86400000 AS lo, max(ts_ms) - 86400000 AS hi FROM bars GROUP BY symbol) SELECT b.symbol, b.ts_ms FROM bars b JOIN s ON b.symbol = s.symbol WHERE b.ts_ms BETWEEN lo - 180000000 AND hi + 180000000 QUALIFY row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts_ms DESC) <= 300")
def _(spark, d):
    b = bars(spark, d)
    s = b.groupBy("symbol").agg((F.min("ts_ms") + 86_400_000).alias("lo"), (F.max("ts_ms") - 86_400_000).alias("hi"))
    return series.last_n(b.join(s, "symbol").where("ts_ms BETWEEN lo - 180000000 AND hi + 180000000"), 300, ["symbol"]).select("symbol", "ts_ms")


@register("ag26_merge_accounts", f"""WITH {TRADES}, snap AS (SELECT account, symbol AS host, sum(pnl) AS equity, count(*) AS n FROM trades GROUP BY ALL)
SELECT account, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts, arg_max(n, {{'e': round(equity, 4), 'h': host}}) AS n FROM snap GROUP BY account""")
def _(spark, d):
    snap = trades(spark, d).groupBy("account", F.col("symbol").alias("host")).agg(F.sum("pnl").alias("equity"), F.count("*").alias("n"))
    return snap.groupBy("account").agg(F.array_join(F.sort_array(F.collect_set("host")), ",").alias("hosts"), F.max_by("n", F.struct(F.round("equity", 4), "host")).alias("n"))


@register("wn16_step_equity", f"""WITH {_EQ}, l AS (SELECT account, exit_ts_ms, last(equity ORDER BY trade_id) AS equity FROM eq GROUP BY ALL), s AS (SELECT account, (min(entry_ts_ms) // 86400000) * 86400000 AS a, (max(exit_ts_ms) // 86400000) * 86400000 AS z FROM trades GROUP BY account),
 g AS (SELECT account, unnest(generate_series(a, z, 86400000)) AS ts_ms FROM s)
SELECT g.account, g.ts_ms, round(coalesce(l.equity, 0), 4) AS equity FROM g ASOF LEFT JOIN l ON g.account = l.account AND g.ts_ms >= l.exit_ts_ms""")
def _(spark, d):
    """Every account's equity on each of its own days, from its first entry to its last exit."""
    day = 86_400_000
    at = lambda c: (F.floor(c / day) * day).cast("long")
    span = trades(spark, d).groupBy("account").agg(at(F.min("entry_ts_ms")).alias("a"), at(F.max("exit_ts_ms")).alias("z"))
    return _r(tr.step_equity(eq(spark, d), span, A, ORDER))


_START_EQ = 1_000_000.0


@register("ag15_performance", f"""WITH {TRADES}, eq AS (SELECT *, {_START_EQ}::DOUBLE + sum(pnl) OVER (PARTITION BY account ORDER BY {O} ROWS UNBOUNDED PRECEDING) AS equity FROM trades), p AS (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY {O} ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
 dd AS (SELECT account, max(peak - equity) AS magnitude, max(CASE WHEN peak > 0 THEN (peak - equity) / peak ELSE 0 END) AS fraction FROM p GROUP BY account),
 a AS (SELECT account, count(*) AS n, (max(exit_ts_ms) - min(entry_ts_ms)) / 86400000.0::DOUBLE AS span_days, sum(pnl) AS net, sum(abs(qty * entry_price)) AS invested, sum(abs(qty * entry_price) + abs(qty * entry_price + side * pnl)) AS fills FROM trades GROUP BY account),
 b AS (SELECT a.*, magnitude, fraction, CASE WHEN span_days > 0 AND {_START_EQ} + net > 0 THEN pow(({_START_EQ}::DOUBLE + net) / {_START_EQ}::DOUBLE, 365.0::DOUBLE / span_days) - 1 END AS cagr FROM a JOIN dd USING (account))
SELECT account, n, round(span_days, 4) AS span_days, round(net, 2) AS net, round(net / {_START_EQ}::DOUBLE, 6) AS total_return, round(cagr, 6) AS cagr, round(CASE WHEN invested > 0 THEN net / invested END, 8) AS return_on_invested, round(fills / {_START_EQ}::DOUBLE, 4) AS turnover,
 round(CASE WHEN span_days > 0 THEN n / (span_days / 30.4375::DOUBLE) END, 4) AS trades_per_month, round(CASE WHEN magnitude > 0 THEN net / magnitude END, 4) AS recovery_factor, round(CASE WHEN fraction > 0 THEN cagr / fraction END, 4) AS calmar FROM b""")
def _(spark, d):
    out = tr.performance(trades(spark, d), A, ORDER, _START_EQ)
    digits = {"span_days": 4, "net": 2, "total_return": 6, "cagr": 6, "return_on_invested": 8, "turnover": 4, "trades_per_month": 4, "recovery_factor": 4, "calmar": 4}
    return out.withColumns({c: F.round(c, k) for c, k in digits.items()})


@register("ag15_exposure", f"""WITH {TRADES}, g AS (SELECT account, unnest(generate_series((min(entry_ts_ms) // 86400000) * 86400000, max(exit_ts_ms), 86400000)) AS ts_ms FROM trades GROUP BY account),
 o AS (SELECT DISTINCT g.account, g.ts_ms FROM g JOIN trades t ON t.account = g.account AND t.entry_ts_ms <= g.ts_ms AND t.exit_ts_ms > g.ts_ms)
SELECT g.account, round(count(o.ts_ms) / count(*)::DOUBLE, 6) AS exposure FROM g LEFT JOIN o ON o.account = g.account AND o.ts_ms = g.ts_ms GROUP BY g.account""")
def _(spark, d):
    return _r(tr.step_exposure(trades(spark, d), A), 6)


@register("ag15_buy_hold", f"WITH {bars_sql()} SELECT symbol, round(CASE WHEN count(*) >= 2 AND arg_min(close, ts_ms) > 0 THEN arg_max(close, ts_ms) / arg_min(close, ts_ms) - 1 END, 6) AS buy_hold_return FROM bars GROUP BY symbol")
def _(spark, d):
    return _r(tr.buy_and_hold(bars(spark, d), ["symbol"]), 6)
