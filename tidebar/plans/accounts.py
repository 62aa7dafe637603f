"""Accounts on several hosts, fleet totals, pairs of bots, and trades as venues state them.

Suppliers are accounts; a trade's symbol stands for the host that reports it where hosts are asked for.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import accounts as ac
from tidebar.plans.registry import register
from tidebar.plans.views import TRADES, trades
from tidebar.scratch import written


@register("pf12_closed_rows", f"""WITH {TRADES} SELECT account, trade_id::VARCHAR AS order_id, symbol, CASE WHEN side > 0 THEN 'Buy' ELSE 'Sell' END AS side, qty, qty AS closed_size, entry_price AS entry, CASE WHEN trade_id % 5 > 0 THEN entry_price * 2 END AS exit, pnl,
 CASE WHEN trade_id % 4 = 0 THEN 3.0::DOUBLE END AS leverage, 'Market' AS order_type, 'Trade' AS exec_type, CASE WHEN trade_id % 3 > 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS open_fee, CASE WHEN trade_id % 3 = 0 THEN 0.75::DOUBLE END AS close_fee, 2 AS fill_count,
 CASE WHEN trade_id % 2 = 0 THEN entry_ts_ms END AS created_ms, CASE WHEN trade_id % 7 > 0 THEN exit_ts_ms WHEN trade_id % 2 = 0 THEN entry_ts_ms END AS updated_ms, CASE WHEN trade_id % 6 = 0 THEN 2 ELSE 1 END AS leg_count FROM trades""")
def _(spark, d):
    """All closed trades as JSON under either set of names, then as stable rows, newest first."""
    c, k = F.col, lambda n: F.col("trade_id") % n
    page = F.struct(
        F.when(k(2) == 0, c("trade_id").cast("string")).alias("orderId"), F.when(k(2) == 1, c("trade_id").cast("string")).alias("order_id"), F.lower("symbol").alias("symbol"),
        F.when(c("side") > 0, "Buy").otherwise("Sell").alias("side"), F.when(k(3) > 0, c("qty")).alias("qty"), F.when(k(3) == 0, c("qty").cast("string")).when(k(3) == 1, "0").alias("closedSize"),
        F.when(k(2) == 0, c("entry_price").cast("string")).alias("avgEntryPrice"), F.when(k(2) == 1, c("entry_price")).alias("entry"), F.when(k(5) > 0, c("entry_price") * 2).alias("exit"),
        F.when(k(2) == 0, c("pnl").cast("string")).alias("closedPnl"), F.when(k(2) == 1, c("pnl")).alias("pnl"), F.when(k(4) == 0, 3).alias("leverage"), F.lit("Market").alias("orderType"), F.lit("Trade").alias("execType"),
        F.when(k(3) > 0, "0.5").otherwise("0").alias("openFee"), F.lit("0.25").alias("cumEntryFee"), F.when(k(3) == 0, "0.75").alias("cumExitFee"), F.lit(2).alias("fillCount"),
        F.when(k(2) == 0, c("entry_ts_ms").cast("string")).otherwise("0").alias("createdTime"), F.when(k(7) > 0, c("exit_ts_ms")).alias("updatedTime"), F.when(k(6) == 0, 2).alias("leg_count"),
    )
    rows = trades(spark, d).select("account", F.to_json(page).alias("body"))
    # written first: a sort draws its ranges from a sample, for which all texts would be read a further time
    return written(ac.normalised_trades(rows), "normalised").orderBy(F.desc_nulls_last("updated_ms"), "order_id")


_SNAPS = f"""{TRADES}, snaps AS (SELECT account, symbol AS host, CASE symbol WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS snap_seq, CASE WHEN count(*) % 5 > 0 THEN round(sum(pnl), 4) END AS equity, 'b' || (account % 7)::VARCHAR AS b1, 'b' || (count(*) % 3)::VARCHAR AS b2,
  count(*) AS n_trades, CASE WHEN symbol <> 'N' THEN count(*) FILTER (WHERE side > 0) END AS n_open, round(sum(pnl), 4) AS realized_pnl, (count(*) FILTER (WHERE side < 0))::DOUBLE AS open_upl FROM trades GROUP BY account, symbol),
 best AS (SELECT *, max(coalesce(equity, 0)) OVER (PARTITION BY account ORDER BY snap_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM snaps), ok AS (SELECT *, b IS NULL OR coalesce(equity, 0) >= b AS taken FROM best),
 bots AS (SELECT account, string_agg(bot, ',' ORDER BY at_) AS bots FROM (SELECT account, bot, min(at_) AS at_ FROM (SELECT account, b1 AS bot, 2 * snap_seq AS at_ FROM snaps UNION ALL SELECT account, b2, 2 * snap_seq + 1 FROM snaps) GROUP BY ALL) GROUP BY account),
 merged AS (SELECT account, string_agg(host, ',' ORDER BY snap_seq) AS hosts, any_value(bots.bots) AS bots, {', '.join(f'arg_max({c}, snap_seq) FILTER (WHERE taken AND {c} IS NOT NULL) AS {c}' for c in ('equity', 'n_trades', 'n_open', 'realized_pnl', 'open_upl'))} FROM ok JOIN bots USING (account) GROUP BY account)"""
_WALLET = ["n_trades", "n_open", "realized_pnl", "open_upl"]


def _merged(spark, d):
    """Every account once, from a snapshot per host; some lack their equity, one host its open positions."""
    n, total = F.count("*"), F.round(F.sum("pnl"), 4)
    snaps = trades(spark, d).groupBy("account", F.col("symbol").alias("host")).agg(
        F.when(n % 5 > 0, total).alias("equity"), F.array(F.concat(F.lit("b"), (F.first("account") % 7).cast("string")), F.concat(F.lit("b"), (n % 3).cast("string"))).alias("bots"), n.alias("n_trades"),
        F.when(F.first("symbol") != "N", F.count_if(F.col("side") > 0)).alias("n_open"), total.alias("realized_pnl"), F.count_if(F.col("side") < 0).cast("double").alias("open_upl"),
    )
    return ac.merge_accounts(snaps.withColumn("snap_seq", F.when(F.col("host") == "A", 0).when(F.col("host") == "N", 1).otherwise(2)), _WALLET)


@register("ag26_merged_accounts", f"WITH {_SNAPS} SELECT * FROM merged")
def _(spark, d):
    return _merged(spark, d).withColumns({c: F.array_join(c, ",") for c in ("hosts", "bots")})


@register("ag25_fleet", f"WITH {_SNAPS} SELECT count(*) AS n_accounts, sum(n_trades)::BIGINT AS n_trades, coalesce(sum(n_open), 0)::BIGINT AS n_open_positions, round(sum(realized_pnl), 4) AS realized_pnl, sum(open_upl) AS open_upl, round(sum(realized_pnl) + sum(open_upl), 4) AS combined, round(coalesce(sum(equity), 0), 4) AS equity FROM merged")
def _(spark, d):
    return ac.fleet_totals(_merged(spark, d)).withColumns({c: F.round(c, 4) for c in ("realized_pnl", "combined", "equity")})


@register("ag26_merged_trades", f"WITH {TRADES}, r AS (SELECT account, trade_id AS order_id, exit_ts_ms AS updated_ms, symbol, CASE WHEN trade_id % 4 > 0 THEN pnl END AS pnl, CASE WHEN trade_id % 3 = 0 THEN 1 ELSE 2 END AS snap_seq FROM trades) SELECT account, order_id, updated_ms, symbol, pnl, CASE snap_seq WHEN 1 THEN 'one' ELSE 'two' END AS host FROM r")
def _(spark, d):
    """The second host reports all trades, the first a third of them."""
    t = trades(spark, d).select("account", F.col("trade_id").alias("order_id"), F.col("exit_ts_ms").alias("updated_ms"), "symbol", F.when(F.col("trade_id") % 4 > 0, F.col("pnl")).alias("pnl"))
    one = t.where("order_id % 3 = 0").withColumn("host", F.lit("one")).withColumn("snap_seq", F.lit(1))
    return ac.merge_trades(one.unionByName(t.withColumn("host", F.lit("two")).withColumn("snap_seq", F.lit(2)))).drop("snap_seq")


@register("ag27_pair_rows", f"""WITH {TRADES}, a AS (SELECT DISTINCT account, 'h' || (account % 3)::VARCHAR AS host FROM trades), coins AS (SELECT account, symbol, count(*) AS n_trades, (account % 4) * 10 AS days_active FROM trades GROUP BY ALL),
 bots AS (SELECT account, 'b' || (account % 7)::VARCHAR AS bot, CASE WHEN account % 3 > 0 THEN 'title ' || (account % 7)::VARCHAR END AS label FROM a WHERE account % 11 <> 0 UNION ALL SELECT account, 'x' || (account % 3)::VARCHAR, NULL FROM a WHERE account % 5 = 0 AND account % 11 <> 0),
 given AS (SELECT account, 'b' || (account % 7)::VARCHAR AS bot, 'R' AS symbol FROM a WHERE account % 2 = 0 UNION ALL SELECT account, 'x' || (account % 3)::VARCHAR, 'N' FROM a WHERE account % 5 = 0), wanted AS (SELECT bots.*, symbol FROM given JOIN bots USING (account, bot)),
 sole AS (SELECT account, min(bot) AS bot, min(label) AS label FROM bots GROUP BY account HAVING count(*) = 1),
 u AS (SELECT coins.*, bot, label FROM coins JOIN wanted USING (account, symbol) UNION ALL SELECT c.*, bot, label FROM coins c LEFT JOIN sole USING (account) WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.account = c.account AND w.symbol = c.symbol))
SELECT host, account, symbol, bot, coalesce(label, bot, '—') AS label, n_trades, CASE WHEN days_active > 0 THEN round(n_trades / days_active::DOUBLE, 3) END AS trades_per_day FROM u JOIN a USING (account)""")
def _(spark, d):
    """Accounts with one bot, two and none; some pairs are assigned, others left over."""
    c = F.col("account")
    name = lambda p, n: F.concat(F.lit(p), (c % n).cast("string"))
    t = trades(spark, d).withColumn("host", name("h", 3))
    coins = t.groupBy("host", "account", F.lower("symbol").alias("symbol")).agg(F.count("*").alias("n_trades"), ((F.first("account") % 4) * 10).alias("days_active"))
    a = t.select("host", "account").distinct()
    with_bots = a.where(c % 11 != 0)
    bots = with_bots.select("host", "account", name("b", 7).alias("bot"), F.when(c % 3 > 0, name("title ", 7)).alias("label"))
    bots = bots.unionByName(with_bots.where(c % 5 == 0).select("host", "account", name("x", 3).alias("bot"), F.lit(None).cast("string").alias("label")))
    given = a.where(c % 2 == 0).select("host", "account", name("b", 7).alias("bot"), F.lit("R").alias("symbol"))
    given = given.unionByName(a.where(c % 5 == 0).select("host", "account", name("x", 3).alias("bot"), F.lit("N").alias("symbol")))
    return ac.pair_rows(coins, bots, given).drop("days_active")


@register("ag22_run_totals", f"""WITH {TRADES}, x AS (SELECT *, CASE WHEN trade_id % 50 = 0 THEN 'liquidation_mark' ELSE reason END AS r, exit_ts_ms - entry_ts_ms < (account % 9) * 864000000 AS early, trade_id % 9 < account % 3 AS unclear FROM trades)
SELECT account, count(*) AS n_trades, round(avg(early::INT), 6) AS entry_bar_exit_rate, round(avg(unclear::INT), 6) AS ambiguous_rate, count(*) FILTER (WHERE starts_with(r, 'liquidation')) AS n_liquidations, sum(qty * 0.5::DOUBLE) AS total_fees, sum(side * 0.25::DOUBLE) AS total_funding,
 sum(qty * 0.125::DOUBLE) AS total_slippage, round(sum(pnl), 4) AS total_pnl, count(*) FILTER (WHERE side > 0) AS n_longs, count(*) FILTER (WHERE side < 0) AS n_shorts,
 concat_ws(',', CASE WHEN avg(early::INT) > 0.25 THEN 'entry_bar_exits' END, CASE WHEN avg(unclear::INT) > 0.1 THEN 'ambiguous_bars' END) AS warnings FROM x GROUP BY account""")
def _(spark, d):
    c = F.col
    t = trades(spark, d).withColumns({"fees": c("qty") * 0.5, "funding": c("side") * 0.25, "slippage_cost": c("qty") * 0.125, "reason": F.when(c("trade_id") % 50 == 0, "liquidation_mark").otherwise(c("reason"))})
    out = ac.run_totals(t, ["account"], c("exit_ts_ms") - c("entry_ts_ms") < (c("account") % 9) * 864_000_000, c("trade_id") % 9 < c("account") % 3)
    return out.withColumns({"entry_bar_exit_rate": F.round("entry_bar_exit_rate", 6), "ambiguous_rate": F.round("ambiguous_rate", 6), "total_pnl": F.round("total_pnl", 4), "warnings": F.array_join("warnings", ",")})
