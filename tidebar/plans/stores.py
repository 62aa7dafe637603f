"""Keyed-write queries: what a store holds after batches made of the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import demand, series, upsert as up
from tidebar.plans.registry import register
from tidebar.plans.views import TRADES, TICKS, bars, bars_sql, more_bars, read, tick_bars, ticks, trades

_EVEN, _ODD = more_bars("even", "1h", "seq % 2 = 0"), more_bars("odd", "1h", "seq % 3 = 1")
_V = "open, high, low, close, volume"


def _two(spark, d):
    t = ticks(spark, d)
    return tick_bars(t.where("seq % 2 = 0"), "1h"), tick_bars(t.where("seq % 3 = 1"), "1h")


@register("snk01_overwrite", f"WITH {bars_sql('1h', 'even', 'seq % 2 = 0')}, {_ODD} SELECT source, symbol, timeframe, ts_ms, {_V} FROM odd UNION ALL SELECT source, symbol, timeframe, ts_ms, {_V} FROM even e WHERE NOT EXISTS (SELECT 1 FROM odd o WHERE o.symbol = e.symbol AND o.ts_ms = e.ts_ms)")
def _(spark, d):
    old, new = _two(spark, d)
    return up.overwrite(old, new, ["source", "symbol", "timeframe", "ts_ms"])


@register("snk02_change_detecting", f"""WITH {bars_sql('1h', 'even', 'seq % 2 = 0')}, {_ODD}, j AS (SELECT coalesce(e.symbol, o.symbol) AS symbol, coalesce(e.ts_ms, o.ts_ms) AS ts_ms, e.close AS ec, o.close AS oc, e.high AS eh, o.high AS oh, e.symbol AS es, o.symbol AS os FROM even e FULL JOIN odd o ON e.symbol = o.symbol AND e.ts_ms = o.ts_ms)
SELECT symbol, ts_ms, CASE WHEN os IS NULL THEN eh ELSE oh END AS high, CASE WHEN os IS NULL THEN ec ELSE oc END AS close, CASE WHEN os IS NULL OR (es IS NOT NULL AND ec = oc AND eh = oh) THEN 1 ELSE 2 END::BIGINT AS updated FROM j""")
def _(spark, d):
    """Every key comes twice in the batch, first with a wrong value that the later row corrects."""
    old, new = _two(spark, d)
    wrong = new.withColumns({"high": F.col("high") + 100, "close": F.col("close") + 100, "seq": F.lit(1)})
    batch = new.withColumn("seq", F.lit(2)).unionByName(wrong)
    return up.change_detecting(old.withColumn("updated", F.lit(1).cast("long")), batch, ["symbol", "ts_ms"], ["high", "close"], ["high"], "updated", F.lit(2).cast("long"), "seq")


@register("snk03_coalescing", f"""WITH {bars_sql('1h', 'even', 'seq % 2 = 0')}, {_ODD}, o AS (SELECT symbol, ts_ms, CASE WHEN volume > 1 THEN close END AS oi, CASE WHEN volume > 1 THEN high END AS ls FROM odd)
SELECT coalesce(e.symbol, o.symbol) AS symbol, coalesce(e.ts_ms, o.ts_ms) AS ts_ms, CASE WHEN o.symbol IS NOT NULL THEN o.oi ELSE e.close END AS oi, coalesce(o.ls, e.high) AS ls FROM even e FULL JOIN o ON e.symbol = o.symbol AND e.ts_ms = o.ts_ms""")
def _(spark, d):
    old, new = _two(spark, d)
    n = new.select("symbol", "ts_ms", F.when(F.col("volume") > 1, F.col("close")).alias("oi"), F.when(F.col("volume") > 1, F.col("high")).alias("ls"))
    return up.coalescing(old.select("symbol", "ts_ms", F.col("close").alias("oi"), F.col("high").alias("ls")), n, ["symbol", "ts_ms"], ["oi"], ["ls"])


@register("snk06_latest_by_key", "SELECT event_type AS key, arg_max(value, event_id) AS value, max(event_id) AS updated_at FROM events GROUP BY 1")
def _(spark, d):
    return up.latest_by_key(read(spark, d, "events").select(F.col("event_type").alias("key"), "value", F.col("event_id").alias("updated_at")), "key", "value", "updated_at")


_H4 = more_bars("h4", "4h")


@register("snk08_purge_counts", f"WITH {bars_sql()}, {_H4}, purged AS (SELECT symbol, count(*) AS deleted FROM h4 GROUP BY symbol), kept AS (SELECT symbol, count(*) AS left_1h FROM bars GROUP BY symbol) SELECT symbol, '4h' AS timeframe, deleted, left_1h, 0::BIGINT AS left_4h FROM purged JOIN kept USING (symbol)")
def _(spark, d):
    """A store of two timeframes, of which one is purged: rows deleted per series, and what the store holds then."""
    from tidebar.schemas import BARS, KEY
    from tidebar.scratch import scratch_path

    store = up.Store(spark, scratch_path(spark, "two-frames"), KEY, BARS)
    store.write(bars(spark, d).unionByName(tick_bars(ticks(spark, d), "4h")).select(*store.columns))
    gone = store.purge_series(timeframe="4h")
    left = store.read().groupBy("symbol").agg(F.count_if(F.col("timeframe") == "1h").alias("left_1h"), F.count_if(F.col("timeframe") == "4h").alias("left_4h"))
    return gone.join(left, "symbol").select("symbol", "timeframe", "deleted", "left_1h", "left_4h")


@register("snk07_purge_forming", f"WITH {bars_sql()} SELECT count(*) FILTER (WHERE ts_ms + 3600000 <= 1705278600000) AS kept, count(*) FILTER (WHERE ts_ms + 3600000 > 1705278600000) AS deleted FROM bars")
def _(spark, d):
    b = bars(spark, d)
    closed = series.drop_forming(b, F.lit(1_705_278_600_000)).withColumn("k", F.lit(1))
    return b.join(closed.select("symbol", "ts_ms", "k"), ["symbol", "ts_ms"], "left").agg(F.count("k").alias("kept"), F.count_if(F.col("k").isNull()).alias("deleted"))


@register("snk09_purge_except", f"WITH {bars_sql()} SELECT symbol, count(*) AS deleted FROM bars WHERE symbol NOT IN ('click', 'view') GROUP BY symbol")
def _(spark, d):
    b = bars(spark, d)
    return up.purge_except(b, b.where("symbol IN ('click', 'view')").select("symbol").distinct(), ["symbol"])[1]


@register("snk10_cache_watermark", f"WITH {TRADES} SELECT account, count(*) AS legs, min(exit_ts_ms) AS from_ms, max(exit_ts_ms) AS end_ms FROM trades GROUP BY account")
def _(spark, d):
    t = trades(spark, d)
    merged = up.overwrite(t.where("trade_id % 2 = 0"), t.where("trade_id % 3 < 2"), ["account", "trade_id"]).unionByName(t.where("trade_id % 2 = 1 AND trade_id % 3 = 2"))
    return merged.groupBy("account").agg(F.count("*").alias("legs"), F.min("exit_ts_ms").alias("from_ms"), F.max("exit_ts_ms").alias("end_ms"))


@register("snk14_registry", f"""WITH {TICKS} SELECT symbol AS "column", list_aggregate(list_sort(list(DISTINCT 'r' || (user_id % 5))), 'string_agg', ',') AS reasons, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen FROM ticks GROUP BY symbol""")
def _(spark, d):
    t = ticks(spark, d).select(F.col("symbol").alias("column"), F.concat(F.lit("r"), F.col("user_id") % 5).alias("reason"), F.col("ts_ms").alias("seen"), "seq", F.lit("x").alias("symbol"), F.lit("1h").alias("timeframe"))
    empty = spark.createDataFrame([], "column string, reasons array<string>, first_seen long, last_seen long, symbol string, timeframe string")
    out = up.merge_registry(up.merge_registry(empty, t.where("seq % 2 = 0")), t.where("seq % 2 = 1"))
    return out.select("column", F.array_join(F.sort_array("reasons"), ",").alias("reasons"), "first_seen", "last_seen")


@register("snk15_st06_flags", f"WITH {TICKS} SELECT user_id, symbol, 'r' || (seq % 3) AS reason FROM ticks QUALIFY row_number() OVER (PARTITION BY user_id, symbol ORDER BY seq DESC) = 1 AND seq % 4 <> 0")
def _(spark, d):
    log = ticks(spark, d).select("user_id", "symbol", "seq", F.when(F.col("seq") % 4 != 0, "set").otherwise("clear").alias("action"), F.concat(F.lit("r"), F.col("seq") % 3).alias("reason"))
    return up.flags(log, ["user_id", "symbol"])


@register("jn15_parity", f"""WITH {TRADES}, l AS (SELECT *, row_number() OVER (PARTITION BY entry_ts_ms ORDER BY trade_id) AS n FROM trades WHERE account % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY entry_ts_ms ORDER BY trade_id) AS n FROM trades WHERE account % 3 = 0)
SELECT CASE WHEN r.trade_id IS NULL THEN 'only_left' WHEN l.trade_id IS NULL THEN 'only_right' WHEN abs(l.qty - r.qty) > 1e-9 THEN 'qty' WHEN abs(l.pnl - r.pnl) > 1e-9 THEN 'pnl' ELSE 'same' END AS outcome, count(*) AS n FROM l FULL JOIN r ON l.entry_ts_ms = r.entry_ts_ms AND l.n = r.n GROUP BY 1""")
def _(spark, d):
    from tidebar.operators.parity import diff_trades

    t = trades(spark, d)
    out = diff_trades(t.where("account % 2 = 0"), t.where("account % 3 = 0"), ["qty", "pnl"])
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@register("jn18_soft_match", f"""WITH {TICKS}, d AS (SELECT seq AS decide_id, symbol, ts_ms, price FROM ticks WHERE seq % 3 = 0), t AS (SELECT seq AS trade_id, symbol, ts_ms, price FROM ticks WHERE seq % 3 = 1)
SELECT trade_id, arg_min(decide_id, {{'s': abs(t.ts_ms - d.ts_ms), 'i': decide_id}}) AS decide_id FROM t JOIN d ON t.symbol = d.symbol AND t.ts_ms - d.ts_ms BETWEEN -300000 AND 43200000 AND abs(t.price - d.price) <= 0.02 * d.price GROUP BY trade_id""")
def _(spark, d):
    from tidebar.operators.parity import soft_match

    t = ticks(spark, d)
    return soft_match(t.where("seq % 3 = 1").withColumnRenamed("seq", "trade_id").select("trade_id", "symbol", "ts_ms", "price"), t.where("seq % 3 = 0").withColumnRenamed("seq", "decide_id").select("decide_id", "symbol", "ts_ms", "price"), 0.02)


@register("jn15_tolerance", f"""WITH {TICKS}, x AS (SELECT DISTINCT (ts_ms // 600000) AS slot, seq FROM ticks), l AS (SELECT slot * 600000 AS t, min(seq) AS id FROM x WHERE seq % 2 = 0 GROUP BY slot), r AS (SELECT slot * 600000 + CASE WHEN slot % 3 = 0 THEN 400000 ELSE 1000 * (slot % 7) END AS t, min(seq) AS id FROM x WHERE seq % 3 = 0 GROUP BY slot)
SELECT l.id AS left_id, r.id AS right_id, CASE WHEN r.id IS NULL THEN 'only_left' WHEN l.id IS NULL THEN 'only_right' WHEN l.id <> r.id THEN 'qty' ELSE 'same' END AS outcome FROM l FULL JOIN r ON abs(l.t - r.t) <= 60000""")
def _(spark, d):
    """Two sides of one trade a slot of ten minutes, the right ones later by seconds, or by far more than the window in a third of the slots."""
    from tidebar.operators.parity import diff_trades

    t = ticks(spark, d).withColumn("slot", F.floor(F.col("ts_ms") / 600_000))
    side = lambda m, at: t.where(F.col("seq") % m == 0).groupBy("slot").agg(F.min("seq").alias("trade_id")).select("trade_id", at.cast("long").alias("entry_ts_ms"), F.col("trade_id").cast("double").alias("qty"))
    start = F.col("slot") * 600_000
    late = F.when(F.col("slot") % 3 == 0, 400_000).otherwise(1000 * (F.col("slot") % 7))
    return diff_trades(side(2, start), side(3, start + late), ["qty"], window_ms=60_000, block_ms=7 * 86_400_000)


_DECIDED = """p AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey AS position_id, l_returnflag AS symbol, CASE WHEN l_linestatus = 'O' THEN 'Buy' WHEN l_linenumber = 7 THEN '' ELSE 'Sell' END AS side, l_quantity + CASE WHEN l_linenumber = 1 THEN 45 ELSE 0 END AS qty FROM lineitem WHERE l_linenumber IN (1, 4, 7)),
 d AS (SELECT o_orderkey AS decide_id, CASE o_orderstatus WHEN 'O' THEN 'N' WHEN 'F' THEN 'R' ELSE '' END AS symbol, CASE WHEN o_orderpriority < '3' THEN 'Buy' ELSE 'Sell' END AS side, (o_custkey % 80)::DOUBLE AS qty, epoch_ms(o_orderdate) AS bar_ms FROM orders)"""


@register("jn19_newest_decision", f"""WITH {_DECIDED}, ds AS (SELECT symbol, side, qty, max({{'b': bar_ms, 'i': -decide_id}}) AS best FROM d GROUP BY ALL), ps AS (SELECT DISTINCT symbol, side, qty FROM p),
 found AS (SELECT ps.symbol, ps.side, ps.qty, max({{'b': best.b, 'l': -ds.qty, 'i': best.i}}) AS m FROM ps JOIN ds ON (ds.symbol = ps.symbol OR ds.symbol = '') AND (ds.side = ps.side OR ps.side = '') AND ps.qty <= ds.qty + greatest(1e-9, ds.qty * 1e-4) GROUP BY ALL)
SELECT position_id, p.symbol, p.side, p.qty, -(found.m.i) AS decide_id, found.m.b AS bar_ms FROM p LEFT JOIN found ON found.symbol = p.symbol AND found.side = p.side AND found.qty = p.qty""")
def _(spark, d):
    """Line items are positions, orders decisions; some have no side or no symbol, and some positions are larger than any decision."""
    from tidebar.functions.scalar import normalize_side, utc_ms
    from tidebar.operators.parity import newest_decision

    li, o = read(spark, d, "lineitem").where("l_linenumber IN (1, 4, 7)"), read(spark, d, "orders")
    side = F.when(F.col("l_linestatus") == "O", "long").when(F.col("l_linenumber") == 7, "").otherwise("-1")
    qty = F.col("l_quantity") + F.when(F.col("l_linenumber") == 1, 45).otherwise(0)
    ident = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    p = li.select(ident.alias("position_id"), F.col("l_returnflag").alias("symbol"), normalize_side(side).alias("side"), qty.cast("double").alias("qty"))
    symbol = F.when(F.col("o_orderstatus") == "O", "N").when(F.col("o_orderstatus") == "F", "R").otherwise("")
    decided = normalize_side(F.when(F.col("o_orderpriority") < "3", "BUY ").otherwise("short"))
    bar = utc_ms(F.col("o_orderdate"), dict(o.dtypes)["o_orderdate"] == "timestamp_ntz")
    return newest_decision(p, o.select(F.col("o_orderkey").alias("decide_id"), symbol.alias("symbol"), decided.alias("side"), (F.col("o_custkey") % 80).cast("double").alias("qty"), bar.alias("bar_ms")))


@register("jn17_key_join", f"""WITH {TICKS}, d AS (SELECT seq AS decide_id, [seq, seq + 1, seq + 2] AS ids, CASE WHEN seq % 2 = 0 THEN price END AS confidence FROM ticks WHERE seq % 2 = 0 OR seq % 5 = 0), e AS (SELECT unnest(ids) AS order_id, decide_id, confidence FROM d)
SELECT order_id, decide_id, confidence FROM e QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY confidence IS NULL, decide_id) = 1""")
def _(spark, d):
    k = F.col("seq")
    t = ticks(spark, d).where("seq % 2 = 0 OR seq % 5 = 0").select(k.alias("decide_id"), F.array(k, k + 1, k + 2).alias("ids"), F.when(k % 2 == 0, F.col("price")).alias("confidence"))
    e = t.select(F.explode("ids").alias("order_id"), "decide_id", "confidence")
    return e.groupBy("order_id").agg(F.min_by(F.struct("decide_id", "confidence"), F.struct(F.col("confidence").isNull(), "decide_id")).alias("x")).select("order_id", "x.*")


@register("jn22_demand_diff", "WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0) SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def _(spark, d):
    e = read(spark, d, "events")
    return demand.changes(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type"]).groupBy("change").agg(F.count("*").alias("n"))


@register("jn21_account_labels", """WITH p AS (SELECT DISTINCT s_nationkey AS bot, s_suppkey AS account FROM supplier UNION SELECT s_nationkey + 1, s_suppkey FROM supplier WHERE s_suppkey % 5 = 0), sole AS (SELECT account, min(bot) AS bot FROM p WHERE account % 7 <> 0 GROUP BY account HAVING count(*) = 1),
 l AS (SELECT l_suppkey AS account, count(*) AS n FROM lineitem GROUP BY 1) SELECT account, sole.bot, coalesce(n_name, sole.bot::VARCHAR, '\u2014') AS label, n FROM l LEFT JOIN sole USING (account) LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON n_nationkey = sole.bot""")
def _(spark, d):
    """Suppliers are accounts, their nations bots; a fifth of the accounts has a second bot, a seventh none."""
    s = read(spark, d, "supplier")
    second = s.where("s_suppkey % 5 = 0").withColumn("s_nationkey", F.col("s_nationkey") + 1)
    bots = s.unionByName(second).where("s_suppkey % 7 <> 0").groupBy(F.col("s_nationkey").alias("bot")).agg(F.collect_set("s_suppkey").alias("accounts"))
    catalog = read(spark, d, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("bot"), F.col("n_name").alias("title"))
    legs = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("account")).agg(F.count("*").alias("n"))
    return demand.labelled(legs, demand.account_bots(bots), catalog).select("account", "bot", "label", "n")


@register("jn23_history_need", """WITH n AS (SELECT c_nationkey AS bot, count(*) AS bars FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1), q AS (SELECT DISTINCT event_type AS symbol, user_id % 40 AS timeframe, user_id % 25 AS bot FROM events)
SELECT symbol, timeframe, greatest(50, coalesce(max(bars), 0)) AS bars, count(*) AS bots FROM q LEFT JOIN n USING (bot) GROUP BY symbol, timeframe""")
def _(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("symbol"), (F.col("user_id") % 40).alias("timeframe"), (F.col("user_id") % 25).alias("bot"))
    needs = read(spark, d, "customer").where("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("bot")).agg(F.count("*").alias("bars"))
    return demand.history_need(e, needs, ["symbol", "timeframe"], 50)


@register("jn24_timeframes", "SELECT DISTINCT event_type AS symbol, tf AS timeframe FROM (SELECT event_type, unnest(['1h', '4h', CASE user_id % 2 WHEN 0 THEN '1h' ELSE '15m' END]) AS tf FROM events)")
def _(spark, d):
    e = read(spark, d, "events").select(F.col("event_type").alias("symbol"), F.when(F.col("user_id") % 2 == 0, "1h").otherwise("15m").alias("timeframe"))
    return demand.with_timeframes(e.distinct(), ["1h", "4h"])


@register("snk04_replace_series", f"WITH {bars_sql('1h', 'even', 'seq % 2 = 0')}, {_ODD} SELECT symbol, ts_ms, close FROM odd WHERE symbol < 'm' UNION ALL SELECT symbol, ts_ms, close FROM even WHERE symbol NOT IN (SELECT symbol FROM odd WHERE symbol < 'm')")
def _(spark, d):
    old, new = _two(spark, d)
    return up.replace_series(old, new.where("symbol < 'm'"), ["source", "symbol", "timeframe"]).select("symbol", "ts_ms", "close")


@register("snk05_snk13_snapshot", f"WITH {bars_sql()} SELECT source, symbol, timeframe, count(*) AS bars, min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms FROM bars GROUP BY ALL")
def _(spark, d):
    """A snapshot table written over by the next one, and read back."""
    from tidebar.scratch import scratch_path

    path = scratch_path(spark, "snapshot")
    for part in (bars(spark, d).where("symbol < 'm'"), bars(spark, d)):
        series.coverage(part).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("snk11_snk12_run_store", f"WITH {TRADES} SELECT account % 5 AS strategy_id, account AS run_id, count(*) AS trades, round(sum(pnl), 4) AS pnl FROM trades GROUP BY ALL")
def _(spark, d):
    """Trades kept by strategy and run; the catalog is a summary of them."""
    from tidebar.scratch import scratch_path

    path = scratch_path(spark, "runs")
    t = trades(spark, d).withColumn("strategy_id", F.col("account") % 5).withColumnRenamed("account", "run_id")
    t.hint("rebalance", "strategy_id").write.partitionBy("strategy_id").parquet(path)  # a strategy that holds much is split
    return spark.read.parquet(path).groupBy(F.col("strategy_id").cast("long").alias("strategy_id"), "run_id").agg(F.count("*").alias("trades"), F.round(F.sum("pnl"), 4).alias("pnl"))


@register("snk16_migrate", f"WITH {bars_sql()} SELECT symbol, ts_ms, 'mark' AS price_type, CASE WHEN symbol < 'm' THEN 'a' END AS venue FROM bars")
def _(spark, d):
    b = bars(spark, d).select(F.when(F.col("symbol") < "m", "one").otherwise("two").alias("source"), "symbol", "ts_ms")
    return up.migrate(b, {"price_type": {"one": "mark", "two": "mark"}, "venue": {"one": "a"}}).select("symbol", "ts_ms", "price_type", "venue")


@register("snk17_stale_instruments", f"WITH {TICKS} SELECT symbol, max(ts_ms) AS retrieved_at_ms, 1706700000000 - max(ts_ms) > 100000000 AS stale FROM ticks GROUP BY symbol")
def _(spark, d):
    latest = up.latest_events(ticks(spark, d).select("symbol", F.col("ts_ms").alias("retrieved_at_ms")), ["symbol"], "retrieved_at_ms")
    return latest.withColumn("stale", 1_706_700_000_000 - F.col("retrieved_at_ms") > 100_000_000)
