"""Queries over landed text and JSON: event properties, rendered rows and conversation lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import series
from tidebar.plans.registry import register
from tidebar.plans.views import TICKS, bars, bars_sql, more_bars, read, ticks
from tidebar.sources import files

_OHLCV = "open, high, low, close, volume"


@register("src01_bar_scan", f"WITH {bars_sql()} SELECT symbol, ts_ms, close FROM bars WHERE symbol = 'click' AND ts_ms BETWEEN 1704500000000 AND 1705500000000")
def _(spark, d):
    return bars(spark, d).where("symbol = 'click' AND ts_ms BETWEEN 1704500000000 AND 1705500000000").select("symbol", "ts_ms", "close")


@register("src02_live_last_n", f"WITH {bars_sql('15m')} SELECT symbol, ts_ms, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_ms DESC) <= 20")
def _(spark, d):
    return series.last_n(bars(spark, d, "15m"), 20, ["symbol"]).select("symbol", "ts_ms", "close")


@register("src05_kline_csv", f"WITH {TICKS} SELECT symbol, ts_ms, price AS open, price + 1 AS high, price - 1 AS low, price AS close, 1.0::DOUBLE AS volume FROM ticks WHERE seq % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms ORDER BY seq DESC) = 1")
def _(spark, d):
    p, k = F.col("price"), F.col("seq")
    t = ticks(spark, d)
    ts = F.when(k % 10 == 0, "open_time").when(k % 3 == 0, (F.col("ts_ms") * 1000 + 7).cast("string")).otherwise(F.col("ts_ms").cast("string"))
    rows = t.select("symbol", "seq", ts.alias("c0"), p.cast("string").alias("c1"), (p + 1).cast("string").alias("c2"), (p - 1).cast("string").alias("c3"), p.cast("string").alias("c4"), F.lit("1").alias("c5"))
    return files.kline_csv(rows, F.col("seq")).drop("seq")


@register("src11_kline_pages", f"WITH {TICKS} SELECT symbol, ts_ms, price AS open, price AS high, price AS low, price AS close, 1.0::DOUBLE AS volume, 2.5::DOUBLE AS quote_volume, 7::BIGINT AS trades FROM ticks")
def _(spark, d):
    t = ticks(spark, d)
    p = F.col("price").cast("string")
    row = F.to_json(F.array(F.col("ts_ms").cast("string"), p, p, p, p, F.lit("1"), F.lit("0"), F.lit("2.5"), F.lit("7")))
    pages = t.groupBy("symbol", F.floor(F.col("seq") / 100)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("body")).select("symbol", "body")
    return files.kline_pages(pages)


@register("src12_second_venue_pages", f"WITH {TICKS} SELECT symbol, ts_ms, price AS close, 3.5::DOUBLE AS quote_volume FROM ticks")
def _(spark, d):
    p = F.col("price").cast("string")
    row = F.to_json(F.array(F.col("ts_ms").cast("string"), p, p, p, p, F.lit("1"), F.lit("3.5")))
    pages = ticks(spark, d).select("symbol", F.concat(F.lit('{"result":{"list":['), row, F.lit("]}}")).alias("body"))
    return files.kline_pages(pages, path="$.result.list", quote_at=6, trades_at=None).select("symbol", "ts_ms", "close", "quote_volume")


@register("src13_open_interest_pages", f"WITH {TICKS} SELECT symbol, ts_ms, CASE WHEN seq % 2 = 0 THEN price ELSE price / 2 END AS oi FROM ticks")
def _(spark, d):
    p = F.col("price").cast("string")
    item = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('","singleOpenInterest":"'), p)).otherwise(F.concat(F.lit('","openInterest":"'), p))
    pages = ticks(spark, d).select("symbol", F.concat(F.lit('{"result":{"list":[{"timestamp":"'), "ts_ms", item, F.lit('"}]}}')).alias("body"))
    return files.open_interest_pages(pages).select("symbol", "ts_ms", "oi")


@register("src14_macro_pages", f"WITH {TICKS} SELECT symbol, CASE WHEN seq % 3 = 0 THEN ts_ms ELSE (ts_ms // 1000) * 1000 END AS ts_ms, price AS value FROM ticks")
def _(spark, d):
    k, s, p = F.col("seq") % 3, F.floor(F.col("ts_ms") / 1000).cast("string"), F.col("price").cast("string")
    body = F.when(k == 0, F.concat(F.lit('{"market_caps":[['), "ts_ms", F.lit(","), p, F.lit("]]}"))).when(k == 1, F.concat(F.lit('{"values":[{"x":'), s, F.lit(',"y":'), p, F.lit("}]}"))).otherwise(F.concat(F.lit('{"data":[{"timestamp":"'), s, F.lit('","value":"'), p, F.lit('"}]}')))
    return files.macro_pages(ticks(spark, d).select("symbol", body.alias("body")))


@register("src15_supply_pages", f"WITH {TICKS} SELECT (ts_ms // 86400000) * 86400000 AS ts_ms, round(sum(price), 4) AS value FROM ticks GROUP BY 1")
def _(spark, d):
    day = (F.floor(F.col("ts_ms") / 86_400_000) * 86_400).cast("string")
    v = F.when(F.col("seq") % 2 == 0, F.col("price").cast("string")).otherwise(F.concat(F.lit('{"peggedUSD":'), F.col("price").cast("string"), F.lit("}")))
    pages = ticks(spark, d).select(F.concat(F.lit('[{"date":"'), day, F.lit('","totalCirculating":'), v, F.lit("}]")).alias("body"))
    return files.supply_pages(pages).select("ts_ms", F.round("value", 4).alias("value"))


@register("src16_closed_legs", f"WITH {TICKS} SELECT user_id AS account, upper(symbol) AS symbol, seq::VARCHAR AS order_id, price AS pnl, ts_ms FROM ticks")
def _(spark, d):
    t = ticks(spark, d)
    both = t.unionByName(t.where("seq % 2 = 0"))
    body = F.to_json(F.struct(F.col("seq").cast("string").alias("orderId"), "symbol", F.col("price").cast("string").alias("closedPnl"), F.col("ts_ms").cast("string").alias("updatedTime")))
    return files.closed_legs(both.select(F.col("user_id").alias("account"), body.alias("body"))).select("account", "symbol", "order_id", "pnl", "ts_ms")


@register("src17_fn12_decisions", f"WITH {TICKS} SELECT seq, CASE WHEN seq % 2 = 0 THEN 42.0 ELSE 55.0 END::DOUBLE AS confidence_pct, 1.5::DOUBLE AS risk_pct, seq || ',' || (seq + 1) AS ids FROM ticks WHERE seq % 3 <> 0")
def _(spark, d):
    k = F.col("seq")
    body = F.concat(F.lit('{"action":"'), F.when(k % 3 == 0, "skip").otherwise("Filled"), F.lit('","order_id":"'), k, F.lit('","leg_order_ids":["'), k, F.lit('","'), k + 1, F.lit('"],'), F.when(k % 2 == 0, '"confidence":0.42').otherwise('"meta":{"confidence":55}'), F.lit(',"risk_fraction":0.015}'))
    out = files.decisions(ticks(spark, d).select("seq", body.alias("payload")))
    return out.select("seq", "confidence_pct", F.round("risk_pct", 6).alias("risk_pct"), F.array_join("order_ids", ",").alias("ids"))


@register("src18_time_resolver", "SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS ts_ms FROM orders")
def _(spark, d):
    c = F.col("o_orderkey") % 2
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    from tidebar.functions.scalar import utc_ms

    return read(spark, d, "orders").select("o_orderkey", files.any_time(F.when(c == 0, text).otherwise(utc_ms(F.col("o_orderdate")).cast("string"))).alias("ts_ms"))


@register("src21_risk_tiers", "SELECT n_regionkey::VARCHAR AS symbol, n_nationkey * 1000.0::DOUBLE AS ceiling, coalesce(lag(n_nationkey * 1000.0::DOUBLE) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 0.0) AS floor FROM nation")
def _(spark, d):
    return files.risk_tiers(read(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("symbol"), (F.col("n_nationkey") * 1000.0).alias("ceiling")))


@register("src20_src22_log_fields", "SELECT conv_id, turn, regexp_extract(text, '^(\\S+) (\\S+)', 1) AS first, regexp_extract(text, '^(\\S+) (\\S+)', 2) AS second FROM conversations WHERE regexp_matches(text, '^(\\S+) (\\S+)')")
def _(spark, d):
    return files.fields(read(spark, d, "conversations"), r"^(\S+) (\S+)", ["first", "second"], "text").select("conv_id", "turn", "first", "second")


@register("wn21_last_clean", """WITH l AS (SELECT event_type AS k, event_id AS place, event_id // 2 AS ts_ms, CASE user_id % 3 WHEN 0 THEN 'DECIDE' WHEN 1 THEN 'DATA_UNSAFE' ELSE 'idle' END AS line FROM events),
 n AS (SELECT *, lead(line) OVER w AS nl, lead(ts_ms) OVER w AS nt FROM l WINDOW w AS (PARTITION BY k ORDER BY place)), m AS (SELECT *, line = 'DECIDE' AND NOT coalesce(nl = 'DATA_UNSAFE' AND nt = ts_ms, false) AS clean FROM n),
 c AS (SELECT k, max(place) AS p, arg_max(ts_ms, place) AS t FROM m WHERE clean GROUP BY k) SELECT m.k, max(c.t) AS clean_ts_ms, count(*) FILTER (WHERE line = 'DATA_UNSAFE' AND (c.p IS NULL OR place > c.p)) AS blocks_since FROM m LEFT JOIN c ON c.k = m.k GROUP BY m.k""")
def _(spark, d):
    u = F.col("user_id") % 3
    lines = read(spark, d, "events").select(F.col("event_type").alias("k"), F.col("event_id").alias("place"), F.floor(F.col("event_id") / 2).alias("ts_ms"), F.when(u == 0, "DECIDE").when(u == 1, "DATA_UNSAFE").otherwise("idle").alias("line"))
    return files.last_clean(lines, "k")


def _kept(spark, d):
    """A store of all hourly bars, partitioned by its series key."""
    from tidebar.operators.upsert import Store
    from tidebar.schemas import BARS, KEY, conform
    from tidebar.scratch import scratch_path

    store = Store(spark, scratch_path(spark, "kept"), KEY, BARS)
    store.write(conform(bars(spark, d), BARS))
    return store


@register("src01_store_scan", f"WITH {bars_sql()} SELECT symbol, ts_ms, open, high, low, close, volume FROM bars WHERE symbol = 'view' AND ts_ms BETWEEN 1704500000000 AND 1706000000000")
def _(spark, d):
    """A written store scanned by series and time: the key prunes folders, the range goes to the files."""
    return _kept(spark, d).scan(1_704_500_000_000, 1_706_000_000_000, symbol="view", timeframe="1h").select("symbol", "ts_ms", "open", "high", "low", "close", "volume")


@register("src03_tolerant_scan", f"WITH {bars_sql()} SELECT symbol, ts_ms, close FROM bars WHERE symbol = 'click'")
def _(spark, d):
    """A series that is there, one that is not, and a store that was never written: the last two are empty frames of the schema."""
    from tidebar.operators.upsert import Store
    from tidebar.schemas import BARS, KEY
    from tidebar.scratch import scratch_path

    store = _kept(spark, d)
    never = Store(spark, scratch_path(spark, "nothing"), KEY, BARS)
    return store.scan(symbol="click").unionByName(store.scan(symbol="no such")).unionByName(never.scan(symbol="click")).select("symbol", "ts_ms", "close")


@register("src06_archive_merge", f"WITH {bars_sql('1h', 'm', 'seq % 2 = 0')}, {more_bars('dd', '1h', 'seq % 3 = 0')}, u AS (SELECT *, 0 AS p FROM m UNION ALL SELECT *, 1 AS p FROM dd) SELECT symbol, ts_ms, {_OHLCV} FROM u WHERE ts_ms BETWEEN 1704500000000 AND 1706000000000 QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms ORDER BY p DESC) = 1")
def _(spark, d):
    from tidebar.plans.views import tick_bars

    t = ticks(spark, d)
    out = series.priority_union(tick_bars(t.where("seq % 2 = 0"), "1h"), tick_bars(t.where("seq % 3 = 0"), "1h"))
    return series.drop_junk(out).where("ts_ms BETWEEN 1704500000000 AND 1706000000000").select("symbol", "ts_ms", *_OHLCV.split(", "))


def _with_headers(t, heads: dict[str, list[str]], cells: list):
    """Text rows of a file per symbol, its header first."""
    n = len(cells)
    name = F.concat(F.lit("x_"), "symbol", F.when(F.col("symbol") == "click", "_4h").otherwise(""), F.lit(".csv"))
    body = t.select(name.alias("file"), name.alias("file_path"), (F.col("seq") + 1).alias("place"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    head = t.select("symbol").distinct().select(name.alias("file"), name.alias("file_path"), F.lit(0).cast("long").alias("place"), *[F.when(F.col("symbol") < "m", heads["a"][i]).otherwise(heads["b"][i]).alias(f"c{i}") for i in range(n)])
    return body.unionByName(head)


@register("src07_open_interest_csv", f"WITH {TICKS} SELECT 'x_' || symbol || CASE WHEN symbol = 'click' THEN '_4h' ELSE '' END || '.csv' AS file, ts_ms, price AS oi, price * 2 AS oi_usd FROM ticks WHERE seq % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY symbol, ts_ms ORDER BY seq DESC) = 1")
def _(spark, d):
    p = F.col("price")
    rows = _with_headers(ticks(spark, d), {"a": ["create_time", "sum_open_interest", "sum_open_interest_value"], "b": ["timestamp", "open_interest", "open_interest_value"]}, [F.col("ts_ms").cast("string"), F.when(F.col("seq") % 5 == 0, "bad").otherwise(p.cast("string")), (p * 2).cast("string")])
    return files.open_interest_rows(rows, 3).select("file", "ts_ms", "oi", "oi_usd")


@register("src08_src09_chart_exports", f"WITH {TICKS} SELECT CASE WHEN symbol = 'click' THEN '4h' ELSE '1d' END AS timeframe, (ts_ms // 1000) * 1000 AS ts_ms, CASE WHEN symbol < 'm' THEN price + 1 ELSE price END AS open, price AS close, count(*) AS n FROM ticks GROUP BY ALL")
def _(spark, d):
    p, s = F.col("price"), F.floor(F.col("ts_ms") / 1000).cast("string")
    rows = _with_headers(ticks(spark, d), {"a": ["Time", "Open", "Close"], "b": ["date", "note", "VALUE"]}, [s, (p + 1).cast("string"), p.cast("string")])
    return files.chart_rows(rows, 3).groupBy("timeframe", "ts_ms", "open", "close").agg(F.count("*").alias("n"))


@register("src10_daily_values", "SELECT epoch_us(o_orderdate) // 1000 AS ts_ms, round(sum(round(o_totalprice * 100)::BIGINT) / 100.0::DOUBLE, 2) AS total, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1")
def _(spark, d):
    o = read(spark, d, "orders")
    v = F.when(F.col("o_orderkey") % 4 == 0, ".").otherwise(F.round(F.col("o_totalprice") * 100).cast("long").cast("string"))
    rows = o.select(F.lit("f").alias("file"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("c0"), v.alias("c1"))
    return files.daily_rows(rows).groupBy("ts_ms").agg(F.round(F.sum(F.col("close").cast("long")) / 100.0, 2).alias("total"), F.count("*").alias("n"))


@register("src19_srt08_run_listing", "SELECT l_suppkey % 7 AS strategy_id, l_suppkey AS run_id, count(*) AS trades, max(epoch_us(l_shipdate) // 1000) AS newest_ms FROM lineitem GROUP BY ALL ORDER BY newest_ms DESC, run_id")
def _(spark, d):
    from tidebar.functions.scalar import utc_ms

    runs = read(spark, d, "lineitem")
    out = runs.groupBy((F.col("l_suppkey") % 7).alias("strategy_id"), F.col("l_suppkey").alias("run_id")).agg(F.count("*").alias("trades"), F.max(utc_ms(F.col("l_shipdate"))).alias("newest_ms"))
    return out.orderBy(F.desc("newest_ms"), "run_id")
