"""Readers of landed files: bar archives, open interest, chart exports, macro series, JSON pages, logs.

All read text with explicit schemas in one distributed scan; headers and aliases are settled by
expressions, row by row, so files of several kinds can share a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.functions.scalar import epoch_ms, safe_double
from tidebar.operators.series import drop_junk, last_per_key

TIMEFRAME_IN_NAME = r"(?i)(?:^|[^0-9a-z])(1m|5m|15m|1h|4h|1d|1w)(?:[^0-9a-z]|$)"


def _csv(spark: SparkSession, paths: str | list[str], n: int) -> DataFrame:
    """Rows of at least ``n`` text columns c0, c1, ..., with their file and place."""
    schema = ", ".join(f"c{i} string" for i in range(n))
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(paths).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("place"))


def kline_csv(rows: DataFrame, seq: Column | None = None) -> DataFrame:
    """Bars of an archive: header rows go, microseconds become milliseconds, rows without prices go, last of a time."""
    ts = F.col("c0").try_cast("long")
    ts = F.when(ts > 100_000_000_000_000, F.floor(ts / 1000)).otherwise(ts)
    out = rows.where(F.col("c0").rlike("^[0-9]")).select(
        *[c for c in rows.columns if c not in {f"c{i}" for i in range(6)}], ts.cast("long").alias("ts_ms"), *[safe_double(F.col(f"c{i}")).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)], (seq if seq is not None else F.monotonically_increasing_id()).alias("_seq"),
    )
    out = out.dropna(subset=["ts_ms", "open", "high", "low", "close"])
    keys = [c for c in out.columns if c in ("symbol", "timeframe", "source")]
    return last_per_key(out, [*keys, "ts_ms"], "_seq").drop("_seq")


def read_klines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return kline_csv(_csv(spark, paths, 6), F.col("place")).drop("place")


def read_kline_archive(spark: SparkSession, monthly: list[str], daily: list[str], tail: DataFrame | None, start_ms: int, end_ms: int) -> DataFrame:
    """Monthly and daily archives and a recent tail; later ones win, junk goes, clipped to the range.

    Archives in folders ``symbol=...`` carry that column, and times settle within a symbol.
    """
    parts = [read_klines(spark, p).withColumn("_p", F.lit(k)) for k, p in enumerate((monthly, daily)) if p]
    if tail is not None:
        parts.append(tail.withColumn("_p", F.lit(2)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    keys = [c for c in ("symbol", "timeframe", "source") if c in parts[0].columns]
    out = out.where(F.col("ts_ms").between(start_ms, end_ms))
    return drop_junk(last_per_key(out, [*keys, "ts_ms"], "_p").drop("_p", "file", "file_path"))


def by_header(rows: DataFrame, wanted: dict[str, tuple[str, ...]], n: int, key: str = "file_path") -> DataFrame:
    """Text columns by the names in each file's own header; a file whose first row is no header gives nulls.

    ``wanted`` has the aliases of every column. A header is one row per file, joined back by the file.
    """
    known = {a.lower() for names in wanted.values() for a in names}
    cells = F.array(*[F.lower(F.trim(F.coalesce(f"c{i}", F.lit("")))) for i in range(n)])
    is_head = F.exists(cells, lambda c: c.isin(list(known)))
    heads = rows.where(is_head).select(key, cells.alias("_h")).dropDuplicates([key])
    values = F.array(*[F.col(f"c{i}") for i in range(n)])
    out = rows.where(~is_head).withColumn("_v", values).join(heads, key)
    pick = lambda names: F.coalesce(*[F.try_element_at("_v", F.nullif(F.array_position("_h", a.lower()), F.lit(0)).cast("int")) for a in names])
    return out.select(key, "file", "place", *[pick(names).alias(c) for c, names in wanted.items()])


OI_ALIASES = {"time": ("create_time", "timestamp", "time"), "oi": ("sum_open_interest", "open_interest", "oi"), "oi_usd": ("sum_open_interest_value", "open_interest_value", "oi_usd"), "ls_ratio": ("count_long_short_ratio", "long_short_ratio"), "taker_ratio": ("sum_taker_long_short_vol_ratio", "taker_ratio")}


def any_time(c: Column) -> Column:
    """Milliseconds of a number (ms) or a date and time."""
    return F.coalesce(c.try_cast("long"), epoch_ms(c))


def read_open_interest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return open_interest_rows(_csv(spark, paths, 8), 8)


def open_interest_rows(rows: DataFrame, n: int) -> DataFrame:
    out = by_header(rows, OI_ALIASES, n)
    out = out.select("file", any_time(F.col("time")).alias("ts_ms"), *[safe_double(F.col(c)).alias(c) for c in OI_ALIASES if c != "time"], F.col("place").alias("_seq"))
    return last_per_key(out.where("ts_ms IS NOT NULL AND oi IS NOT NULL"), ["file", "ts_ms"], "_seq").drop("_seq")


CHART_ALIASES = {"time": ("time", "date", "datetime", "timestamp"), "open": ("open",), "high": ("high",), "low": ("low",), "close": ("close", "price", "value"), "volume": ("volume",)}


def read_chart_exports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Chart exports; the timeframe is in the file name (else 1d); open, high and low default to the close.

    A file whose header names no close has it in its last column of numbers (empty cells are numbers).
    """
    return chart_rows(_csv(spark, paths, 8), 8)


def _with_close(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with a further column c<n>: in files whose header names no close, the last column of numbers, headed "close"."""
    known = [a.lower() for names in CHART_ALIASES.values() for a in names]
    cells = [F.lower(F.trim(F.coalesce(f"c{i}", F.lit("")))) for i in range(n)]
    head, named = F.exists(F.array(*cells), lambda c: c.isin(known)), F.exists(F.array(*cells), lambda c: c.isin(*CHART_ALIASES["close"]))
    marked = rows.withColumns({"_head": head, "_named": head & named})
    whole = [F.every(F.col("_head") | (cells[i] == "") | cells[i].try_cast("double").isNotNull()) & F.max(~F.col("_head") & (cells[i] != "")) for i in range(n)]
    last = F.greatest(F.lit(-1), *[F.when(w, i).otherwise(-1) for i, w in enumerate(whole)])
    files = marked.groupBy("file_path").agg(last.alias("_at"), F.max("_named").alias("_has")).where("NOT _has AND _at >= 0").select("file_path", "_at")
    own = F.when(F.col("_at").isNotNull(), F.when(F.col("_head"), "close").otherwise(F.get(F.array(*[F.col(f"c{i}") for i in range(n)]), F.col("_at"))))
    return marked.join(files, "file_path", "left").withColumn(f"c{n}", own).drop("_head", "_named", "_at")


def chart_rows(rows: DataFrame, n: int) -> DataFrame:
    out = by_header(_with_close(rows, n), CHART_ALIASES, n + 1)
    raw = any_time(F.col("time"))
    ts = F.when(raw < 10_000_000_000, raw * 1000).otherwise(raw)
    close = safe_double(F.col("close"))
    tf = F.lower(F.regexp_extract("file", TIMEFRAME_IN_NAME, 1))
    return out.select("file", F.when(tf == "", "1d").otherwise(tf).alias("timeframe"), ts.alias("ts_ms"), *[F.coalesce(safe_double(F.col(c)), close).alias(c) for c in ("open", "high", "low")], close.alias("close"), F.coalesce(safe_double(F.col("volume")), F.lit(0.0)).alias("volume")).where("ts_ms IS NOT NULL AND close IS NOT NULL")


def read_daily_values(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Two columns, date and value, a dot where it is missing, as flat bars."""
    return daily_rows(_csv(spark, paths, 2)).drop("file")


def daily_rows(rows: DataFrame) -> DataFrame:
    rows = rows.select("file", epoch_ms(F.col("c0")).alias("ts_ms"), safe_double(F.nullif("c1", F.lit("."))).alias("v"))
    return rows.where("ts_ms IS NOT NULL AND v IS NOT NULL").select("file", "ts_ms", *[F.col("v").alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"))


def kline_pages(pages: DataFrame, body: str = "body", path: str = "$", quote_at: int = 7, trades_at: int | None = 8) -> DataFrame:
    """Bars of JSON pages that hold arrays of arrays, at ``path``; optional further fields by position."""
    text = F.col(body) if path == "$" else F.get_json_object(body, path)
    rows = pages.select(*[c for c in pages.columns if c != body], F.explode(F.from_json(text, "array<array<string>>")).alias("r"))
    at = lambda i: F.get("r", i)
    out = rows.select(*[c for c in rows.columns if c != "r"], at(0).try_cast("long").alias("ts_ms"), *[safe_double(at(i)).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)], safe_double(at(quote_at)).alias("quote_volume"), (at(trades_at).try_cast("long") if trades_at is not None else F.lit(None).cast("long")).alias("trades"))
    return out.where("ts_ms IS NOT NULL")


def open_interest_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """One-sided open interest is the single value, else half of the total."""
    item = "struct<timestamp:string,singleOpenInterest:string,openInterest:string,sumOpenInterest:string,sumOpenInterestValue:string>"
    text = F.coalesce(F.get_json_object(body, "$.result.list"), F.col(body))
    r = pages.select(*[c for c in pages.columns if c != body], F.explode(F.from_json(text, f"array<{item}>")).alias("r"))
    oi = F.coalesce(safe_double(F.col("r.singleOpenInterest")), safe_double(F.col("r.openInterest")) / 2, safe_double(F.col("r.sumOpenInterest")))
    return r.select(*[c for c in r.columns if c != "r"], F.col("r.timestamp").try_cast("long").alias("ts_ms"), oi.alias("oi"), safe_double(F.col("r.sumOpenInterestValue")).alias("oi_usd")).where("ts_ms IS NOT NULL AND oi IS NOT NULL")


def macro_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """(ts_ms, value) of market caps [[ts, v]], charts [{x, y}] and indexes [{timestamp, value}]; seconds become milliseconds."""
    caps = F.transform(F.from_json(F.get_json_object(body, "$.market_caps"), "array<array<double>>"), lambda x: F.struct(x[0].alias("t"), x[1].alias("v")))
    chart = F.transform(F.from_json(F.get_json_object(body, "$.values"), "array<struct<x:double,y:double>>"), lambda x: F.struct(x["x"].alias("t"), x["y"].alias("v")))
    index = F.transform(F.from_json(F.get_json_object(body, "$.data"), "array<struct<timestamp:string,value:string>>"), lambda x: F.struct(x["timestamp"].try_cast("double").alias("t"), x["value"].try_cast("double").alias("v")))
    rows = pages.select(*[c for c in pages.columns if c != body], F.explode(F.coalesce(caps, chart, index)).alias("r"))
    return rows.select(*[c for c in rows.columns if c != "r"], F.when(F.col("r.t") < 1e10, F.col("r.t") * 1000).otherwise(F.col("r.t")).cast("long").alias("ts_ms"), F.col("r.v").alias("value"))


def supply_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Circulating supply per time over chains; a value is a number or a map of pegs."""
    rows = pages.select(F.explode(F.from_json(F.col(body), "array<struct<date:string,totalCirculating:string>>")).alias("r"))
    pegs = F.from_json("r.totalCirculating", "map<string,double>")
    v = F.coalesce(F.col("r.totalCirculating").try_cast("double"), pegs["peggedUSD"], F.aggregate(F.map_values(pegs), F.lit(0.0), lambda a, x: a + x))
    t = F.col("r.date").try_cast("double")
    return rows.select(F.when(t < 1e10, t * 1000).otherwise(t).cast("long").alias("ts_ms"), v.alias("v")).groupBy("ts_ms").agg(F.sum("v").alias("value"))


def closed_legs(legs: DataFrame, body: str = "body") -> DataFrame:
    """Distinct closed legs by account and the five fields that tell them apart; the usual aliases settled."""
    f = lambda *names: F.coalesce(*[F.get_json_object(body, f"$.{n}") for n in names])
    out = legs.select("account", f("orderId", "order_id").alias("order_id"), F.upper(f("symbol")).alias("symbol"), f("side").alias("side"), safe_double(f("closedSize", "qty")).alias("qty"), safe_double(f("avgEntryPrice", "entry")).alias("entry_price"), safe_double(f("closedPnl", "pnl")).alias("pnl"), f("updatedTime", "createdTime").try_cast("long").alias("ts_ms"))
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("order_id", "ts_ms", "symbol", "pnl", "qty")])
    return out.withColumn("leg_key", key).dropDuplicates(["account", "leg_key"])


def decisions(log: DataFrame, body: str = "payload") -> DataFrame:
    """Entries of a decision log with confidence and risk in %, and all order ids that belong to them."""
    g = lambda p: F.get_json_object(body, p)
    conf = F.coalesce(safe_double(g("$.confidence")), safe_double(g("$.meta.confidence")))
    risk = F.coalesce(safe_double(g("$.risk_pct")), safe_double(g("$.risk_fraction")) * 100)
    ids = F.array_distinct(F.array_compact(F.concat(F.array(g("$.order_id")), F.coalesce(F.from_json(g("$.leg_order_ids"), "array<string>"), F.array().cast("array<string>")))))
    out = log.select(*[c for c in log.columns if c != body], F.lower(g("$.action")).alias("action"), F.when(conf <= 1, conf * 100).otherwise(conf).alias("confidence_pct"), risk.alias("risk_pct"), ids.alias("order_ids"))
    return out.where(F.col("action").isin("filled", "entry", "enter"))


def instruments(pages: DataFrame, body: str = "body") -> DataFrame:
    """Dimension of tradable USDT perpetuals; a number that the venue leaves out has a cautious stand-in."""
    item = "struct<symbol:string,contractType:string,status:string,priceFilter:struct<tickSize:string>,lotSizeFilter:struct<qtyStep:string,minOrderQty:string,maxOrderQty:string,minNotionalValue:string,minOrderAmt:string>,leverageFilter:struct<maxLeverage:string>>"
    kind = F.lower(F.coalesce("r.contractType", F.lit("")))
    r = pages.select(F.explode(F.from_json(F.get_json_object(body, "$.result.list"), f"array<{item}>")).alias("r")).where(F.endswith("r.symbol", F.lit("USDT")) & ((kind == "") | kind.contains("perpetual")))
    d = lambda n, other, *names: F.coalesce(*[safe_double(F.col(f"r.{c}")) for c in names], F.lit(other)).alias(n)
    return r.select(
        F.upper("r.symbol").alias("symbol"), d("tick", 0.01, "priceFilter.tickSize"), d("qty_step", 0.001, "lotSizeFilter.qtyStep"), d("min_qty", 0.001, "lotSizeFilter.minOrderQty"), d("max_qty", 1e9, "lotSizeFilter.maxOrderQty"),
        d("min_notional", 0.0, "lotSizeFilter.minNotionalValue", "lotSizeFilter.minOrderAmt"), d("max_leverage", 100.0, "leverageFilter.maxLeverage"), F.coalesce("r.status", F.lit("")).alias("status"),
    )


def risk_tiers(rows: DataFrame) -> DataFrame:
    """A ladder from its ceilings: every ceiling is the next tier's floor."""
    w = Window.partitionBy("symbol").orderBy("ceiling")
    return rows.withColumn("floor", F.coalesce(F.lag("ceiling").over(w), F.lit(0.0)))


def log_lines(spark: SparkSession, paths: str | list[str], utc: str = r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)") -> DataFrame:
    """Lines of log files with their time and their place in the file."""
    t = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    return t.select("file", F.struct("_at", "_id").alias("place"), epoch_ms(F.nullif(F.regexp_extract("value", utc, 1), F.lit(""))).alias("ts_ms"), F.col("value").alias("line"))


def fields(lines: DataFrame, pattern: str, names: list[str], line: str = "line") -> DataFrame:
    """Lines that match, with the pattern's groups as columns."""
    return lines.where(F.col(line).rlike(pattern)).select("*", *[F.regexp_extract(line, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def last_clean(lines: DataFrame, key: str, decide: str = "DECIDE", block: str = "DATA_UNSAFE") -> DataFrame:
    """Per key the last decision that no block of the same time follows, and the blocks since. lines: key, place, ts_ms, line."""
    w = Window.partitionBy(key).orderBy("place")
    nxt, nxt_ts = F.lead("line").over(w), F.lead("ts_ms").over(w)
    is_decide = F.col("line").contains(decide)
    blocked = F.coalesce(nxt.contains(block) & nxt_ts.eqNullSafe(F.col("ts_ms")), F.lit(False))
    m = lines.withColumn("_clean", is_decide & ~blocked).withColumn("_block", F.col("line").contains(block))
    last = m.where("_clean").groupBy(key).agg(F.max("place").alias("_p"), F.max_by("ts_ms", "place").alias("clean_ts_ms"))
    return m.join(last, key, "left").groupBy(key).agg(F.max("clean_ts_ms").alias("clean_ts_ms"), F.count_if(F.col("_block") & (F.col("_p").isNull() | (F.col("place") > F.col("_p")))).alias("blocks_since"))
