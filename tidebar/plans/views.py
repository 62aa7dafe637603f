"""How the supplied tables stand in for market data, in Spark and as SQL for the comparison.

Events are a tick stream (symbol = event_type, price = value); line items joined to orders are closed
trades (account = supplier, symbol = return flag, side by line status).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.scalar import utc_ms
from tidebar.operators.series import resample
from tidebar.timeframes import STEP_MS, bucket

#: A fixed "now" past the events' month, so that results do not depend on the clock.
NOW_MS = 1_706_745_600_000 - 1_800_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(df: DataFrame, name: str):
    return utc_ms(df[name], dict(df.dtypes)[name] == "timestamp_ntz")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.lit("events").alias("source"), F.col("event_type").alias("symbol"), _ms(e, "ts").alias("ts_ms"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("seq"), "user_id")


TICKS = "ticks AS (SELECT 'events' AS source, event_type AS symbol, (epoch_us(ts) // 1000) AS ts_ms, value AS price, 1.0 AS size, event_id AS seq, user_id FROM events)"


def tick_bars(t: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a tick stream: one shuffle of partial aggregates."""
    at = F.struct("ts_ms", "seq")
    agg = t.where("price IS NOT NULL").groupBy("source", "symbol", bucket(F.col("ts_ms"), STEP_MS[timeframe]).alias("b")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return agg.select("source", "symbol", F.lit(timeframe).alias("timeframe"), F.col("b").alias("ts_ms"), "open", "high", "low", "close", "volume")


def bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    return tick_bars(ticks(spark, sf_dir), timeframe)


def bars_sql(timeframe: str = "1h", name: str = "bars", where: str = "true") -> str:
    s = STEP_MS[timeframe]
    return f"""{TICKS}, {name} AS (
  SELECT source, symbol, '{timeframe}' AS timeframe, (ts_ms // {s}) * {s} AS ts_ms, first(price ORDER BY ts_ms, seq) AS open, max(price) AS high,
         min(price) AS low, last(price ORDER BY ts_ms, seq) AS close, sum(size) AS volume
  FROM ticks WHERE price IS NOT NULL AND {where} GROUP BY source, symbol, (ts_ms // {s}) * {s})"""


def more_bars(name: str, timeframe: str, where: str = "true") -> str:
    """A further bar table in SQL after ``bars_sql``."""
    return bars_sql(timeframe, name, where)[len(TICKS) + 2 :]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades; what a line tells of itself is worked out before the join, in whole numbers, so that fewer and shorter columns are shuffled."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    lines = li.select(
        "l_orderkey", (F.col("l_linenumber") * F.lit(10_000_000_000) + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("_line"), F.col("l_suppkey").alias("account"),
        F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("side"), _ms(li, "l_shipdate").alias("_shipped"), F.col("l_extendedprice").alias("_price"), F.col("l_quantity").alias("qty"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * F.round((F.col("l_discount") - F.col("l_tax")) * 100).cast("long")).alias("_units"),
    )
    placed = o.select("o_orderkey", _ms(o, "o_orderdate").alias("entry_ts_ms"), F.col("o_orderpriority").alias("reason"))
    j = lines.join(placed, lines.l_orderkey == placed.o_orderkey)
    number, pnl = F.col("l_orderkey") * 100_000_000_000 + F.col("_line"), F.col("_units") / F.lit(10000.0)
    return j.select(number.alias("trade_id"), "account", "symbol", "side", "entry_ts_ms", F.greatest("_shipped", "entry_ts_ms").alias("exit_ts_ms"), (F.col("_price") / F.col("qty")).alias("entry_price"), "qty", pnl.alias("pnl"), "reason")


TRADES = """trades AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey AS trade_id, l_suppkey AS account, l_returnflag AS symbol, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS side,
         epoch_ms(o_orderdate) AS entry_ts_ms, greatest(epoch_ms(l_shipdate), epoch_ms(o_orderdate)) AS exit_ts_ms,
         l_extendedprice / l_quantity AS entry_price, l_quantity AS qty, round(l_extendedprice * 100)::BIGINT * round((l_discount - l_tax) * 100)::BIGINT / 10000.0::DOUBLE AS pnl, o_orderpriority AS reason
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def higher(spark: SparkSession, sf_dir: str, timeframe: str) -> DataFrame:
    return resample(bars(spark, sf_dir, "1h"), timeframe)
