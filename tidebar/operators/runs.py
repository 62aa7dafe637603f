"""Stored runs: tables in hashed buckets sorted by run, a catalog of summaries, and reports.

A run is a range of rows in its bucket's files, not a folder, so that files grow with the data and not with the
number of runs. Bars are kept once by symbol; runs say which symbol they used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.scratch import written

KEY = ["strategy_id", "run_id"]
#: Tables of a run store that are kept by run.
TABLES = ("runs", "trades", "equity")
#: Folders of a table, and the column that names them.
BUCKETS, BUCKET = 64, "bucket_"


def bucket_of(strategy: Column, run: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(strategy.cast("long"), run.cast("long")), F.lit(buckets)).cast("int")


def save_runs(root: str, runs: DataFrame, trades: DataFrame, equity: DataFrame | Callable[[DataFrame], DataFrame], bars: DataFrame, buckets: int = BUCKETS) -> None:
    """Writes the tables under ``root``: runs, trades and equity carry strategy_id and run_id, bars a symbol.

    What a run had in a table is replaced by the batch's rows of it; other runs of its bucket are written again, other buckets stay.
    A bucket's rows are spread by a rebalance, which adaptive execution splits where one run holds much of the input.
    ``equity`` may be a function of the batch's trades, which gets them as they were stored, so that they are worked out once.
    A store keeps its number of buckets. Bars of the batch's symbols are replaced, of others kept.
    """
    spark = runs.sparkSession
    saved = written(runs.select(*KEY).distinct(), "saved-runs")
    for name, df in zip(TABLES, (runs, trades, equity), strict=True):
        if callable(df):
            df = df(spark.read.schema(trades.schema).parquet(f"{root}/trades").join(saved, KEY, "left_semi").select(*trades.columns))
        out = df.withColumn(BUCKET, bucket_of(F.col("strategy_id"), F.col("run_id"), buckets))
        if _exists(spark, f"{root}/{name}"):
            out = written(out, "run-batch")
            touched = [r[0] for r in saved.select(bucket_of(F.col("strategy_id"), F.col("run_id"), buckets)).distinct().collect()]  # at most ``buckets``
            old = spark.read.schema(out.schema).parquet(f"{root}/{name}").where(F.col(BUCKET).isin(touched))
            out = written(old.join(saved, KEY, "left_anti").unionByName(out), "run-buckets")
        order = [BUCKET, *KEY]
        _overwrite(out.hint("rebalance", BUCKET).sortWithinPartitions(*order), f"{root}/{name}", BUCKET)
    _overwrite(bars.hint("rebalance", "symbol").sortWithinPartitions("symbol", "ts_ms"), f"{root}/bars", "symbol")


def _overwrite(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the store, ``schema`` (DDL) being that of its rows."""
    if name not in (*TABLES, "bars"):
        raise ValueError(f"no such table: {name}")
    by = "" if name == "bars" else f", {BUCKET} int"
    return spark.read.schema(schema + by).parquet(f"{root}/{name}").drop(BUCKET)


def one_run(spark: SparkSession, root: str, name: str, schema: str, strategy: int, run: int, buckets: int = BUCKETS) -> DataFrame:
    """A run's rows of a table: one folder is listed, and files and row groups are skipped by the run's place in their order."""
    rows = spark.read.schema(f"{schema}, {BUCKET} int").parquet(f"{root}/{name}")
    return rows.where((F.col(BUCKET) == bucket_of(F.lit(strategy), F.lit(run), buckets)) & (F.col("strategy_id") == strategy) & (F.col("run_id") == run)).drop(BUCKET)


def catalog(runs: DataFrame, trades: DataFrame, equity: DataFrame) -> DataFrame:
    """One summary row per stored run, without its trades and curve: counts, result, last equity and newest time.

    Runs without trades or curve stay, with 0 trades and the starting equity.
    """
    t = trades.groupBy(*KEY).agg(F.count("*").alias("n_trades"), F.sum("pnl").alias("net"), F.max("exit_ts_ms").alias("newest_ms"), F.min_by("symbol", F.struct("exit_ts_ms", "trade_id")).alias("symbol"))
    e = equity.groupBy(*KEY).agg(F.max_by("equity", F.struct("ts_ms", "trade_id")).alias("ending_equity"))
    out = runs.join(t, KEY, "left").join(e, KEY, "left")
    return out.withColumns({
        "n_trades": F.coalesce("n_trades", F.lit(0)),
        "net": F.coalesce("net", F.lit(0.0)),
        "ending_equity": F.coalesce("ending_equity", "starting_equity"),
    })


def listing(runs: DataFrame, strategy: int | None = None) -> DataFrame:
    """Catalog rows, newest first; of one strategy if asked."""
    rows = runs if strategy is None else runs.where(F.col("strategy_id") == strategy)
    return rows.orderBy(F.desc_nulls_last("newest_ms"), "run_id")


def write_reports(root: str, trades: DataFrame, equity: DataFrame, metrics: DataFrame, strategy: DataFrame | None = None, meta: DataFrame | None = None, buckets: int | None = None) -> None:
    """Reports by run: trades and equity as CSV with a header; metrics, strategy and meta as JSON with infinities and NaN as texts.

    Every run gets a folder of its own under each name, which suits a few runs. With ``buckets`` the runs of a hashed bucket share
    a folder, in the order of runs and with their keys as columns, so that files grow with the data and not with the
    number of runs; ``one_report`` reads a run's part.
    """

    def save(df: DataFrame, name: str, kind: str) -> None:
        if buckets:
            df = df.withColumn(BUCKET, bucket_of(F.col("strategy_id"), F.col("run_id"), buckets)).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *KEY)
        else:
            df = df.hint("rebalance", *KEY)
        df.write.mode("overwrite").partitionBy(*([BUCKET] if buckets else KEY)).option("header", True).format(kind).save(f"{root}/{name}")

    for name, df in (("trades", trades), ("equity", equity)):
        save(df, name, "csv")
    for name, df in (("metrics", metrics), ("strategy", strategy), ("meta", meta)):
        if df is not None:
            safe = {c: F.when(F.isnan(c), None).when(F.col(c) == float("inf"), "inf").when(F.col(c) == float("-inf"), "-inf").otherwise(F.col(c).cast("string")) for c, t in df.dtypes if t == "double"}
            save(df.withColumns(safe), name, "json")


def reports(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """All runs' rows of one file of the reports that ``write_reports`` put into buckets, ``schema`` (DDL) being that of its rows."""
    rows = spark.read.schema(f"{schema}, {BUCKET} int")
    return (rows.option("header", True).option("enforceSchema", False).csv if name in ("trades", "equity") else rows.json)(f"{root}/{name}")


def one_report(spark: SparkSession, root: str, name: str, schema: str, strategy: int, run: int, buckets: int = BUCKETS) -> DataFrame:
    """A run's rows of one file of its report: one folder is read."""
    own = (F.col(BUCKET) == bucket_of(F.lit(strategy), F.lit(run), buckets)) & (F.col("strategy_id") == strategy) & (F.col("run_id") == run)
    return reports(spark, root, name, schema).where(own).drop(BUCKET)
