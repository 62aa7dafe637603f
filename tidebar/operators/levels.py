"""Stops and targets of trades in signed per cent of the entry, and whether an account always uses the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_percent(price: Column, entry: Column, side: Column, digits: int | None = None) -> Column:
    """How far ``price`` is on the trade's good side of ``entry``, in per cent; null without a positive entry."""
    out = F.when(entry > 0, (price - entry) / entry * 100 * F.when(side < 0, -1.0).otherwise(1.0))
    return out if digits is None else F.round(out, digits)


def level_percents(df: DataFrame, digits: int = 4) -> DataFrame:
    """``df`` with sl_pct and tp_pcts (the ladder in its order) of ``stop_price`` and ``targets`` (an array, null: none)."""
    entry, side = F.col("entry_price"), F.col("side")
    ladder = F.transform(F.coalesce("targets", F.array().cast("array<double>")), lambda p: level_percent(p, entry, side, digits))
    return df.withColumns({"sl_pct": level_percent(F.col("stop_price"), entry, side, digits), "tp_pcts": ladder})


def level_policy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: trades, signatures (distinct stop and ladder), constant, and the levels in words where they are.

    Signatures are counted from a table of distinct ones with partial counts, so a key's trades are never gathered.
    """
    seen = df.groupBy(*keys, "sl_pct", "tp_pcts").agg(F.count("*").alias("n"))
    out = seen.groupBy(*keys).agg(F.sum("n").alias("trades"), F.count("*").alias("signatures"), F.min(F.struct("sl_pct", "tp_pcts")).alias("x"))
    told = F.transform("x.tp_pcts", lambda p, i: F.format_string("TP%d %+.2f%%", i + 1, p))
    words = F.array_join(F.concat(F.array(F.format_string("SL %+.2f%%", "x.sl_pct")), F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("TP (none)")))), "  |  ")
    return out.select(*keys, "trades", "signatures", (F.col("signatures") == 1).alias("constant"), F.when(F.col("signatures") == 1, words).alias("levels"))
