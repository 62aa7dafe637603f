"""Who asks for which series: bots of accounts, their labels, and how much history a series needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def account_bots(bots: DataFrame) -> DataFrame:
    """(account, bots): the bots of every account in order. ``bots``: bot, accounts (an array)."""
    pairs = bots.select("bot", F.explode("accounts").alias("account")).distinct()
    return pairs.groupBy("account").agg(F.sort_array(F.collect_set("bot")).alias("bots"))


def labelled(rows: DataFrame, by_account: DataFrame, catalog: DataFrame, none: str = "\u2014") -> DataFrame:
    """``rows`` (account, ...) with ``bot`` and ``label``: an account's only bot, by its title in the catalog, else its name.

    Accounts without a bot or with several have no bot and the label ``none``. ``catalog``: bot, title.
    """
    sole = by_account.where(F.size("bots") == 1).select("account", F.col("bots")[0].alias("bot"))
    out = rows.join(sole, "account", "left").join(catalog.select("bot", "title"), "bot", "left")
    return out.withColumn("label", F.coalesce("title", F.col("bot").cast("string"), F.lit(none))).drop("title")


def history_need(demand: DataFrame, needs: DataFrame, pair: list[str], least: int) -> DataFrame:
    """Bars that every series must hold: the most that one of its bots needs, ``least`` at least. needs: bot, bars."""
    asked = demand.select(*pair, "bot").distinct().join(needs, "bot", "left")
    return asked.groupBy(*pair).agg(F.greatest(F.lit(least), F.coalesce(F.max("bars"), F.lit(0))).alias("bars"), F.count("*").alias("bots"))


def with_timeframes(pairs: DataFrame, extra: list[str]) -> DataFrame:
    """Every series' symbol in its own timeframe and in the ``extra`` ones, once each."""
    every = F.array_distinct(F.concat(F.array("timeframe"), F.array(*map(F.lit, extra))))
    return pairs.withColumn("timeframe", F.explode(every)).distinct()


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``change``: added (only after) or removed (only before)."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))
