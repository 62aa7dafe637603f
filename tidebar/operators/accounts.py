"""Accounts seen on several hosts: normalised trades, one row per account, fleet totals, rows per bot and pair.

Everything that grows with trades is an aggregate or a join on the account; arrays hold hosts, bots and
labels, of which an account has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.scalar import finite

NONE = "—"
#: Which fields tell one trade of an account from another.
TRADE_KEY = ["order_id", "updated_ms", "symbol", "pnl"]


def normalised_trades(rows: DataFrame, body: str = "body") -> DataFrame:
    """Closed trades of JSON texts as 17 typed columns under stable names, besides the other columns of ``rows``.

    Where a trade carries a field under several names the first that is there counts; 0 is a value for
    prices and results, but not for times, sizes and fees, as venues send it there for "unknown".
    """
    names = ["orderId", "order_id", "symbol", "side", "qty", "closedSize", "closed_size", "avgEntryPrice", "entry", "avgExitPrice", "exit", "closedPnl", "pnl", "leverage", "orderType", "execType",
             "openFee", "cumEntryFee", "closeFee", "cumExitFee", "fillCount", "createdTime", "created_ms", "updatedTime", "updated_ms", "leg_count"]
    words = {"orderId", "order_id", "symbol", "side", "orderType", "execType"}
    rows = rows.withColumn("_j", F.from_json(body, ", ".join(f"{n} string" for n in names)))
    # every number is read once, in a column of its own, as several of the stable names ask for it
    rows = rows.withColumns({f"_n_{n}": F.col(f"_j.{n}").try_cast("double") for n in names if n not in words}).withColumns({f"_n_{n}": finite(F.col(f"_n_{n}")) for n in names if n not in words})
    text = lambda *names: F.coalesce(*[F.col(f"_j.{n}") for n in names])
    number = lambda *names: F.coalesce(*[F.col(f"_n_{n}") for n in names])
    some = lambda *names: F.coalesce(*[F.nullif(F.col(f"_n_{n}"), F.lit(0.0)) for n in names])
    when = lambda *names: some(*names).cast("long")
    columns = {
        "order_id": text("orderId", "order_id"),
        "symbol": F.upper(F.coalesce(text("symbol"), F.lit(""))),
        "side": text("side"),
        "qty": number("qty", "closedSize"),
        "closed_size": F.coalesce(some("closedSize", "closed_size"), number("qty")),
        "entry": number("avgEntryPrice", "entry"),
        "exit": number("avgExitPrice", "exit"),
        "pnl": number("closedPnl", "pnl"),
        "leverage": number("leverage"),
        "order_type": text("orderType"),
        "exec_type": text("execType"),
        "open_fee": F.coalesce(some("openFee"), number("cumEntryFee")),
        "close_fee": F.coalesce(some("closeFee"), number("cumExitFee")),
        "fill_count": number("fillCount").cast("long"),
        "created_ms": when("createdTime", "created_ms"),
        "updated_ms": F.nullif(number("updatedTime", "updated_ms", "createdTime", "created_ms").cast("long"), F.lit(0).cast("long")),
        "leg_count": F.coalesce(when("leg_count"), F.lit(1).cast("long")),
    }
    return rows.select(*[c for c in rows.columns if c not in columns and c not in (body, "_j") and not c.startswith("_n_")], *[v.alias(c) for c, v in columns.items()])


def merge_accounts(snaps: DataFrame, wallet: list[str], seq: str = "snap_seq") -> DataFrame:
    """One row per account from the snapshots of its hosts.

    ``snaps``: account, ``seq`` (their order), host, bots (array), equity and the columns of ``wallet``. Hosts and
    bots are united in the order of their first snapshot. The wallet is that of the highest equity so far at
    every snapshot, the later of equal ones; a column that it lacks keeps its former value. A missing equity
    counts as 0; snapshots without an account are left out.
    """
    rows = snaps.where(F.col("account").cast("string") != "")
    before = Window.partitionBy("account").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    worth = F.coalesce("equity", F.lit(0.0))
    rows = rows.withColumn("_best", F.max(worth).over(before)).withColumn("_taken", F.col("_best").isNull() | (worth >= F.col("_best")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(c).alias("v")))), lambda x: x["v"])
    kept = lambda c: F.max_by(F.col(c), F.when(F.col("_taken") & F.col(c).isNotNull(), F.col(seq))).alias(c)
    return rows.groupBy("account").agg(
        F.array_distinct(F.array_compact(in_order("host"))).alias("hosts"),
        F.array_distinct(F.flatten(F.array_compact(in_order("bots")))).alias("bots"),
        *[kept(c) for c in ["equity", *wallet]],
    )


def merge_trades(trades: DataFrame, seq: str = "snap_seq") -> DataFrame:
    """Trades of an account that several hosts report, once each: the row of the first snapshot stays.

    Nulls are equal here, as two hosts leave out the same fields.
    """
    keys = ["account", *TRADE_KEY]
    own = [c for c in trades.columns if c not in keys]
    first = trades.groupBy(*keys).agg(F.min_by(F.struct(*own), F.struct(seq, *[c for c in own if c != seq])).alias("_t"))
    return first.select(*keys, "_t.*").select(*trades.columns)


def fleet_totals(accounts: DataFrame) -> DataFrame:
    """Sums over all accounts (n_trades, n_open, realized_pnl, open_upl, equity); what is missing counts as 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return accounts.agg(
        F.count("*").alias("n_accounts"), total("n_trades").alias("n_trades"), total("n_open").alias("n_open_positions"), total("realized_pnl").alias("realized_pnl"),
        total("open_upl").alias("open_upl"), (total("realized_pnl") + total("open_upl")).alias("combined"), total("equity").alias("equity"),
    )


def pair_rows(coins: DataFrame, bots: DataFrame, assigned: DataFrame) -> DataFrame:
    """A row for every bot and pair that traded, with ``bot``, its ``label`` and ``trades_per_day``.

    ``coins``: host, account, symbol, n_trades, days_active, ...; ``bots``: host, account, bot, label; ``assigned``: host,
    account, bot, symbol. A pair that no bot is assigned to goes to the account's only bot, else to none.
    """
    at = ["host", "account"]
    traded = coins.where("n_trades >= 1").withColumn("symbol", F.upper("symbol"))
    named = bots.dropDuplicates([*at, "bot"])
    wanted = assigned.select(*at, "bot", F.upper("symbol").alias("symbol")).distinct().join(named, [*at, "bot"])
    mine = traded.join(wanted, [*at, "symbol"])
    sole = named.groupBy(*at).agg(F.count("*").alias("_n"), F.min("bot").alias("bot"), F.min("label").alias("label")).where("_n = 1").drop("_n")
    rest = traded.join(wanted, [*at, "symbol"], "left_anti").join(sole, at, "left")
    out = mine.unionByName(rest).withColumn("label", F.coalesce("label", F.col("bot").cast("string"), F.lit(NONE)))
    days = F.col("days_active").cast("double")
    return out.withColumn("trades_per_day", F.when(days > 0, F.round(F.col("n_trades") / days, 3)))


def run_totals(trades: DataFrame, keys: list[str], is_entry_bar: Column, is_ambiguous: Column) -> DataFrame:
    """Per run: counts, rates, totals of fees, funding and slippage, liquidations, and the warnings that the rates call for.

    ``trades``: side, reason, fees, funding, slippage_cost, pnl. Above a quarter of exits on the entry bar a stop lies inside one
    bar's noise; above a tenth of ambiguous bars the convention decides, not the data.
    """
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n = F.count("*")
    early, unclear = count(is_entry_bar) / n, count(is_ambiguous) / n
    warn = F.array_compact(F.array(F.when(early > 0.25, "entry_bar_exits"), F.when(unclear > 0.1, "ambiguous_bars")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return trades.groupBy(*keys).agg(
        n.alias("n_trades"), early.alias("entry_bar_exit_rate"), unclear.alias("ambiguous_rate"), count(F.col("reason").startswith("liquidation")).alias("n_liquidations"),
        total("fees").alias("total_fees"), total("funding").alias("total_funding"), total("slippage_cost").alias("total_slippage"), total("pnl").alias("total_pnl"),
        count(F.col("side") > 0).alias("n_longs"), count(F.col("side") < 0).alias("n_shorts"), warn.alias("warnings"),
    )
