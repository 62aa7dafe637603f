"""Order arithmetic as column expressions: size, legs, fills, leverage, liquidation, open positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalar import round_grid


def min_executable(min_qty: Column, min_notional: Column, price: Column, step: Column) -> Column:
    return F.when(price <= 0, float("inf")).otherwise(round_grid(F.greatest(min_qty, min_notional / price), step, "ceil"))


def desired_qty(mode: Column, p: dict[str, Column]) -> Column:
    """Quantity asked for, before any rounding; a signal's own quantity or notional goes first; null where it can't be told.

    ``p``: signal_qty, signal_notional, price, stop_price, equity, size_mult, fixed_qty, fixed_notional,
    equity_fraction, leverage, risk_fraction, fixed_risk_cash, min_executable.
    """
    price, mult = p["price"], p["size_mult"]
    risk = F.nullif(F.abs(price - p["stop_price"]), F.lit(0.0))
    lev = F.when(p["leverage"] > 0, p["leverage"]).otherwise(1.0)
    by_mode = (
        F.when(mode == "fixed_qty", p["fixed_qty"] * mult)
        .when(mode == "fixed_notional", p["fixed_notional"] * mult / price)
        .when(mode == "min_exchange", p["min_executable"] * mult)
        .when((mode == "equity_leverage_notional") & (p["equity"] > 0) & (p["equity_fraction"] > 0), p["equity"] * p["equity_fraction"] * lev * mult / price)
        .when(mode == "risk_fraction", p["equity"] * p["risk_fraction"] * mult / risk)
        .when(mode == "fixed_risk_cash", p["fixed_risk_cash"] * mult / risk)
    )
    return F.when(mult > 0, F.coalesce(p["signal_qty"] * mult, p["signal_notional"] * mult / price, by_mode))


def normalise_order(df: DataFrame, max_risk: float | None = None, buffer: float = 1.0) -> DataFrame:
    """Adds ``qty`` and ``skip`` to orders (raw_qty, price, stop_price, equity, min_qty, max_qty, min_notional, qty_step).

    The order of checks is the contract: the venue's least order is held against the risk cap before
    anything is rounded.
    """
    c = F.col
    risk = F.abs(c("price") - c("stop_price"))
    capped = F.lit(max_risk is not None) & c("stop_price").isNotNull() & (risk > 0)
    cash = c("equity") * F.lit(max_risk or 0.0)
    # each quantity on the grid is a column of its own, so that its expression is evaluated once
    out = df.withColumns({
        "_least": min_executable(c("min_qty"), c("min_notional"), c("price"), c("qty_step")) * max(1.0, buffer),
        "_floor": round_grid(c("raw_qty"), c("qty_step")),
        "_most": round_grid(cash / risk, c("qty_step")),
    })
    out = out.withColumn("_qty", F.when(capped & (c("_floor") > c("_most")), c("_most")).otherwise(c("_floor")))
    bad = c("raw_qty").isNull() | F.isnan("raw_qty") | (F.abs("raw_qty") == float("inf")) | (c("raw_qty") <= 0)
    skip = (
        F.when(bad, "qty_rounds_to_zero")
        .when(capped & (c("_least") * risk > cash + 1e-12), "min_qty_exceeds_risk_cap")
        .when(c("_floor") <= 0, "qty_rounds_to_zero")
        .when(c("_qty") < c("min_qty") - 1e-12, "below_min_qty")
        .when(c("_qty") > c("max_qty"), "above_max_qty")
        .when(c("_qty") * c("price") < c("min_notional") - 1e-12, "below_min_notional")
    )
    out = out.withColumn("skip", skip)
    return out.withColumn("qty", F.when(c("skip").isNull(), c("_qty")).otherwise(0.0)).drop("_least", "_floor", "_most", "_qty")


def split_legs(df: DataFrame, fractions: list[float]) -> DataFrame:
    """Adds ``legs``, parts of ``qty`` on the step grid of which the last takes the rest, and ``problem``."""
    step, qty = F.col("qty_step"), F.col("qty")
    names = [f"_l{i}" for i in range(len(fractions) - 1)]
    out = df.withColumns({n: round_grid(qty * f, step) for n, f in zip(names, fractions[:-1], strict=True)}) if names else df
    used = F.lit(0.0)
    for n in names:
        used = used + F.col(n)
    out = out.withColumn("_rest", qty - used)
    out = out.withColumn("_last", round_grid(F.col("_rest"), step))
    more = F.col("_rest") - F.col("_last")
    last = F.when(more > step * 0.5, round_grid(F.col("_rest"), step)).otherwise(F.col("_last"))
    out = out.withColumn("legs", F.array(*map(F.col, names), last)).drop(*names, "_rest", "_last")
    zero, small = F.exists("legs", lambda x: x <= 0), F.exists("legs", lambda x: x < F.col("min_qty") - 1e-12)
    return out.withColumn("problem", F.when(zero, "rounds_to_zero").when(small, "below_min_qty"))


def fill(df: DataFrame, slippage: float, maker: float, taker: float) -> DataFrame:
    """Adds fill price (moved against the trader, then to the tick), notional, fee and slippage cost. Columns: side, ref_price, qty, tick, role."""
    side, ref = F.col("side"), F.col("ref_price")
    moved = ref * (1 + side * slippage)
    price = F.when(side > 0, round_grid(moved, F.col("tick"), "ceil")).otherwise(round_grid(moved, F.col("tick"), "floor"))
    out = df.withColumn("price", price).withColumn("notional", F.abs(F.col("qty") * F.col("price")))
    rate = F.when(F.col("role") == "maker", maker).otherwise(taker)
    return out.withColumn("fee", F.col("notional") * rate).withColumn("slippage_cost", F.abs("qty") * F.abs(F.col("price") - ref))


def limit_price(side: Column, ref: Column, tick: Column, price: Column, offset: Column) -> Column:
    """Passive limit: the absolute price, else an offset on the passive side, else the reference; rounded passively."""
    raw = F.coalesce(price, ref * (1 - side * F.abs(offset)), ref)
    return F.when(side > 0, round_grid(raw, tick, "floor")).otherwise(round_grid(raw, tick, "ceil"))


def limit_would_cross(side: Column, ref: Column, limit: Column) -> Column:
    """Whether a limit lies beyond the reference, so that it would take liquidity."""
    return F.when(side > 0, limit > ref + 1e-15).otherwise(limit < ref - 1e-15)


def limit_touched(side: Column, high: Column, low: Column, limit: Column) -> Column:
    """Whether a bar's range reaches a resting limit."""
    return F.when(side > 0, low <= limit + 1e-12).otherwise(high >= limit - 1e-12)


def leverage_from_stop(entry: Column, stop: Column, buffers: float, most: Column) -> Column:
    denom = F.abs(entry - stop) / entry + buffers
    return F.when(denom <= 0, most).otherwise(F.greatest(F.lit(1.0), F.least(F.floor(1 / denom).cast("double"), most)))


def liquidation_price(side: Column, entry: Column, qty: Column, margin: Column, mm_rate: Column, deduction: Column, close_fee: Column, tick: Column | None = None) -> Column:
    """Price at which equity meets the maintenance margin, on the tick nearer the entry if there is one; null if price alone cannot get there."""
    long_d = qty * (1 - mm_rate - close_fee)
    long_p = F.when(long_d > 0, (qty * entry - margin - deduction) / long_d)
    short_p = (qty * entry + margin + deduction) / (qty * (1 + mm_rate + close_fee))
    p = F.when(side > 0, long_p).otherwise(short_p)
    p = F.when((qty > 0) & (entry > 0) & (p > 0), p)
    if tick is None:
        return p
    return F.when(tick > 0, F.when(side > 0, round_grid(p, tick, "ceil")).otherwise(round_grid(p, tick, "floor"))).otherwise(p)


def maintenance_margin(qty: Column, price: Column, mm_rate: Column, deduction: Column) -> Column:
    return F.greatest(F.lit(0.0), F.abs(qty * price) * mm_rate - deduction)


def stop_inside_liquidation(side: Column, stop: Column, liquidation: Column) -> Column:
    """Whether the stop comes before the liquidation price; true where there is no stop or no such price."""
    return stop.isNull() | liquidation.isNull() | (side * stop > side * liquidation)


def tier_lookup(df: DataFrame, tiers: DataFrame, notional: str = "notional") -> DataFrame:
    """Each row with the tier whose floor is the largest at or below its notional; below all, the first.

    ``tiers`` (symbol, floor, ...) is a ladder of a few rows a symbol, kept as one array each.
    """
    own = [c for c in tiers.columns if c != "symbol"]
    ladder = tiers.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("floor", *[c for c in own if c != "floor"]))).alias("_t"))
    out = df.join(F.broadcast(ladder), "symbol", "left")  # by symbol alone, a symbol would be one task
    hit = F.coalesce(F.try_element_at(F.filter("_t", lambda t: t["floor"] <= F.col(notional)), F.lit(-1)), F.try_element_at("_t", F.lit(1)))
    return out.withColumn("_h", hit).select(*df.columns, *[F.col(f"_h.{c}").alias(f"tier_{c}") for c in own])


def position_view(df: DataFrame) -> DataFrame:
    """Open positions with the way to target and stop in % of the mark, which is nearer, and when this cycle opened.

    Both ways are positive while the price still has to move there, for either side; the target is nearer at ties.
    Levels and marks that are not positive are missing, a missing mark is the entry price. The opening time is
    the first positive of open_time and opened_at_ms, where there: created_ms is of the symbol's first position ever.
    """
    side = F.col("side")
    level = lambda c: F.when(F.col(c) > 0, F.col(c))
    mark = F.coalesce(level("mark_price"), level("entry_price")) if "entry_price" in df.columns else level("mark_price")
    tp, sl = side * (level("take_profit") - mark) / mark * 100, side * (mark - level("stop_loss")) / mark * 100
    near = F.when(tp.isNull() & sl.isNull(), None).when(sl.isNull() | (F.abs(tp) <= F.abs(sl)), "tp").otherwise("sl")
    opened = [level(c) for c in ("open_time", "opened_at_ms") if c in df.columns]
    return df.withColumns({"tp_pct": tp, "sl_pct": sl, "nearer": near, "opened_ms": F.coalesce(*opened) if opened else F.lit(None).cast("long")})
