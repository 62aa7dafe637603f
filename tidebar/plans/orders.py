"""Order arithmetic queries: line items stand for orders and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import orders as od
from tidebar.plans.registry import register
from tidebar.plans.views import TRADES, read, trades



def _orders(spark, d):
    c = F.col
    t = trades(spark, d)
    return t.select("trade_id", "symbol", "side", (c("qty") / 7).alias("raw_qty"), c("entry_price").alias("price"), (c("entry_price") * (1 - c("side") * 0.02)).alias("stop_price"), F.lit(50_000.0).alias("equity"), F.lit(0.5).alias("min_qty"), F.lit(6.0).alias("max_qty"), F.lit(900.0).alias("min_notional"), F.lit(0.25).alias("qty_step"), "qty")


def _symbols(spark, d):
    """The symbols that lines have, without the join that makes trades of them."""
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol")).distinct()


_STEP = "(floor({x} / 0.25 + 1e-9 * greatest(1, abs({x} / 0.25))) * 0.25)"
_OSQL = f"""{TRADES}, o AS (SELECT trade_id, symbol, side, qty, qty / 7 AS raw_qty, entry_price AS price, entry_price * (1 - side * 0.02::DOUBLE) AS stop_price FROM trades),
 s AS (SELECT *, abs(price - stop_price) AS risk, ceil(greatest(0.5, 900 / price) / 0.25 - 1e-9 * greatest(1, abs(greatest(0.5, 900 / price) / 0.25))) * 0.25 AS least_, {_STEP.format(x='raw_qty')} AS fl FROM o),
 c AS (SELECT *, {_STEP.format(x='(500.0::DOUBLE / risk)')} AS most FROM s), k AS (SELECT *, CASE WHEN fl > most THEN most ELSE fl END AS q FROM c),
 n AS (SELECT *, CASE WHEN raw_qty <= 0 THEN 'qty_rounds_to_zero' WHEN least_ * risk > 500 + 1e-12 THEN 'min_qty_exceeds_risk_cap' WHEN fl <= 0 THEN 'qty_rounds_to_zero' WHEN q < 0.5 - 1e-12 THEN 'below_min_qty' WHEN q > 6 THEN 'above_max_qty' WHEN q * price < 900 - 1e-12 THEN 'below_min_notional' END AS skip FROM k)"""


@register("pf13_normalise_order", f"WITH {_OSQL} SELECT trade_id, skip, round(CASE WHEN skip IS NULL THEN q ELSE 0 END, 6) AS qty FROM n")
def _(spark, d):
    return od.normalise_order(_orders(spark, d).drop("qty"), max_risk=0.01).select("trade_id", "skip", F.round("qty", 6).alias("qty"))


_MODES = ["fixed_qty", "fixed_notional", "min_exchange", "equity_leverage_notional", "risk_fraction", "fixed_risk_cash"]


@register("pf13_desired_qty", f"""WITH {_OSQL} SELECT trade_id, round(CASE WHEN trade_id % 7 = 6 THEN 3.0::DOUBLE ELSE CASE trade_id % 6 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1000 / price WHEN 2 THEN least_ WHEN 3 THEN 50000 * 0.1::DOUBLE * 3 / price WHEN 4 THEN 50000 * 0.01::DOUBLE / risk ELSE 250 / risk END END, 5) AS qty FROM n""")
def _(spark, d):
    o, c, lit = _orders(spark, d), F.col, F.lit
    mode = F.element_at(F.array(*map(lit, _MODES)), (c("trade_id") % 6 + 1).cast("int"))
    p = {"signal_qty": F.when(c("trade_id") % 7 == 6, 3.0), "signal_notional": lit(None).cast("double"), "price": c("price"), "stop_price": c("stop_price"), "equity": c("equity"), "size_mult": lit(1.0), "fixed_qty": lit(2.0), "fixed_notional": lit(1000.0), "equity_fraction": lit(0.1), "leverage": lit(3.0), "risk_fraction": lit(0.01), "fixed_risk_cash": lit(250.0)}
    p["min_executable"] = od.min_executable(c("min_qty"), c("min_notional"), c("price"), c("qty_step"))
    return o.select("trade_id", F.round(od.desired_qty(mode, p), 5).alias("qty"))


@register("pf14_split_legs", f"""WITH {TRADES}, a AS (SELECT trade_id, qty, {_STEP.format(x='(qty * 0.5)')} AS l1, {_STEP.format(x='(qty * 0.3::DOUBLE)')} AS l2 FROM trades), b AS (SELECT *, {_STEP.format(x='(qty - l1 - l2)')} AS l3 FROM a)
SELECT trade_id, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3, CASE WHEN least(l1, l2, l3) <= 0 THEN 'rounds_to_zero' WHEN least(l1, l2, l3) < 0.5 - 1e-12 THEN 'below_min_qty' END AS problem FROM b""")
def _(spark, d):
    out = od.split_legs(_orders(spark, d), [0.5, 0.3, 0.2])
    return out.select("trade_id", *[F.round(F.element_at("legs", i), 6).alias(f"l{i}") for i in (1, 2, 3)], "problem")


@register("pf15_fill", f"""WITH {TRADES}, p AS (SELECT *, CASE WHEN side > 0 THEN ceil(entry_price * 1.0005::DOUBLE / 0.1 - 1e-9 * greatest(1, abs(entry_price * 1.0005::DOUBLE / 0.1))) ELSE floor(entry_price * 0.9995::DOUBLE / 0.1 + 1e-9 * greatest(1, abs(entry_price * 0.9995::DOUBLE / 0.1))) END * 0.1::DOUBLE AS price FROM trades)
SELECT trade_id, round(price, 1) AS price, round(abs(qty * round(price, 1)) * CASE WHEN trade_id % 2 = 0 THEN 0.0002 ELSE 0.0006 END, 6) AS fee, round(qty * abs(round(price, 1) - entry_price), 5) AS slippage_cost FROM p""")
def _(spark, d):
    t = trades(spark, d).select("trade_id", "side", F.col("entry_price").alias("ref_price"), "qty", F.lit(0.1).alias("tick"), F.when(F.col("trade_id") % 2 == 0, "maker").otherwise("taker").alias("role"))
    return od.fill(t, 0.0005, 0.0002, 0.0006).select("trade_id", F.round("price", 1).alias("price"), F.round("fee", 6).alias("fee"), F.round("slippage_cost", 5).alias("slippage_cost"))


@register("pf16_position_risk", f"""WITH {TRADES}, x AS (SELECT *, qty * entry_price / 10 AS margin FROM trades)
SELECT trade_id, greatest(1.0, least(floor(1 / (abs(entry_price - entry_price * (1 - side * 0.03::DOUBLE)) / entry_price + 0.015)), 20.0)) AS leverage,
 round(CASE WHEN side > 0 THEN (qty * entry_price - margin) / (qty * (1 - 0.005 - 0.0006::DOUBLE)) ELSE (qty * entry_price + margin) / (qty * (1 + 0.005 + 0.0006::DOUBLE)) END, 5) AS liquidation FROM x""")
def _(spark, d):
    c, lit = F.col, F.lit
    stop = c("entry_price") * (1 - c("side") * 0.03)
    return trades(spark, d).select("trade_id", od.leverage_from_stop(c("entry_price"), stop, 0.015, lit(20.0)).alias("leverage"), F.round(od.liquidation_price(c("side"), c("entry_price"), c("qty"), c("qty") * c("entry_price") / 10, lit(0.005), lit(0.0), lit(0.0006)), 5).alias("liquidation"))


@register("jn20_tier_lookup", f"""WITH {TRADES} SELECT trade_id, CASE WHEN qty * entry_price >= 60000 THEN 3 WHEN qty * entry_price >= 20000 THEN 2 ELSE 1 END AS tier_level FROM trades""")
def _(spark, d):
    t = trades(spark, d).withColumn("notional", F.col("qty") * F.col("entry_price"))
    ladder = _symbols(spark, d).select("symbol", F.explode(F.array(*[F.struct(F.lit(f).alias("floor"), F.lit(k).alias("level")) for k, f in ((1, 1000.0), (2, 20_000.0), (3, 60_000.0))])).alias("x")).select("symbol", "x.*")
    return od.tier_lookup(t, ladder).select("trade_id", "tier_level")


@register("pf11_open_positions", f"""WITH {TRADES}, x AS (SELECT trade_id, side, CASE WHEN trade_id % 7 = 0 THEN entry_price ELSE entry_price * 1.01::DOUBLE END AS mark, CASE WHEN trade_id % 3 > 0 THEN entry_price * (1 + side * 0.05::DOUBLE) END AS tp, CASE WHEN trade_id % 3 < 2 THEN entry_price * (1 - side * 0.02::DOUBLE) END AS sl,
  CASE trade_id % 4 WHEN 0 THEN NULL WHEN 1 THEN exit_ts_ms ELSE entry_ts_ms END AS opened_ms FROM trades),
 y AS (SELECT trade_id, opened_ms, round((CASE WHEN side > 0 THEN tp - mark ELSE mark - tp END) / mark * 100, 6) AS tp_pct, round((CASE WHEN side > 0 THEN mark - sl ELSE sl - mark END) / mark * 100, 6) AS sl_pct FROM x)
SELECT *, CASE WHEN tp_pct IS NULL AND sl_pct IS NULL THEN NULL WHEN sl_pct IS NULL OR abs(tp_pct) <= abs(sl_pct) THEN 'tp' ELSE 'sl' END AS nearer FROM y""")
def _(spark, d):
    c, k, q = F.col, F.col("trade_id") % 3, F.col("trade_id") % 4
    t = trades(spark, d).select(
        "trade_id", "side", "entry_price", F.when(c("trade_id") % 7 == 0, 0.0).otherwise(c("entry_price") * 1.01).alias("mark_price"),
        F.when(k > 0, c("entry_price") * (1 + c("side") * 0.05)).otherwise(0.0).alias("take_profit"), F.when(k < 2, c("entry_price") * (1 - c("side") * 0.02)).alias("stop_loss"),
        F.when(q >= 2, c("entry_ts_ms")).otherwise(0).alias("open_time"), F.when(q >= 1, c("exit_ts_ms")).alias("opened_at_ms"), F.lit(1).cast("long").alias("created_ms"),
    )
    return od.position_view(t).select("trade_id", F.round("tp_pct", 6).alias("tp_pct"), F.round("sl_pct", 6).alias("sl_pct"), "nearer", "opened_ms")


_TICK = "({f}({x} / 0.1 {s} 1e-9 * greatest(1, abs({x} / 0.1))) * 0.1::DOUBLE)"
_DOWN, _UP = _TICK.replace("{f}", "floor").replace("{s}", "+"), _TICK.replace("{f}", "ceil").replace("{s}", "-")


@register("pf15_limit_entries", f"""WITH {TRADES}, x AS (SELECT *, CASE trade_id % 3 WHEN 0 THEN entry_price * 1.02::DOUBLE WHEN 1 THEN entry_price * (1 - side * 0.01::DOUBLE) ELSE entry_price END AS raw FROM trades),
 y AS (SELECT *, round(CASE WHEN side > 0 THEN {_DOWN.format(x='raw')} ELSE {_UP.format(x='raw')} END, 6) AS lim FROM x)
SELECT trade_id, lim AS limit_price, CASE WHEN side > 0 THEN lim > entry_price + 1e-15 ELSE lim < entry_price - 1e-15 END AS would_cross, CASE WHEN side > 0 THEN entry_price * 0.995::DOUBLE <= lim + 1e-12 ELSE entry_price * 1.005::DOUBLE >= lim - 1e-12 END AS touched FROM y""")
def _(spark, d):
    """Limits of an absolute price, of an offset on the passive side, and of neither, against the bar of the entry."""
    c, k = F.col, F.col("trade_id") % 3
    lim = od.limit_price(c("side"), c("entry_price"), F.lit(0.1), F.when(k == 0, c("entry_price") * 1.02), F.when(k == 1, F.lit(-0.01)))
    t = trades(spark, d).withColumn("limit_price", F.round(lim, 6))
    crossing, touched = od.limit_would_cross(c("side"), c("entry_price"), c("limit_price")), od.limit_touched(c("side"), c("entry_price") * 1.005, c("entry_price") * 0.995, c("limit_price"))
    return t.select("trade_id", "limit_price", crossing.alias("would_cross"), touched.alias("touched"))


@register("pf16_maintenance", f"""WITH {TRADES}, x AS (SELECT *, qty * entry_price AS notional, qty * entry_price / (5 + trade_id % 60) AS margin, CASE WHEN qty * entry_price >= 20000 THEN 0.01 ELSE 0.005 END::DOUBLE AS mm, CASE WHEN qty * entry_price >= 20000 THEN 100 ELSE 0 END::DOUBLE AS ded FROM trades),
 y AS (SELECT *, CASE WHEN side > 0 THEN (notional - margin - ded) / (qty * (1 - mm - 0.0006::DOUBLE)) ELSE (notional + margin + ded) / (qty * (1 + mm + 0.0006::DOUBLE)) END AS p FROM x),
 z AS (SELECT *, CASE WHEN p > 0 THEN round(CASE WHEN side > 0 THEN {_UP.format(x='p')} ELSE {_DOWN.format(x='p')} END, 6) END AS liq FROM y)
SELECT trade_id, liq AS liquidation, round(greatest(0.0::DOUBLE, notional * mm - ded), 5) AS maintenance, trade_id % 10 = 0 OR liq IS NULL OR (CASE WHEN side > 0 THEN entry_price * 0.97::DOUBLE > liq ELSE -(entry_price * 1.03::DOUBLE) > -liq END) AS stop_first FROM z""")
def _(spark, d):
    """Maintenance by the tier of a position's notional, and whether its stop comes before the liquidation."""
    c = F.col
    t = trades(spark, d).withColumn("notional", c("qty") * c("entry_price"))
    ladder = _symbols(spark, d).select("symbol", F.explode(F.array(*[F.struct(F.lit(f).alias("floor"), F.lit(m).alias("mm"), F.lit(k).alias("ded")) for f, m, k in ((0.0, 0.005, 0.0), (20_000.0, 0.01, 100.0))])).alias("x")).select("symbol", "x.*")
    t = od.tier_lookup(t, ladder)
    liq = od.liquidation_price(c("side"), c("entry_price"), c("qty"), c("notional") / (5 + c("trade_id") % 60), c("tier_mm"), c("tier_ded"), F.lit(0.0006), F.lit(0.1))
    t = t.withColumn("liquidation", F.round(liq, 6)).withColumn("stop", F.when(c("trade_id") % 10 > 0, c("entry_price") * F.when(c("side") > 0, 0.97).otherwise(1.03)))
    return t.select("trade_id", "liquidation", F.round(od.maintenance_margin(c("qty"), c("entry_price"), c("tier_mm"), c("tier_ded")), 5).alias("maintenance"), od.stop_inside_liquidation(c("side"), c("stop"), c("liquidation")).alias("stop_first"))


@register("ag20_skip_counts", f"WITH {_OSQL} SELECT symbol, skip, count(*) AS n FROM n WHERE skip IS NOT NULL GROUP BY ALL")
def _(spark, d):
    # orders without a skip count as 0: a filter on it would be pushed below its columns, which are then worked out many times a row
    return od.normalise_order(_orders(spark, d).drop("qty"), max_risk=0.01).groupBy("symbol", "skip").agg(F.count("skip").alias("n")).where("n > 0")


@register("fn15_cost_share", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax + 2 * l_discount, 6) AS cost FROM lineitem")
def _(spark, d):
    from tidebar.functions.scalar import cost_share

    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(cost_share(F.col("l_tax"), F.col("l_discount")), 6).alias("cost"))
