"""Fields of a decision's JSON: confidence and risk in per cent, and the identifiers of its orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.scalar import safe_double

_SIZES = "confidence_pct:string, risk_pct:string, risk_fraction:string, actual_risk_pct:string, actual_risk_fraction:string, sizing_mode:string, confidence_source:string"
_BODY = f"struct<{_SIZES}, confidence:string, intended_risk_fraction:string, qty_detail:string>"


def decision_sizes(df: DataFrame, body: str = "payload") -> DataFrame:
    """``df`` with confidence_pct, risk_pct, actual_risk_pct, display_risk_pct, sizing_mode and confidence_source.

    A per cent stands before a fraction (times 100), the decision's own fields before those of ``qty_detail``, and the
    actual risk is displayed before the intended one. Where neither confidence nor risk is told, all are null, as they
    are for text that is no JSON object. The text is parsed once.
    """
    parsed = df.withColumn("_d", F.from_json(body, _BODY)).withColumn("_q", F.from_json("_d.qty_detail", f"struct<{_SIZES}>"))
    number = lambda c: safe_double(F.col(c))
    pct, share = lambda c: F.round(number(c), 4), lambda c: F.round(number(c) * 100, 4)
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    sizes = parsed.withColumns({
        "confidence_pct": F.coalesce(pct("_d.confidence_pct"), share("_d.confidence"), pct("_q.confidence_pct")),
        "risk_pct": F.coalesce(pct("_d.risk_pct"), share("_d.intended_risk_fraction"), share("_d.risk_fraction"), pct("_q.risk_pct"), share("_q.risk_fraction")),
        "actual_risk_pct": F.coalesce(pct("_d.actual_risk_pct"), pct("_q.actual_risk_pct"), share("_q.actual_risk_fraction")),
    })
    told = F.coalesce("confidence_pct", "risk_pct", "actual_risk_pct").isNotNull()
    return sizes.withColumns({
        "display_risk_pct": F.coalesce("actual_risk_pct", "risk_pct"),
        "sizing_mode": F.when(told, F.coalesce(text("_d.sizing_mode"), text("_q.sizing_mode"))),
        "confidence_source": F.when(told, F.coalesce(text("_d.confidence_source"), text("_q.confidence_source"))),
    }).drop("_d", "_q")


def order_ids(result: Column) -> Column:
    """Identifiers of all orders that an order's result names, once each: its own, the placed one, take-profit and stop legs.

    A leg is an object or a list of objects with the identifier in its ``result`` or its own. Null, empty and malformed
    text give an empty array, and what has another type at a place is passed over.
    """
    at = lambda path: F.get_json_object(result, path)
    found = [F.array(at("$.order_id"), at("$.orderId"), at("$.placed.response.result.orderId"))]
    for leg in ("tp", "sl"):
        text = at(f"$.tpsl.{leg}")
        items = F.when(text.startswith("{"), F.array(text)).otherwise(F.from_json(text, "array<string>"))
        each = F.flatten(F.transform(items, lambda x: F.array(F.get_json_object(x, "$.result.orderId"), F.get_json_object(x, "$.orderId"))))
        found.append(F.coalesce(each, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x.isNotNull() & (x != "")))
