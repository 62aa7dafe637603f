"""Explicit table schemas; keys are source, symbol, timeframe and the bar's open time in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["source", "symbol", "timeframe"]
BAR_VALUES = ["open", "high", "low", "close", "volume"]


_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, _TYPES[v]) for k, v in fields.items()])


BARS = _struct(source="string", symbol="string", timeframe="string", ts_ms="long", open="double", high="double", low="double", close="double", volume="double")
LIVE_BARS = _struct(exchange="string", symbol="string", timeframe="string", ts_ms="long", open="double", high="double", low="double", close="double", volume="double", quote_volume="double", trades="long", taker_buy_base="double", taker_buy_quote="double", updated_at_ms="long")
OPEN_INTEREST = _struct(source="string", symbol="string", timeframe="string", ts_ms="long", oi="double", oi_usd="double", oi_sum="double", ls_ratio="double", top_ls_ratio="double", taker_ratio="double")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types: missing ones null, others dropped, NaN null."""
    out = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)
