"""Timeframe codes and their steps in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twelve timeframe codes.
STEP_MS = {
    "1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000,
    "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "12h": 43_200_000, "1d": 86_400_000, "1w": 604_800_000,
}
#: Other spellings.
ALIASES = {"1": "1m", "5": "5m", "15": "15m", "60": "1h", "240": "4h", "1hour": "1h", "4hour": "4h", "4hr": "4h"}
#: The epoch was a Thursday; weekly bars start on Mondays.
MONDAY_MS = 345_600_000


def step_ms(timeframe: Column) -> Column:
    """Step of a timeframe code; null for an unknown one."""
    return F.create_map(*[F.lit(x) for pair in STEP_MS.items() for x in pair])[timeframe].cast("long")


def normalize_timeframe(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "min", "m")
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[plain], plain)


def bucket(ts_ms: Column, step: int, offset: int = 0) -> Column:
    """Start of the bucket that holds ``ts_ms``; buckets start at ``offset`` past the epoch."""
    return (F.floor((ts_ms - offset) / step) * step + offset).cast("long")
