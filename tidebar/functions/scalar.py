"""Column functions: names, times, safe numbers, aliases, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebar.timeframes import STEP_MS, step_ms

#: Fibonacci ratios of retracements and extensions.
RETRACEMENTS = (0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
EXTENSIONS = (1.272, 1.618, 2.0, 2.618)
RATIOS = tuple(sorted({0.0, *RETRACEMENTS, *EXTENSIONS}))


def normalize_symbol(text: Column, keep_underscore: bool = False) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), "[/\\-]" if keep_underscore else "[/\\-_]", "")


def normalize_side(text: Column) -> Column:
    """Buy or Sell by the first letter, long and short, 1 and -1 too; other text as it stands, null empty."""
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    buy, sell = plain.isin("long", "1") | plain.startswith("b"), plain.isin("short", "-1") | plain.startswith("s")
    return F.when(buy, "Buy").when(sell, "Sell").otherwise(F.coalesce(text, F.lit("")))


def epoch_ms(text: Column) -> Column:
    """Date, ISO time, with Z or offset or none (UTC), to milliseconds; null if it is no time."""
    plain = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    return F.unix_millis(F.try_to_timestamp(plain))


def utc_ms(time: Column, without_zone: bool = True) -> Column:
    """Milliseconds of a timestamp; one without zone is UTC whatever the session's zone is."""
    return F.unix_millis(F.from_utc_timestamp(time.cast("timestamp"), F.current_timezone())) if without_zone else F.unix_millis(time)


def safe_double(text: Column) -> Column:
    """Number, or null for empty, unreadable, NaN and infinite values."""
    return finite(text.try_cast("double"))


def finite(v: Column) -> Column:
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def first_nonzero(*choices: Column) -> Column:
    """First choice that is neither null nor zero; else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in choices], F.lit(0.0))


def expected_closed_open(now_ms: Column, timeframe: Column, anchor_ms: int = 0) -> Column:
    """Open time of the newest bar that is closed at ``now_ms``; weekly bars on Mondays need the anchor."""
    step = step_ms(timeframe)
    return (F.floor((now_ms - anchor_ms) / step) * step + anchor_ms - step).cast("long")


def clock_skew(before_ms: Column, server_ms: Column, after_ms: Column) -> Column:
    """How far the server's time lies outside the request's window."""
    lo, hi = F.least(before_ms, after_ms), F.greatest(before_ms, after_ms)
    return F.when(server_ms < lo, lo - server_ms).when(server_ms > hi, server_ms - hi).otherwise(F.lit(0).cast("long"))


def skew_limit(timeframe: Column, usual: int = 5000, short: int = 3000) -> Column:
    return F.when(F.coalesce(step_ms(timeframe), F.lit(0)) <= STEP_MS["5m"], F.lit(short)).otherwise(F.lit(usual)).cast("long")


def fib_label(ratio: float) -> str:
    return f"{ratio:.3f}"


def fib_column(ratio: float) -> str:
    return "fib_" + fib_label(ratio).replace(".", "")


def fib_price(a: Column, b: Column, ratio: float) -> Column:
    """Price at ``ratio`` of the leg a to b: given back from b up to 1, beyond b above 1."""
    return b - F.lit(ratio) * (b - a) if ratio <= 1 else a + F.lit(ratio) * (b - a)


def retracement(a: Column, b: Column, c: Column) -> Column:
    """Share of the leg a to b that c gives back; null for a leg without length."""
    return F.when(F.abs(b - a) >= 1e-15, (b - c) / (b - a))


def nearest_ratio(r: Column) -> Column:
    """Label of the retracement ratio nearest to ``r``; of equally near ones the smaller."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(x) - r).alias("err"), F.lit(i).alias("i"), F.lit(fib_label(x)).alias("label")) for i, x in enumerate(RETRACEMENTS)]))
    return F.when(r.isNotNull(), near["label"])


def round_grid(value: Column, grid: Column, how: str = "floor") -> Column:
    """``value`` on the grid, down, up or to the nearest, forgiving a relative 1e-9; 12 significant digits."""
    n = value / grid
    eps = F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(n))
    k = {"floor": F.floor(n + eps), "ceil": F.ceil(n - eps), "nearest": F.round(n)}[how]
    v = k.cast("double") * grid
    scale = F.pow(F.lit(10.0), 11 - F.floor(F.log10(F.abs(v))))
    return F.when(~(grid > 0), value).when(v == 0, v).otherwise(F.rint(v * scale) / scale)


def json_number(v: Column) -> Column:
    """Number as JSON text: NaN null, infinities as strings."""
    return F.when(v.isNull() | F.isnan(v), F.lit("null")).when(v == float("inf"), F.lit('"inf"')).when(v == float("-inf"), F.lit('"-inf"')).otherwise(v.cast("string"))


def show_percent(v: Column, digits: int = 2, signed: bool = False) -> Column:
    return F.when(v.isNull() | F.isnan(v), "—").otherwise(F.format_string(f"%{'+' if signed else ''}.{digits}f%%", v))


def show_number(v: Column, digits: int = 4) -> Column:
    """Plain number: a dash for null, inf and -inf and nan by name."""
    return F.when(v.isNull(), "-").when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).otherwise(F.format_string(f"%.{digits}f", v))


def symbols_in_text(text: Column, quote: str = "USDT") -> Column:
    """Distinct upper-cased tokens of letters and digits that end in ``quote``, in the order of their first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?i)([A-Za-z0-9]+{quote})"), F.lit(1)), F.upper))


def flag_values(text: Column, flag: str) -> Column:
    """Values of ``--flag value`` and ``--flag=value``, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?i)--{flag}(?:\s+|=)(\S+)"), F.lit(1))


def symbols_of_flags(text: Column, flag: str = "symbol") -> Column:
    """Distinct normalised symbols of the flag; empty ones are left out."""
    return F.array_distinct(F.filter(F.transform(flag_values(text, flag), lambda s: normalize_symbol(s)), lambda s: s != ""))


def show_utc(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd HH:mm")


def cost_share(slippage: Column, taker: Column) -> Column:
    """Round-trip cost estimate as a share of notional."""
    return slippage + 2 * taker


def exit_bucket(reason: Column) -> Column:
    """tp, sl or other, after the entry-bar suffix is cut off.

    What starts with target or tp is tp; any other reason that names a stop is sl; all else,
    liquidation, null and empty reasons too, is other.
    """
    plain = F.lower(F.trim(F.regexp_replace(reason, "_entry_bar$", "")))
    return F.when(plain.startswith("target") | plain.startswith("tp"), "tp").when(plain.contains("stop"), "sl").otherwise("other")
