"""Feature rows of closed bars one by one, from a state per series: what a live reader would have seen.

The state of a series is small and survives restarts in the stream's checkpoint. Within a micro-batch a series'
bars are taken in order of time; a bar at or before the last one taken is late or repeated and gives no row.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebar.functions.scalar import RATIOS, RETRACEMENTS, fib_column, fib_label
from tidebar.schemas import KEY

#: A step takes the held values (empty before the first bar) and a bar, changes the held values and returns the row.
Step = Callable[[dict, dict], dict]


def stepped(stream: DataFrame, keys: list[str], step: Step, columns: str, inputs: tuple[str, ...] = ("high", "low", "close")) -> DataFrame:
    """Key columns, ts_ms and ``columns`` (DDL) of every bar of the stream. Key columns are strings."""
    kinds = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], T.StructField("ts_ms", T.LongType()), *T._parse_datatype_string(columns).fields])
    names = [f.name for f in kinds.fields[len(keys) + 1 :]]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, "{}")
        held = json.loads(held)
        bars = pd.concat(list(parts)).sort_values("ts_ms", kind="stable")
        rows = []
        for ts, *values in bars[["ts_ms", *inputs]].itertuples(index=False, name=None):
            if last is None or ts > last:
                last = int(ts)
                row = step(held, {"ts_ms": last, **{n: None if math.isnan(v) else float(v) for n, v in zip(inputs, values, strict=True)}})
                rows.append((*key, last, *[row[n] for n in names]))
        if last is not None:
            state.update((last, json.dumps(held)))
        frame = pd.DataFrame(rows, columns=kinds.names, dtype=object)
        yield frame.astype({f.name: "Int64" if isinstance(f.dataType, (T.LongType, T.IntegerType)) else "float64" for f in kinds.fields if not isinstance(f.dataType, T.StringType)})

    return stream.select(*keys, "ts_ms", *inputs).groupBy(*keys).applyInPandasWithState(run, kinds, "last long, held string", "append", GroupStateTimeout.NoTimeout)


_LEG = ("last_leg_dir", "last_leg_kind", "last_leg_len_pct")
STRUCTURE = (
    "close double, last_sh_price double, last_sh_ts_ms long, dist_last_sh_pct double, last_sl_price double, last_sl_ts_ms long, dist_last_sl_pct double, last_structure_label string, structure_bias int, "
    "last_leg_dir string, last_leg_kind string, last_leg_len_pct double, "
    + ", ".join(f"{fib_column(r)} double" for r in RATIOS) + ", " + ", ".join(f"dist_{fib_column(r)}_pct double" for r in RETRACEMENTS)
    + ", last_retrace_pct double, last_retrace_fib string, nearest_support double, nearest_resistance double, dist_support_pct double, dist_resistance_pct double"
)


def _swing(held: dict, kind: str, price: float, ts: int) -> None:
    """A swing becomes known: label, bias, level, and the leg from a swing of the other kind before it."""
    before = held.get(kind)
    if before is None:
        held["label"] = "SH" if kind == "high" else "SL"
    else:
        rises = price > before["price"]
        held["label"] = ("HH" if rises else "LH") if kind == "high" else ("HL" if rises else "LL")
        held["sum"] = held.get("sum", 0) + (1 if rises else -1)
    held[kind] = {"price": price, "ts": ts}
    insort(held.setdefault("levels_" + kind, []), price)
    bias = (held.get("sum", 0) > 0) - (held.get("sum", 0) < 0)
    start = held.get("swing")
    if start is not None and start["kind"] != kind:
        a, b = start["price"], price
        done = held.get("leg")
        if done is not None:  # its retracement is shown from now on
            size = done["b"] - done["a"]
            share = (done["b"] - b) / size if abs(size) >= 1e-15 else None
            held["retrace"] = [share, None if share is None else fib_label(min(RETRACEMENTS, key=lambda r: (abs(r - abs(share)), r)))]
        middle = 0.5 * (abs(a) + abs(b))
        leg_kind = "unknown" if bias == 0 else "impulse" if (bias > 0) == (b > a) else "correction"
        held["leg"] = {"a": a, "b": b, "last_leg_dir": "up" if b > a else "down", "last_leg_kind": leg_kind, "last_leg_len_pct": abs(b - a) / middle if middle > 0 else None}
    held["swing"] = {"kind": kind, "price": price}


def structure_step(left: int = 2, right: int = 2) -> Step:
    """The row that ``operators.structure.bar_features`` has for a bar, from this bar and what is held."""

    def step(held: dict, bar: dict) -> dict:
        window = held.setdefault("window", [])
        window.append([bar["ts_ms"], bar["high"], bar["low"]])
        if len(window) > left + right + 1:
            window.pop(0)
        if len(window) == left + right + 1:
            ts, high, low = window[left]
            others = window[:left], window[left + 1 :]
            for kind, price, at, sign in (("low", low, 2, -1), ("high", high, 1, 1)):
                known = [[x[at] for x in side if x[at] is not None] for side in others]
                if price is not None and all(known) and all(sign * price > sign * x for side in known for x in side):
                    _swing(held, kind, price, ts)
        return _shown(held, bar["close"])

    return step


def _shown(held: dict, c: float | None) -> dict:
    share = lambda x: x / c if c and x is not None else None
    row = {"close": c, "last_structure_label": held.get("label"), "structure_bias": (held.get("sum", 0) > 0) - (held.get("sum", 0) < 0)}
    for kind, name in (("high", "sh"), ("low", "sl")):
        at = held.get(kind) or {"price": None, "ts": None}
        row |= {f"last_{name}_price": at["price"], f"last_{name}_ts_ms": at["ts"], f"dist_last_{name}_pct": None if at["price"] is None or c is None else share(c - at["price"])}
    leg = held.get("leg") or {}
    row |= {k: leg.get(k) for k in _LEG}
    for r in RATIOS:
        price = None if not leg else leg["b"] - r * (leg["b"] - leg["a"]) if r <= 1 else leg["a"] + r * (leg["b"] - leg["a"])
        row[fib_column(r)] = price
        if r in RETRACEMENTS:
            row[f"dist_{fib_column(r)}_pct"] = None if price is None or c is None else share(price - c)
    row["last_retrace_pct"], row["last_retrace_fib"] = held.get("retrace") or (None, None)
    lows, highs = held.get("levels_low", []), held.get("levels_high", [])
    below, above = (0, len(highs)) if c is None else (bisect_right(lows, c), bisect_left(highs, c))
    row["nearest_support"] = lows[below - 1] if below else None
    row["nearest_resistance"] = highs[above] if above < len(highs) else None
    row["dist_support_pct"] = share(c - row["nearest_support"]) if below else None
    row["dist_resistance_pct"] = share(row["nearest_resistance"] - c) if above < len(highs) else None
    return row


def stream_features(stream: DataFrame, keys: list[str] = KEY, left: int = 2, right: int = 2) -> DataFrame:
    """The causal feature matrix of price structure, a row per closed bar as it arrives.

    A series holds ``left + right + 1`` bars, its last swings, leg and sums, and the prices of its levels.
    High, low and close are finite.
    """
    return stepped(stream, keys, structure_step(left, right), STRUCTURE)


def replay(bars: DataFrame, until_ms: list[int], build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Rows of ``build`` over a stream of the bars, which land in slices up to each of the times, one after the other.

    The query ends after every slice and starts again from its checkpoint, as a live reader does.
    """
    spark = bars.sparkSession
    since = None
    for until in until_ms:
        part = bars.where(F.col("ts_ms") <= until) if since is None else bars.where((F.col("ts_ms") <= until) & (F.col("ts_ms") > since))
        part.write.mode("append").parquet(f"{folder}/landed")
        stream = spark.readStream.schema(bars.schema).parquet(f"{folder}/landed")
        build(stream).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        since = until
    return spark.read.parquet(f"{folder}/rows")
