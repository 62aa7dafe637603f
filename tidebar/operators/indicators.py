"""Stored price structure: six tables by series and month, replaced whole or carried on from where they end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.operators import structure as st
from tidebar.operators.upsert import Store
from tidebar.schemas import KEY
from tidebar.scratch import written

#: What each table's rows are numbered by, and when they are known.
_IDS = {"swings": ("swing_id", "confirm_ts_ms"), "structure_events": ("swing_id", "confirm_ts_ms"), "legs": ("leg_id", "known_ts_ms"), "levels": ("level_id", "confirm_ts_ms"), "bar_features": ("ts_ms", "ts_ms")}


class IndicatorStore:
    """swings, structure_events, legs, levels, bar_features, and series with what an update needs to carry on.

    Rows lie in the month in which they become known, so that a new day is written to the months of that day. The
    one row that changes later is the last leg, which gets its retracement from the leg after it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] = KEY, left: int = 2, right: int = 2) -> None:
        self.spark, self.keys, self.left, self.right = spark, keys, left, right
        text = ", ".join(f"{k} string" for k in keys)
        empty = spark.createDataFrame([], f"{text}, ts_ms long, high double, low double, close double")
        series = f"{text}, n_bars long, n_swings long, n_legs long, first_ts_ms long, last_ts_ms long, tail_ts_ms long, bias_sum long"
        kinds = {n: df.schema for n, df in self._whole(empty).items() if n != "series"} | {"series": T._parse_datatype_string(series)}
        self.tables = {n: Store(spark, f"{path}/{n}", keys, kinds[n], time, [*keys, i]) for n, (i, time) in _IDS.items()}
        self.tables["series"] = Store(spark, f"{path}/series", keys, kinds["series"], "first_ts_ms", keys)

    def scan(self, table: str, start_ms: int | None = None, end_ms: int | None = None, **key: str) -> DataFrame:
        """Rows of a table by key and by the time from which they are known."""
        return self.tables[table].scan(start_ms, end_ms, **key)

    def _whole(self, bars: DataFrame) -> dict[str, DataFrame]:
        """All tables of the bars (key, ts_ms, high, low, close)."""
        swings = st.swings(bars, self.left, self.right, self.keys)
        events = st.label_events(swings, self.keys)
        features = st.bar_features(bars, self.left, self.right, self.keys)
        return {"swings": swings, "structure_events": events, "legs": st.legs(events, self.keys), "levels": st.levels(swings, self.keys), "bar_features": features}

    def _counted(self, bars: DataFrame, events: DataFrame, legs: DataFrame) -> DataFrame:
        """The series row of whole series: numbers, ends, and the bars that a pivot may still need."""
        newest = Window.partitionBy(*self.keys).orderBy(F.desc("ts_ms"))
        numbered = bars.withColumn("_n", F.row_number().over(newest))
        tail = F.min(F.when(F.col("_n") <= self.left + self.right, F.col("ts_ms"))).alias("tail_ts_ms")
        out = numbered.groupBy(*self.keys).agg(F.count("*").alias("n_bars"), F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms"), tail)
        n = events.groupBy(*self.keys).agg(F.count("*").alias("n_swings"), F.max_by("bias_sum", "swing_id").alias("bias_sum"))
        m = legs.groupBy(*self.keys).agg(F.count("*").alias("n_legs"))
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_swings", "n_legs", "bias_sum")}
        return out.join(n, self.keys, "left").join(m, self.keys, "left").withColumns(zero)

    def replace(self, bars: DataFrame) -> None:
        """Compute the series of ``bars`` anew; all six tables hold just that of them afterwards, of other series what they held."""
        bars = written(bars.select(*self.keys, "ts_ms", "high", "low", "close"), "bars")
        series = bars.select(*self.keys).distinct()
        made = self._whole(bars)
        for name, rows in made.items():
            self.tables[name].replace(rows, series)
        held = {n: self.tables[n].read().join(series, self.keys, "left_semi") for n in ("structure_events", "legs")}
        self.tables["series"].replace(self._counted(bars, held["structure_events"], held["legs"]), series)

    def update(self, bars: DataFrame) -> None:
        """Carry every series on with the bars after its last one; series that are not stored yet are computed whole.

        ``bars`` may hold whole histories: of a stored series only the bars since its tail are read. What is stored
        of the past is restarted from: the swings since the last leg's start, the last two legs, the sum behind the
        bias, and the levels that closes can reach. Bars are only appended; where older ones have changed, ``replace``.
        """
        keys = self.keys
        bars = bars.select(*keys, "ts_ms", "high", "low", "close")
        known = written(self.tables["series"].read(), "series")
        fresh = bars.join(known.select(*keys), keys, "left_anti")
        if not fresh.isEmpty():
            self.replace(fresh)
        tail = written(bars.join(known, keys).where("ts_ms >= tail_ts_ms").select(*keys, "ts_ms", "high", "low", "close", "last_ts_ms", "n_bars", "n_swings", "n_legs", "bias_sum"), "tail")
        new = tail.where("ts_ms > last_ts_ms").select(*keys, "ts_ms", "high", "low", "close")
        if new.isEmpty():
            return
        own = new.select(*keys).distinct()
        at = known.join(own, keys, "left_semi")
        base = tail.groupBy(*keys).agg((F.max("n_bars") - F.count_if(F.col("ts_ms") <= F.col("last_ts_ms"))).alias("_bars"), F.max("n_swings").alias("_swings"), F.max("n_legs").alias("_legs"), F.max("bias_sum").alias("_sum"), F.max("last_ts_ms").alias("_last"))
        # swings that the new bars confirm, numbered on
        swings = st.swings(tail.select(*keys, "ts_ms", "high", "low", "close"), self.left, self.right, keys).join(base, keys).where("confirm_ts_ms > _last")
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("swing_id")) - 1
        shift = {"swing_id": (F.col("_swings") + number).cast("int"), "pivot_i": (F.col("pivot_i") + F.col("_bars")).cast("int"), "confirm_i": (F.col("confirm_i") + F.col("_bars")).cast("int")}
        swings = written(self._as("swings", swings.withColumns(shift)), "swings")
        # the stored swings and legs that labels and legs go on from
        legs = self.tables["legs"].read().join(at.select(*keys, "n_legs"), keys).where("leg_id >= n_legs - 2").drop("n_legs")
        legs = written(legs, "last-legs")
        since = legs.groupBy(*keys).agg(F.max_by("start_swing_id", "leg_id").alias("_since"))
        seeds = self.tables["swings"].read().join(own, keys, "left_semi").join(since, keys, "left").where("_since IS NULL OR swing_id >= _since").drop("_since")
        held = self.tables["structure_events"].read().join(seeds.select(*keys, "swing_id"), [*keys, "swing_id"], "left_semi")
        both = seeds.unionByName(swings)
        labelled = st.label_events(both, keys).join(base, keys).where("confirm_ts_ms > _last")
        steps = F.when(F.col("label").isin("HH", "HL"), 1).when(F.col("label").isin("LH", "LL"), -1).otherwise(0)
        run = F.sum(steps).over(Window.partitionBy(*keys).orderBy("swing_id").rowsBetween(Window.unboundedPreceding, 0))
        labelled = labelled.withColumn("bias_sum", F.col("_sum") + run).withColumn("bias", F.signum("bias_sum").cast("int"))
        labelled = written(self._as("structure_events", labelled), "labelled")
        events = written(self._as("structure_events", held).unionByName(labelled), "events")
        # legs from the last leg's start on: its own row gets its retracement, later ones are new
        made = st.legs(events, keys).join(base, keys)
        last = legs.groupBy(*keys).agg(F.max("end_swing_id").alias("_end"))
        made = made.join(last, keys, "left").where("_end IS NULL OR end_swing_id >= _end")
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("end_swing_id")) - 1
        first = F.when(F.col("_end").isNull(), F.col("_legs")).otherwise(F.col("_legs") - 1)
        made = written(self._as("legs", made.withColumn("leg_id", (first + order).cast("int"))), "legs")
        told = made.select(*keys, "leg_id", *[F.col(c).alias(f"_{c}") for c in ("retrace_pct", "fib_label", "retrace_known_ms")])
        changed = legs.join(told, [*keys, "leg_id"]).withColumns({c: F.col(f"_{c}") for c in ("retrace_pct", "fib_label", "retrace_known_ms")})
        added = made.join(legs.select(*keys, "leg_id"), [*keys, "leg_id"], "left_anti")
        legs_now = written(self._as("legs", changed).unionByName(added), "legs")
        older = legs.join(legs_now.select(*keys, "leg_id"), [*keys, "leg_id"], "left_anti")
        # features of the new bars; of the stored levels only those between the closes and next to them
        out = st.known_at_bars(new, events, self._as("legs", older).unionByName(legs_now), keys).drop("_supports", "_resistances")
        levels = self._as("levels", st.levels(swings, keys))
        features = st.nearest_levels(out, self._reach(new).unionByName(levels), keys)
        features = written(self._as("bar_features", features), "features")
        n = legs_now.join(legs.select(*keys, "leg_id"), [*keys, "leg_id"], "left_anti").groupBy(*keys).agg(F.count("*").alias("_new_legs"))
        counted = self._advanced(at, tail, events, swings, n)
        for name, rows in (("swings", swings), ("structure_events", labelled), ("levels", levels), ("legs", legs_now), ("bar_features", features)):
            self.tables[name].upsert(self._as(name, rows))
        self.tables["series"].upsert(counted)  # last: an update that breaks off before is done again

    def _as(self, table: str, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.tables[table].schema.fields])

    def _reach(self, new: DataFrame) -> DataFrame:
        """Stored levels that the new closes can have as their nearest ones."""
        span = new.groupBy(*self.keys).agg(F.min("close").alias("_lo"), F.max("close").alias("_hi"))
        stored = self.tables["levels"].read().join(span, self.keys)
        low, high = F.col("kind") == "support", F.col("kind") == "resistance"
        ends = stored.groupBy(*self.keys).agg(F.max(F.when(low & (F.col("price") <= F.col("_lo")), F.col("price"))).alias("_under"), F.min(F.when(high & (F.col("price") >= F.col("_hi")), F.col("price"))).alias("_over"))
        near = (low & (F.col("price") <= F.col("_hi")) & (F.col("_under").isNull() | (F.col("price") >= F.col("_under")))) | (high & (F.col("price") >= F.col("_lo")) & (F.col("_over").isNull() | (F.col("price") <= F.col("_over"))))
        return self._as("levels", stored.join(ends, self.keys).where(near))

    def _advanced(self, at: DataFrame, tail: DataFrame, events: DataFrame, swings: DataFrame, legs: DataFrame) -> DataFrame:
        """The series rows after an update."""
        keys = self.keys
        newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts_ms")))
        bars = tail.withColumn("_n", newest).groupBy(*keys).agg(
            F.count_if(F.col("ts_ms") > F.col("last_ts_ms")).alias("_bars"), F.max("ts_ms").alias("_last"), F.min(F.when(F.col("_n") <= self.left + self.right, F.col("ts_ms"))).alias("_tail"))
        total = events.groupBy(*keys).agg(F.max_by("bias_sum", "swing_id").alias("_sum"))
        count = swings.groupBy(*keys).agg(F.count("*").alias("_swings"))
        j = at.join(bars, keys)
        for part in (total, count, legs):
            j = j.join(part, keys, "left")
        plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
        return self._as("series", j.select(*keys, plus("n_bars", "_bars"), plus("n_swings", "_swings"), plus("n_legs", "_new_legs"), "first_ts_ms", F.col("_last").alias("last_ts_ms"), F.col("_tail").alias("tail_ts_ms"), F.coalesce("_sum", "bias_sum").alias("bias_sum")))
