"""Keyed writes on Parquet folders. Plain Parquet has no merge, so a write reads the partitions that a
batch touches, settles each key, and overwrites just these partitions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.operators.series import last_per_key
from tidebar.scratch import written

#: Months of series of a batch that are looked up by a folder filter; more are joined.
PRUNED = 200
#: The partition column beside the key.
MONTH = "month_"


def overwrite(old: DataFrame, new: DataFrame, pk: list[str], seq: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; of several new ones the last in ``seq``."""
    s = F.col(seq) if seq else F.lit(0)
    both = old.withColumn("_new", F.lit(0)).withColumn("_seq", F.lit(0).cast("long")).unionByName(new.withColumn("_new", F.lit(1)).withColumn("_seq", s.cast("long")), allowMissingColumns=True)
    return last_per_key(both, pk, "_new", "_seq").drop("_new", "_seq")


def settled(new: DataFrame, pk: list[str], values: list[str], seq: str | None) -> DataFrame:
    """One row per key of a batch: the last in ``seq``, or without it the one with the largest values."""
    order = [F.col(seq)] if seq else []
    return last_per_key(new, pk, *order, F.struct(*values))


def change_detecting(old: DataFrame, new: DataFrame, pk: list[str], values: list[str], optional: list[str], stamp: str, now: Column, seq: str | None = None) -> DataFrame:
    """New values by key; ``stamp`` moves only where a value differs. Nulls of ``optional`` columns equal -1.

    A key that the batch repeats gives one row, the last in ``seq``.
    """
    new = settled(new, pk, values, seq)
    o, n = old.select(*pk, F.struct(*values, stamp).alias("o")), new.select(*pk, F.struct(*values).alias("n"))
    same = F.lit(True)
    for v in values:
        a, b = F.col(f"o.{v}"), F.col(f"n.{v}")
        same = same & (F.coalesce(a, F.lit(-1)).eqNullSafe(F.coalesce(b, F.lit(-1))) if v in optional else a.eqNullSafe(b))
    keep = F.col("n").isNull() | (F.col("o").isNotNull() & same)
    j = o.join(n, pk, "full_outer")
    return j.select(*pk, *[F.when(keep, F.col(f"o.{v}")).otherwise(F.col(f"n.{v}")).alias(v) for v in values], F.when(keep, F.col(f"o.{stamp}")).otherwise(now).alias(stamp))


def coalescing(old: DataFrame, new: DataFrame, pk: list[str], replaced: list[str], kept: list[str], seq: str | None = None) -> DataFrame:
    """``replaced`` columns take the new value, null too; ``kept`` ones the new value unless it is null.

    A key that the batch repeats is settled in the order of ``seq``: the last value, or the last that is no null.
    """
    by = F.struct(*([seq] if seq else []), *replaced, *kept)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by))
    new = new.groupBy(*pk).agg(F.max_by(F.struct(*replaced), by).alias("_last"), *[last(c).alias(c) for c in kept]).select(*pk, "_last.*", *kept)
    o, n = old.select(*pk, F.struct(*replaced, *kept).alias("o")), new.select(*pk, F.struct(*replaced, *kept).alias("n"))
    j = o.join(n, pk, "full_outer")
    return j.select(*pk, *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in replaced], *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in kept])


def latest_by_key(log: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Current value of every key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def flags(log: DataFrame, key: list[str]) -> DataFrame:
    """Flags that are set: keys whose last event is not a clearing one. log: key, action, seq, reason."""
    return log.groupBy(*key).agg(F.max_by(F.struct("action", "reason"), "seq").alias("x")).where("x.action = 'set'").select(*key, "x.reason")


def listed_flags(meta: DataFrame, prefix: str = "data_unsafe:") -> DataFrame:
    """Flags of a key-value table (key, value as JSON): key, ok, reason, raw.

    Text that is no JSON, null too, is told apart from a flag without a reason: ok false, the reason META_PARSE_FAIL
    and the first 200 characters of the text.
    """
    parsed = F.try_parse_json("value")
    bad = parsed.isNull()
    field = lambda name, kind: F.try_variant_get(parsed, f"$.{name}", kind)
    return meta.where(F.col("key").startswith(prefix)).select(
        "key", F.when(bad, False).otherwise(field("ok", "boolean")).alias("ok"),
        F.when(bad, "META_PARSE_FAIL").otherwise(field("reason", "string")).alias("reason"), F.when(bad, F.substring("value", 1, 200)).alias("raw"),
    )


def purge_except(df: DataFrame, keep: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the series to keep, rows deleted per other series)."""
    return df.join(keep, key, "left_semi"), df.join(keep, key, "left_anti").groupBy(*key).agg(F.count("*").alias("deleted"))


def merge_registry(old: DataFrame, found: DataFrame) -> DataFrame:
    """Registry of suspect columns (column, reasons, first_seen, last_seen, symbol, timeframe) with new findings."""
    f = found.groupBy("column").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"])).alias("nr"), F.min("seen").alias("nf"), F.max("seen").alias("nl"), F.max_by("symbol", "seq").alias("ns"), F.max_by("timeframe", "seq").alias("nt"))
    none = F.array().cast("array<string>")
    return old.join(f, "column", "full_outer").select(
        "column", F.array_distinct(F.concat(F.coalesce("reasons", none), F.coalesce("nr", none))).alias("reasons"),
        F.least("first_seen", "nf").alias("first_seen"), F.greatest("last_seen", "nl").alias("last_seen"), F.coalesce("ns", "symbol").alias("symbol"), F.coalesce("nt", "timeframe").alias("timeframe"),
    )


def replace_series(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and old rows of the series that ``new`` does not have."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def migrate(df: DataFrame, constants: dict[str, dict[str, object]], by: str = "source") -> DataFrame:
    """Missing columns of a store's older rows, filled with what is known of their source."""
    for column, values in constants.items():
        fill: Column = F.lit(None)
        for source, v in values.items():
            fill = F.when(F.col(by) == source, F.lit(v)).otherwise(fill)
        df = df.withColumn(column, F.coalesce(F.col(column), fill) if column in df.columns else fill)
    return df


def month(ts_ms: Column) -> Column:
    """Month of a time in UTC, as the number yyyymm, whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_ms / 86_400_000).cast("int"))
    return F.year(day) * 100 + F.month(day)


class Store:
    """A Parquet folder partitioned by series key and month, with keyed writes.

    A write costs what the months of its batch hold, not what the series do. One writer at a time; folders
    are swapped by Spark's writer one by one, so a reader meanwhile may see some of a batch's months new and others old.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema, time: str = "ts_ms", pk: list[str] | None = None) -> None:
        self.spark, self.path, self.key, self.schema, self.time, self.pk = spark, path, key, schema, time, pk or [*key, time]
        self.columns = [f.name for f in schema.fields]
        self.place = [*key, MONTH]

    def _all(self) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], self.schema).withColumn(MONTH, F.lit(None).cast("int"))
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(MONTH, T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        """All rows; an empty frame of the schema before the first write. Columns that old files lack are null."""
        return self._all().select(*self.columns)

    def scan(self, start_ms: int | None = None, end_ms: int | None = None, **key: str) -> DataFrame:
        """Rows of the series asked for, in time; key and range prune folders, the range is pushed to the files too."""
        out = self._all()
        for k, v in key.items():
            out = out.where(F.col(k) == v)
        if start_ms is not None:
            out = out.where((F.col(self.time) >= start_ms) & (F.col(MONTH) >= month(F.lit(start_ms))))
        if end_ms is not None:
            out = out.where((F.col(self.time) <= end_ms) & (F.col(MONTH) <= month(F.lit(end_ms))))
        return out.select(*self.columns).orderBy(*self.key, self.time)

    def _same(self, one: DataFrame, other: DataFrame) -> Column:
        """Both of one partition; a null key is one too."""
        out = F.lit(True)
        for k in self.place:
            out = out & one[k].eqNullSafe(other[k])
        return out

    def _touched(self, batch: DataFrame) -> DataFrame:
        """The store's rows of the months that the batch has of each series. Few prune folders by a filter; many are joined."""
        places = batch.select(*self.key, month(F.col(self.time)).alias(MONTH)).distinct()
        few = places.limit(PRUNED + 1).collect()
        whole = self._all()
        if len(few) > PRUNED:
            return whole.join(places, self._same(whole, places), "left_semi").select(*self.columns)
        wanted = F.lit(False)
        for row in few:
            own = F.lit(True)
            for k in self.place:
                own = own & F.col(k).eqNullSafe(F.lit(row[k]))
            wanted = wanted | own
        return whole.where(wanted).select(*self.columns)

    @contextmanager
    def _kept(self, rows: DataFrame, name: str) -> Iterator[DataFrame]:
        """``rows`` as a table beside the store while it is needed: computed once, and safe from what the store becomes."""
        path = f"{self.path}.{name}-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(path)
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self._delete(path)

    def write(self, rows: DataFrame) -> None:
        """Overwrite the months that ``rows`` has of each series, by these rows."""
        with self._kept(rows.select(*self.columns), "aside") as out:
            dealt = out.withColumn(MONTH, month(F.col(self.time))).repartition(*self.place).sortWithinPartitions(*self.place, self.time)
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.place).parquet(self.path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(path) if "%" in path else path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def purge(self, gone: Column) -> DataFrame:
        """Delete the rows for which ``gone`` holds; rows deleted per series. Months without rows lose their folder."""
        where = F.coalesce(gone, F.lit(False))
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")  # named as Spark has named it, with its escapes
        whole = self._all()
        if not whole.inputFiles():
            return self.spark.createDataFrame([], T.StructType([*[f for f in self.schema.fields if f.name in self.key], T.StructField("deleted", T.LongType())]))
        counts = whole.groupBy(*self.place, folder.alias("folder")).agg(F.count_if(where).alias("deleted"), F.count_if(~where).alias("left")).where("deleted > 0")
        counts = written(counts, "purged")
        some = counts.where("left > 0")
        if not some.isEmpty():
            self.write(whole.join(some, self._same(whole, some), "left_semi").where(~where))
        for row in counts.where("left = 0").select("folder").toLocalIterator():
            self._delete(row["folder"])
        return counts.groupBy(*self.key).agg(F.sum("deleted").alias("deleted"))

    def replace(self, rows: DataFrame, series: DataFrame) -> None:
        """The rows of ``series`` (key columns) become ``rows``: their months are overwritten, and months that they no longer have go."""
        places = written(rows.select(*self.key, month(F.col(self.time)).alias(MONTH)).distinct(), "places")
        whole = self._all()
        stale: list[str] = []
        if whole.inputFiles():
            folders = whole.select(*self.place, F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")).distinct()
            own = F.lit(True)
            for k in self.key:
                own = own & folders[k].eqNullSafe(series[k])
            old = folders.join(series, own, "left_semi")
            stale = [r["folder"] for r in old.join(places, self._same(old, places), "left_anti").select("folder").toLocalIterator()]  # folder names
        self.write(rows)
        for folder in stale:
            self._delete(folder)

    def purge_series(self, **key: str) -> DataFrame:
        """Delete whole series, such as all of a timeframe; rows deleted per series."""
        gone = F.lit(True)
        for k, v in key.items():
            gone = gone & (F.col(k) == v)
        return self.purge(gone)

    def _merge(self, batch: DataFrame, settle: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """The batch is computed once, whatever it comes from, and settled with the months that it touches."""
        with self._kept(batch, "batch") as rows:
            self.write(settle(self._touched(rows), rows))

    def upsert(self, batch: DataFrame, seq: str | None = None) -> None:
        own = batch.drop(*(set(batch.columns) - {*self.columns, seq}))
        self._merge(own, lambda old, new: overwrite(old, new, self.pk, seq))

    def upsert_changed(self, batch: DataFrame, values: list[str], optional: list[str], stamp: str, now: Column, seq: str | None = None) -> None:
        self._merge(batch, lambda old, new: change_detecting(old, new, self.pk, values, optional, stamp, now, seq))

    def upsert_coalescing(self, batch: DataFrame, replaced: list[str], kept: list[str], seq: str | None = None) -> None:
        self._merge(batch, lambda old, new: coalescing(old, new, self.pk, replaced, kept, seq))


def latest_events(df: DataFrame, pk: list[str], at: str) -> DataFrame:
    """One row per key, the newest by ``at``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*pk).orderBy(F.desc(at)))).where("_n = 1").drop("_n")
