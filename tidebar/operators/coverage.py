"""What time ranges of a key have been fetched, stored as disjoint intervals, and what of a wanted range is still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.operators.scan import block_scan
from tidebar.scratch import written

DAY = 86_400_000


def united(intervals: DataFrame, keys: list[str], block_ms: int = 365 * DAY) -> DataFrame:
    """(keys, from_ms, to_ms): intervals of a key that overlap or touch become one.

    Intervals that end before they start, or lack an end, are left out; one that is a point stays. Starts and ends are
    summed by time before anything moves; how many intervals are open is a running sum in blocks of time, so that a
    key's intervals are no one task's sort.
    """
    ends = F.array(F.struct(F.col("from_ms").alias("at"), F.lit(1).alias("opens"), F.lit(0).alias("closes")), F.struct(F.col("to_ms").alias("at"), F.lit(0).alias("opens"), F.lit(1).alias("closes")))
    times = intervals.where("from_ms <= to_ms").select(*keys, F.explode(ends).alias("e")).groupBy(*keys, "e.at").agg(F.sum("e.opens").alias("opens"), F.sum("e.closes").alias("closes"))
    times = written(times, "times")  # a scan reads its rows twice
    open_ = block_scan(times, keys, "at", [], block_ms, {"after": ("sum", F.col("opens") - F.col("closes"))})
    first, last = F.col("after") - F.col("opens") + F.col("closes") == 0, F.col("after") == 0
    edges = open_.select(*keys, "at", first.alias("first"), last.alias("last")).where("first OR last")
    paired = block_scan(written(edges, "edges"), keys, "at", [], block_ms, {"next": ("lead", F.col("at"))})  # starts and ends take turns
    return paired.where("first").select(*keys, F.col("at").alias("from_ms"), F.when(F.col("last"), F.col("at")).otherwise(F.col("next")).alias("to_ms"))


def missing(wanted: DataFrame, covered: DataFrame, keys: list[str], overlap_ms: int = 0) -> DataFrame:
    """(keys, from_ms, to_ms): parts of the wanted ranges that ``covered`` (disjoint intervals of a key) leaves open.

    What follows a covered interval is asked for from ``overlap_ms`` before its end, as its last rows may have come
    late; so a range that ends less than that after the last interval's end is asked for too. Empty ranges give nothing.
    """
    window = Window.partitionBy(*keys).orderBy("from_ms")
    holes = covered.select(*keys, F.col("to_ms").alias("_a"), F.lead("from_ms").over(window).alias("_b"))
    first = covered.groupBy(*keys).agg(F.min("from_ms").alias("_b")).select(*keys, F.lit(None).cast("long").alias("_a"), "_b")
    open_ = holes.unionByName(first)
    want = wanted.where("from_ms < to_ms").select(*keys, F.col("from_ms").alias("_from"), F.col("to_ms").alias("_to"))
    same = F.lit(True)
    for k in keys:
        same = same & want[k].eqNullSafe(open_[k])
    start, end = F.greatest(F.col("_from"), F.col("_a") - overlap_ms), F.least(F.col("_to"), F.col("_b"))
    found = want.join(open_, same, "left").where(start < end)  # a key without coverage has one hole without ends
    return found.select(*[want[k] for k in keys], start.alias("from_ms"), end.alias("to_ms"))


class Coverage:
    """Covered intervals as a Parquet table in hashed buckets of keys; a merge rewrites the buckets that it touches.

    The watermark of a key, from the least start to the greatest end, is ``watermark()``. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: T.StructType, buckets: int = 16) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.keys = [f.name for f in key.fields]
        self.schema = T.StructType([*key.fields, T.StructField("from_ms", T.LongType()), T.StructField("to_ms", T.LongType())])

    def _all(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        whole = T.StructType([*self.schema.fields, T.StructField("bucket_", T.IntegerType())])
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop("bucket_")

    def watermark(self) -> DataFrame:
        """(keys, from_ms, to_ms): one row a key."""
        return self.read().groupBy(*self.keys).agg(F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms"))

    def add(self, intervals: DataFrame) -> None:
        """Unite ``intervals`` with what is stored of their keys; the order of merges does not matter."""
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets))
        new = written(intervals.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn("bucket_", bucket), "fetched")
        touched = [r["bucket_"] for r in new.select("bucket_").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        old = self._all().where(F.col("bucket_").isin(touched))
        out = written(united(old.unionByName(new), ["bucket_", *self.keys]), "covered")
        dealt = out.repartition("bucket_").sortWithinPartitions("bucket_", *self.keys, "from_ms")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_").parquet(self.path)
