"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of 64-bit hashes; a key belongs to the first point
clockwise of its own hash. A shard takes no more rows than its load bound; keys that find it full
continue clockwise to the next shard that has room. The bounds are exact here (the row count
divided by the shards, the first ones one more), so the law is ``rows``: counts at most one apart.

The keys of one arc between two points share their walk, so the overflow is settled on the arcs'
counts, which are as many as the ring has points whatever the number of rows; each arc then comes
out as a few runs of ranks, one per shard, and a row finds its shard and slot by its rank in its arc.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.llm.common import saved, table

QUERY = "op4_sharding"
ORACLE_SQL = None  # the ring's points are hashes that SQL does not have; tests compare with a sequential ring
SHARDS = 8
VNODES = 128
#: Cells of the ring for ranking: a window sorts one cell of one arc, not a whole arc.
CELL_BITS = 16

_SIGN = np.uint64(1 << 63)


@cache
def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(points in order, their shards); a point's place comes from its shard and number alone."""
    at = [(int.from_bytes(hashlib.blake2b(f"shard {s} point {v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(vnodes)]
    at.sort()
    return np.array([p for p, _ in at], np.uint64), np.array([s for _, s in at])


@cache
def walks(shards: int, vnodes: int) -> list[list[int]]:
    """For each arc, the shards in the order in which its keys meet them clockwise."""
    owner = ring(shards, vnodes)[1].tolist()
    return [list(dict.fromkeys(owner[a:] + owner[:a])) for a in range(len(owner))]


def settle(counts: dict[int, int], shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, first slot) of all keys, given the keys per arc.

    In the k-th round every key that has no shard yet asks the k-th shard on its walk. Who is
    turned away has met a full shard, and full shards stay full; the bounds add up to the number of
    keys, so after a round for every shard all keys have a place.
    """
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    slot = [0] * shards
    given = dict.fromkeys(counts, 0)
    runs = []
    for k in range(shards):
        for arc in sorted(counts):
            s = walks(shards, vnodes)[arc][k]
            take = min(counts[arc] - given[arc], room[s])
            if take:
                runs.append((arc, given[arc], given[arc] + take, s, slot[s]))
                given[arc] += take
                room[s] -= take
                slot[s] += take
    return runs


def assign_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, vnodes: int = VNODES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``df``: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the carried columns.

    ``size`` is the text's UTF-8 bytes plus 1; null text counts as empty. A key is the identifier
    with the text's size and checksum, so rows without identifier spread too; repeated rows are
    placed each. An empty table gives no rows. ``carry`` names columns to hand through; those named
    like a result column come with the prefix ``in_``.
    """
    own = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    points = ring(shards, vnodes)[0]

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        place = h.to_numpy().view(np.uint64) ^ _SIGN
        return pd.Series(np.searchsorted(points, place, side="left") % len(points), dtype="int32")

    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))).alias("text_crc32"),
        *[F.col(c).alias(f"in_{c}" if c in own else c) for c in carry],
    ).withColumn("h_", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))
    rows = rows.withColumn("arc_", arc_of("h_")).withColumn("cell_", F.shiftright("h_", 64 - CELL_BITS).cast("int"))
    rows = saved(rows, "keys")
    cells = rows.groupBy("arc_", "cell_").count()
    arcs = {r["arc_"]: r["n"] for r in cells.groupBy("arc_").agg(F.sum("count").alias("n")).collect()}  # at most one row a point
    runs = settle(arcs, shards, vnodes)
    spark = df.sparkSession
    placed = spark.createDataFrame(runs or [(-1, 0, 0, 0, 0)], "arc_ int, from_ long, upto_ long, shard int, slot_ long")
    # keys of the cells before, in the same arc; in ring order
    before = F.coalesce(F.sum("count").over(Window.partitionBy("arc_").orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col("arc_").alias("arc_c"), F.col("cell_").alias("cell_c"), before.alias("before_"))
    in_cell = Window.partitionBy("arc_", "cell_").orderBy("h_", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank_", F.row_number().over(in_cell) - 1)
    # both are bounded by the ring: at most a row for each cell and arc, and a few runs for each arc
    ranked = ranked.join(F.broadcast(cells), F.col("arc_").eqNullSafe(F.col("arc_c")) & F.col("cell_").eqNullSafe(F.col("cell_c"))).withColumn("rank_", F.col("rank_") + F.col("before_"))
    out = ranked.join(F.broadcast(placed), "arc_").where("rank_ >= from_ AND rank_ < upto_")
    extra = [c for c in rows.columns if c not in {"doc_id", "size", "text_crc32", "h_", "arc_", "cell_"}]
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot_") + F.col("rank_") - F.col("from_")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *extra,
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write every column of ``df`` as one folder of Parquet files per shard, rows in slot order."""
    out = assign_shards(df, carry=tuple(df.columns), **options)
    out.drop("doc_id").withColumnRenamed("in_doc_id", "doc_id").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
