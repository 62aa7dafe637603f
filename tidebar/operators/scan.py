"""Running values and places over long series in two levels, so that no task sorts a whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.scratch import written
from tidebar.timeframes import bucket

#: kind -> (value within a block up to the row, value of a whole block, how blocks add up)
_KINDS = {
    "sum": (F.sum, F.sum, F.sum),
    "max": (F.max, F.max, F.max),
    "max_before": (F.max, F.max, F.max),
    "min": (F.min, F.min, F.min),
}


def block_scan(df: DataFrame, keys: list[str], time: str, ties: list[str], block_ms: int, scans: dict[str, tuple[str, Column]], keep_block: bool = False, shared: bool = False) -> DataFrame:
    """``df`` with running values per key in the order of ``time`` and ``ties``, which must be total within a time.

    ``scans``: name -> (kind, value). ``sum``, ``max`` and ``min`` run over the rows up to and with a row and ignore nulls;
    ``last`` is the last value that is not null; ``lag`` and ``lead`` are the value of the row before and after, null as it is.

    ``max_before`` is the largest value of the rows before a row.

    A row looks within its block of time; what lies before (for ``lead`` after) the block comes from a table of one row
    per block, over which alone the key's window runs. It joins the block's rows as a row of its own at the block's
    edge, so that rows are shuffled once; with ``keep_block`` a plan that goes on by key and ``_block`` does not shuffle
    them again. Rows of one block are one task's sort.

    ``df`` is read twice. With ``shared`` both readings stand in one plan and read the same columns, so that Spark makes
    the shuffles below ``df``, as those of a join, once; else the table of blocks is written, which keeps scans over scans small.
    """
    order = [time, *ties]
    block = [*keys, "_block"]
    rows = df.withColumn("_block", bucket(F.col(time), block_ms)).withColumns({f"_v_{n}": F.struct(v.alias("v")) if k in ("lag", "lead") else v for n, (k, v) in scans.items()})
    at = F.struct(*order)
    whole, carry = [], {}
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    for n, (kind, _) in scans.items():
        v, c = F.col(f"_v_{n}"), f"_c_{n}"
        if kind in _KINDS:
            whole.append(_KINDS[kind][1](v).alias(c))
            carry[c] = _KINDS[kind][2](c).over(before)
        elif kind == "lead":
            whole.append(F.min_by(v, at).alias(c))
            carry[c] = F.first(c).over(after)
        else:
            whole.append(F.max_by(v, F.when(v.isNotNull(), at)).alias(c))
            carry[c] = F.last(c, ignorenulls=True).over(before)
    if shared:
        # ties, which the blocks do not need, are read too, as a 0: shuffles that differ by a column are not shared
        blocks = rows.groupBy(*block).agg(*whole, F.max(F.hash(*order) % 1).alias("_read")).where("_read IS NOT NULL").withColumns(carry)
    else:
        blocks = written(rows.groupBy(*block).agg(*whole).withColumns(carry), "blocks")
    edges = rows.withColumn("_edge", F.lit(0))
    for edge, has in ((-1, lambda k: k != "lead"), (1, lambda k: k == "lead")):
        own = [n for n, (kind, _) in scans.items() if has(kind)]
        if own:
            edges = edges.unionByName(blocks.select(*block, F.lit(edge).alias("_edge"), *[F.col(f"_c_{n}").alias(f"_v_{n}") for n in own]), allowMissingColumns=True)
    within = Window.partitionBy(*block).orderBy("_edge", *order)
    upto, past = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    out = {}
    for n, (kind, _) in scans.items():
        v = F.col(f"_v_{n}")
        if kind == "lag":
            out[n] = F.lag(v).over(within)["v"]
        elif kind == "lead":
            out[n] = F.lead(v).over(within)["v"]
        else:
            out[n] = F.max(v).over(past) if kind == "max_before" else F.last(v, ignorenulls=True).over(upto) if kind == "last" else _KINDS[kind][0](v).over(upto)
    return edges.withColumns(out).where("_edge = 0").select(*df.columns, *out, *(["_block"] if keep_block else []))


def global_rank(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place in a total order over all rows, from 1.

    Rows are dealt into ranges of the order and counted; a range's places start after the rows of the ranges before
    it. Only the counts, one a partition, come to the driver.
    """
    df = written(df, "rows")  # ranges are drawn from a sample: what ``df`` is made of is computed once
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    offsets, total = [], 0
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():  # as many as partitions
        offsets.append((r["_range"], total))
        total += r["count"]
    start = df.sparkSession.createDataFrame(offsets, "_range int, _start long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.withColumn("_own", own).join(F.broadcast(start), "_range")
    return placed.select(*df.columns, (F.col("_start") + F.col("_own")).alias(name))
