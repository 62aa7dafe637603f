"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is a node that holds a run: its distinct digests in order, each with its
smallest identifier and its number of rows. The nodes then exchange runs in binomial rounds. In a
round, nodes whose numbers differ in one base-``fan_in`` digit form a group; each of them takes the
part of the digests that its own digit owns, so a round merges ``fan_in`` runs at a time and every
node keeps a ``fan_in``-th of the digest space. After ``log(nodes) / log(fan_in)`` rounds one node
holds all that is left of a digest. No node ever sees the whole set, and a group of copies, however
large, is one entry in each run: it is reduced before it is sent in every round.

Texts are compared by the SHA-256 of their normalised form with its length in bytes; entries merge
only if both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import saved, table

QUERY = "op5_exact_dedup"
#: Runs that one merge of a round takes in.
FAN_IN = 4
#: Text that counts as one space.
WHITE = r"[\x20\x09-\x0D]+"

ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

#: A null identifier is 0 with no_id 1, so that pandas keeps the longs.
_RUN = "node int, digest binary, n_bytes long, no_id int, keep_id long, keep_row long, n long"


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold entries of equal (node, digest, length), which arrive next to each other, smallest first.

    The last entry of a batch waits for the next batch, so memory holds one batch.
    """
    held: pd.DataFrame | None = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if batch.empty:
            continue
        new = np.ones(len(batch), bool)
        for c in ("node", "digest", "n_bytes"):
            v = batch[c].to_numpy()
            new[1:] &= v[1:] == v[:-1]
        new[1:] = ~new[1:]
        new[0] = True
        at = np.flatnonzero(new)
        out = batch.iloc[at].assign(n=np.add.reduceat(batch["n"].to_numpy(), at))
        held = out.iloc[-1:]
        if len(out) > 1:
            yield out.iloc[:-1]
    if held is not None:
        yield held


def _run(df: DataFrame) -> DataFrame:
    """Sort by Spark's external sort within each partition, then merge equal entries."""
    return df.sortWithinPartitions("node", "digest", "n_bytes", "no_id", "keep_id", "keep_row").mapInPandas(_merge, _RUN)


def digest_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, its node and row number, digest and length; a saved table."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    rows = rows.select(
        "doc_id",
        F.spark_partition_id().alias("node"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
    )
    return saved(rows, "digests")


def merged_runs(rows: DataFrame, nodes: int, fan_in: int = FAN_IN) -> DataFrame:
    """One entry per distinct text: digest, n_bytes, keep_id, keep_row, n."""
    run = _run(
        rows.select(
            "node", "digest", "n_bytes",
            F.col("doc_id").isNull().cast("int").alias("no_id"),
            F.coalesce("doc_id", F.lit(0)).alias("keep_id"),
            F.col("row").alias("keep_row"),
            F.lit(1).cast("long").alias("n"),
        )
    )
    # which of the nodes a digest ends at: its first four bytes, uniform by construction
    target = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    step = 1
    while step < nodes:
        digit = F.floor(target / step) % fan_in
        run = run.withColumn("node", (F.col("node") - (F.floor(F.col("node") / step) % fan_in) * step + digit * step).cast("int"))
        run = _run(run.repartition(nodes, "node"))
        step *= fan_in
    return run.select("digest", "n_bytes", F.when(F.col("no_id") == 0, F.col("keep_id")).alias("keep_id"), "keep_row", "n")


def _nodes(rows: DataFrame) -> int:
    """Nodes that the written rows come from: one for each partition that wrote them."""
    return (rows.agg(F.max("node")).first()[0] or 0) + 1


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """Per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the smallest identifier stays; a null
    identifier stays only if no other row of its group has one. Repeated rows (same identifier and
    text): exactly one is kept. An empty table gives no rows. Other columns are not read.
    """
    rows = digest_rows(df, id_col, text_col)
    kept = merged_runs(rows, _nodes(rows), fan_in)
    # a large group of copies makes a hot key here: adaptive execution splits it on the row side
    return rows.join(kept, ["digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns; of repeated rows one stays."""
    rows = digest_rows(df, id_col, text_col)
    kept = merged_runs(rows, _nodes(rows), fan_in)
    own = saved(
        rows.join(kept, ["digest", "n_bytes"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(F.col("doc_id").alias("_keep_id"), F.col("digest").alias("_keep_digest")).agg(F.count("*").alias("_same")),
        "kept",
    )
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    whole = df.withColumn("_keep_digest_own", F.unhex(F.sha2(norm, 256)))
    out = whole.join(own, whole[id_col].cast("long").eqNullSafe(own["_keep_id"]) & (whole["_keep_digest_own"] == own["_keep_digest"]))
    once = out.where("_same = 1").select(df.columns)
    repeated = out.where("_same > 1").dropDuplicates(["_keep_id", "_keep_digest"]).select(df.columns)
    return once.unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))
