"""What the training-data operators share: scratch tables in the shared folder and table reading."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.scratch import scratch_path


def _delete(spark: SparkSession, path: str) -> None:
    """Remove one scratch table by Spark's own file system, wherever the shared folder is."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: an executor that is lost later costs no recomputation of ``df``, and
    what several later plans read is computed once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    atexit.register(_delete, df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidebar_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete a table made by ``saved`` that no later plan reads."""
    if path := getattr(df, "_tidebar_path", None):
        _delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``doc_id`` and ``text`` (null: empty) only, whatever else ``df`` has."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keep_rows(df: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text", once: bool = False) -> DataFrame:
    """The rows of ``df`` whose identifier and text are in ``kept`` (doc_id, text_key), all columns.

    ``text_key`` is xxhash64 of the text, null counting as empty. ``once``: of repeated rows (same
    identifier and text) one stays.
    """
    own = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key")).distinct()
    whole = df.withColumn("_own_key", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = whole.join(own, (F.col("_own_key") == F.col("_kept_key")) & whole[id_col].cast("long").eqNullSafe(F.col("_kept_id")), "left_semi")
    if not once:
        return out.select(df.columns)
    # rows that are repeated are few or many; only they are dealt out by their key
    counts = whole.groupBy("_own_key", F.col(id_col).alias("_rep_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_own_key", "_rep_id")
    counts = saved(counts, "repeated")
    if counts.isEmpty():
        return out.select(df.columns)
    same = (out["_own_key"] == counts["_own_key"]) & out[id_col].eqNullSafe(counts["_rep_id"])
    single = out.join(counts, same, "left_anti").select(df.columns)
    repeated = out.join(counts, same, "left_semi").dropDuplicates([id_col, "_own_key"]).select(df.columns)
    return single.unionByName(repeated)
