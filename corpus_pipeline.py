"""Corpus pipeline: quality, toxicity, exact copies, near copies, packing.

``run`` writes every stage's documents as Parquet into the shared folder and rereads them as the next
stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import keep_rows, saved, table
from tidebar.llm.op2_packing import pack
from tidebar.llm.op5_exact_dedup import drop_copies
from tidebar.llm.op8_near_dedup import near_groups
from tidebar.llm.op9_quality import quality_scores
from tidebar.llm.op10_toxicity import toxicity_scores

ORACLE_SQL = None  # classifiers and tokens are beyond SQL; tests compare with a brute-force version


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    good = quality_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 1")
    return keep_rows(docs, good)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    good = toxicity_scores(docs, table(spark, sf_dir, "labels")).where("predicted = 0")
    return keep_rows(docs, good)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one document stays."""
    kept = near_groups(docs, words=5).where(F.col("row_kept"))
    return keep_rows(docs, kept, once=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    return pack(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
