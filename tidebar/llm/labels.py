"""Labelled rows for the classifiers: who may be learned from, and small fits on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(id_col, n: int):
    """crc32 of the identifier as text, modulo ``n``; null identifiers count as empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % n


def learnable(labels: DataFrame, label: str, ok) -> DataFrame:
    """(doc_id, y) of the labels that may be learned from; several labels of one document: the largest.

    ``ok`` is a function of the id column. Null identifiers and labels other than 0 and 1 are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    return rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ok(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the constant first) of a ridge logistic regression, by Newton's steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    prior = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    w[0] = np.log(prior / (1 - prior))
    if len(set(y.tolist())) > 1:
        for _ in range(rounds):
            p = sigmoid(a @ w)
            h = (a * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
            w = w + np.linalg.solve(h, a.T @ (y - p) - ridge * w)
    return mean, scale, w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
