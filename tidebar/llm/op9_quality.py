"""Document quality by a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics of the text. Class covariances are shrunk
towards the pooled covariance and towards the identity; their Cholesky factors are made once and
sent to the tasks, and a score is the logistic of the difference of the classes' log densities
(Mahalanobis distance, log determinant, log prior).

The classes' moments are sums over all labelled rows, made in Spark; the driver sees as many numbers
as the statistics have pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import id_and_text, saved, table
from tidebar.llm.labels import fold, learnable, sigmoid

QUERY = "op9_quality"
ORACLE_SQL = None  # a fitted classifier; tests hold it against closed-form scores and held-out accuracy

#: Weight of the pooled covariance, and of the identity, in a class's covariance.
POOLED, RIDGE = 0.1, 0.02
#: Rows that each class counts as at least, so that one without rows has a density.
PRIOR_ROWS = 1.0

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "spread_word", "short_words", "long_words", "distinct_words",
    "upper", "digits", "punctuation", "marks", "symbols", "lines", "distinct_lines", "entropy", "non_ascii",
)
_D = len(STATISTICS)


def _classes() -> np.ndarray:
    """Per byte: 1 upper, 2 lower, 3 digit, 4 white, 5 usual punctuation, 6 ! and ?, 7 other ASCII, 8 non-ASCII."""
    out = np.full(256, 7)
    out[65:91], out[97:123], out[48:58], out[128:] = 1, 2, 3, 8
    out[[0x20, 9, 10, 11, 12, 13]] = 4
    out[list(b".,;:'\"()-")] = 5
    out[list(b"!?")] = 6
    return out


_CLASS = _classes()


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; all finite, also for an empty one."""
    raw = text.encode()
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=hist, minlength=9)
    n = max(1, len(raw))
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = raw.split(b"\n")
    p = hist[hist > 0] / n
    share = lambda k: float(np.sqrt(kinds[k] / n))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        float(np.sqrt((lengths <= 2).mean())), float(np.sqrt((lengths >= 12).mean())),
        float(np.log1p(len(set(words))) / np.log1p(m)),
        share(1), share(3), share(5), share(6), share(7),
        float(np.sqrt(hist[10] / n)), float(len(set(lines)) / len(lines)),
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, share(8),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "row", "x"])


@dataclass
class Discriminant:
    """Class means, Cholesky factors, and constants (log prior minus half the log determinant)."""

    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0, with priors."""
        z = (x - self.mean) / self.scale
        out = []
        for k in (0, 1):
            y = np.linalg.solve(self.factors[k], (z - self.centres[k]).T)
            out.append(self.constants[k] - 0.5 * (y * y).sum(axis=0))
        return out[1] - out[0]


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From each class's (rows, sums, sums of products)."""
    zero = (0.0, np.zeros(_D), np.zeros((_D, _D)))
    n, s, q = (np.array([np.asarray(moments.get(k, zero)[i]) for k in (0, 1)]) for i in range(3))
    total = max(1.0, n.sum())
    mean = s.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(q.sum(axis=0)) / total - mean**2, 1e-12)) + 1e-6
    centres, scatter = [], []
    for k in (0, 1):
        m = s[k] / n[k] if n[k] else mean
        c = q[k] / n[k] - np.outer(m, m) if n[k] else np.diag(scale**2)
        centres.append((m - mean) / scale)
        scatter.append(c / np.outer(scale, scale))
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / total if n.sum() else np.eye(_D)
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - POOLED - RIDGE) * scatter[k] + POOLED * pooled + RIDGE * np.eye(_D)
        l = np.linalg.cholesky((c + c.T) / 2)  # noqa: E741
        factors.append(l)
        constants.append(np.log((n[k] + PRIOR_ROWS) / (total + 2 * PRIOR_ROWS)) - np.log(np.diag(l)).sum())
    return Discriminant(mean, scale, np.array(centres), np.array(factors), np.array(constants))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums of 1, x and x x' by class, over all rows of (x, y)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + _D + _D * _D))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, _D)
            y = np.array(batch.column("y").to_pylist())
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(sums.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(at)), pa.int32()), pa.array(np.tile(at, 2), pa.int32()), pa.array(sums.ravel())], names=["y", "at", "v"])

    rows = labelled.select("x", "y").mapInArrow(partial, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()  # 2 * (1 + d + d * d) rows
    out = np.zeros((2, 1 + _D + _D * _D))
    for r in rows:
        out[r["y"], r["at"]] = r["v"]
    return {k: (out[k, 0], out[k, 1 : 1 + _D], out[k, 1 + _D :].reshape(_D, _D)) for k in (0, 1) if out[k, 0]}


def _score(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, _D)
            p = sigmoid(model.log_ratio(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(p)], names=["doc_id", "row", "score"])

    return run


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, held_out, score, predicted, text_key.

    Labels are learned only from documents whose crc32(doc_id as text) mod 3 is not 1. Null and empty
    texts are scored by their statistics. Rows without identifier are scored, never learned from;
    repeated rows get equal scores. With labels of one class only, its prior decides. An empty table
    gives no rows. Columns other than identifier and text are not read.
    """
    docs = id_and_text(df, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    found = saved(docs.mapInArrow(_measure, "doc_id long, row long, x array<double>"), "statistics")
    known = learnable(labels, "quality", lambda c: fold(c, 3) != 1)
    model = fit(moments(found.join(known, "doc_id")))
    out = found.mapInArrow(_score(model), "doc_id long, row long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("row").alias("text_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")
