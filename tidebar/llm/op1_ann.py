"""Approximate nearest neighbours by inner product: collision-counting hashing.

Each of ``projections`` random lines has the vectors of a block in one sorted array. A query opens a
window around its own projection in every array; virtual rehashing widens all windows by the same
factor, and only the newly covered ends of the arrays are read. A vector that lies in the window of
enough arrays (the collision threshold) is verified on the original vectors. A query is done when as
many verified vectors as asked for lie within the last radius but one: under windows a step wider, nearly all that are as
near have collided in enough arrays. Where a set share of the block has been
verified and that is not so, lines do not tell its vectors apart, and all the rest is verified: the answer is exact.

Largest inner product becomes smallest distance by one more component: vectors are divided by the
largest norm of their block and filled up to length 1, queries are normalised.

Blocks hold vectors of one range of norms, so that a long vector does not flatten the others. Rows of
a range are dealt out by a hash into blocks of a bounded size, queries into blocks likewise; a task
holds one block of each. Blocks return their best per query, and those are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.llm.common import saved, table

QUERY = "op1_ann"
ORACLE_SQL = None  # approximate; tests measure recall against brute force

PROJECTIONS = 80
#: Width of the windows at radius 1, and the share of arrays in which a vector must collide. A vector
#: at the radius collides in an array with probability 0.826 (a normal variable within 1.36).
WIDTH, THRESHOLD = 2.72, 0.80
#: First radius and factor of virtual rehashing; distances are at most 2.
RADIUS, FACTOR = 0.7, 1.15
#: Share of a block after which the rest is verified too.
VERIFIED = 0.3
#: Norms of a block differ by this factor at most; ranges end at so many factors above and below 1.
NORMS, RANGES = 1.25, 3500
#: Rows and queries of a block.
BLOCK, QUERY_BLOCK = 16384, 1024
NEAREST = 20


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        longest = float(np.sqrt((self.vectors * self.vectors).sum(axis=1)).max()) or 1.0
        unit = self.vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        self.unit = np.column_stack([unit, rest])
        self.lines = np.random.Generator(np.random.PCG64(7)).standard_normal((self.unit.shape[1], projections))
        at = self.unit @ self.lines
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()  # of the width that counting takes without a copy
        self.sorted = np.take_along_axis(at, self.order.T, axis=0).T.copy()
        self.longest = longest
        self.short = self.vectors.astype(np.float32)

    def search(self, vectors: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, inner products) of the nearest found, nearest first; ties to the smaller id."""
        n, m = len(self.ids), len(self.sorted)
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        at = np.column_stack([vectors / lengths[:, None], np.zeros(len(vectors))]) @ self.lines
        need = math.ceil(THRESHOLD * m)
        others = n - np.isin(own, self.ids)
        enough = k + math.ceil(VERIFIED * n)
        lo = np.column_stack([np.searchsorted(s, at[:, j]) for j, s in enumerate(self.sorted)])
        hi = lo.copy()
        hits = np.zeros((len(vectors), n), np.int16)
        rows = [np.zeros(0, np.int64) for _ in vectors]
        products = [np.zeros(0, np.float32) for _ in vectors]  # they order; scores are made anew
        short = vectors.astype(np.float32)
        active = list(range(len(vectors)))
        radius = RADIUS
        while active and radius <= 2 * FACTOR:
            half = WIDTH / 2 * radius
            near = (1 - (radius / FACTOR) ** 2 / 2) * lengths * self.longest  # inner products within the last radius but one
            a = np.column_stack([np.searchsorted(s, at[active, j] - half, "left") for j, s in enumerate(self.sorted)])
            b = np.column_stack([np.searchsorted(s, at[active, j] + half, "right") for j, s in enumerate(self.sorted)])
            going = []
            for i, q in enumerate(active):
                ends = zip(self.order, a[i].tolist(), lo[q].tolist(), hi[q].tolist(), b[i].tolist(), strict=True)
                new = np.concatenate([part for o, a_, l_, h_, b_ in ends for part in (o[a_:l_], o[h_:b_])])
                before = hits[q]
                now = before + np.bincount(new, minlength=n).astype(np.int16)
                fresh = np.flatnonzero((now >= need) & (before < need))
                lo[q], hi[q], hits[q] = a[i], b[i], now
                fresh = fresh[self.ids[fresh] != own[q]]
                if len(fresh):
                    rows[q] = np.concatenate([rows[q], fresh])
                    products[q] = np.concatenate([products[q], self.short[fresh] @ short[q]])
                if (products[q] >= near[q]).sum() >= k:
                    continue
                if len(rows[q]) < min(enough, others[q]):
                    going.append(q)
                else:
                    self._all(q, own, rows, products, short)
            active = going
            radius *= FACTOR
        for q in active:  # the radius was not reached
            self._all(q, own, rows, products, short)
        out = []
        for q in range(len(vectors)):
            if len(rows[q]) > k:  # all that rounding could put among the nearest, ties too
                least = np.partition(products[q], -k)[-k] - 1e-5 * lengths[q] * self.longest
                rows[q] = rows[q][products[q] >= least]
            score = (self.vectors[rows[q]] * vectors[q]).sum(axis=1)
            best = np.lexsort((self.ids[rows[q]], -score))[:k]
            out.append((self.ids[rows[q][best]], score[best]))
        return out

    def _all(self, q: int, own: np.ndarray, rows: list[np.ndarray], products: list[np.ndarray], short: np.ndarray) -> None:
        rows[q] = np.flatnonzero(self.ids != own[q])
        products[q] = self.short[rows[q]] @ short[q]


def _search_blocks(projections: int, k: int):
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            block = Block(rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float), projections)
            own = queries["vec_id"].to_numpy()
            for at in range(0, len(own), 256):
                part = own[at : at + 256]
                asked = np.stack(queries["v"].iloc[at : at + 256].to_numpy()).astype(float)
                for q, (ids, products) in zip(part, block.search(asked, part, k), strict=True):
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": products}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def nearest(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, projections: int = PROJECTIONS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that ``is_query`` (a condition), its nearest others.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without identifier; vectors of different lengths do not meet. Identifiers are unique; of queries
    that repeat one, any is asked, and rows that bear the query's identifier are no candidates.
    Fewer than ``k`` candidates: all of them. An empty table gives no rows.
    """
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = saved(rows.withColumn("norm", norm), "vectors")
    place = F.coalesce(F.round(F.log("norm") / math.log(NORMS)), F.lit(-RANGES))
    ranged = rows.withColumn("range", F.least(F.greatest(place, F.lit(-RANGES)), F.lit(RANGES)).cast("int"))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).orderBy("range").collect()
    asked, blocks, first, parts = sum(r["asked"] for r in counts), 0, {}, {}
    for r in counts:
        first[r["range"]], parts[r["range"]] = blocks, -(-r["n"] // block)
        blocks += parts[r["range"]]
    query_blocks = max(1, -(-asked // query_block))
    told = lambda of: F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("range")] if of else F.lit(1)
    deal = lambda parts: F.pmod(F.xxhash64("vec_id"), parts).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    base = ranged.select("vec_id", "v", F.size("v").alias("dim"), (told(first) + deal(told(parts))).alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.where("asks").dropDuplicates(["vec_id"]).select("vec_id", "v", F.size("v").alias("dim"), deal(F.lit(query_blocks)).alias("query_block"), every(blocks).alias("block"))
    keys = ["block", "query_block", "dim"]
    found = base.groupBy(keys).cogroup(queries.groupBy(keys)).applyInPandas(_search_blocks(projections, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
