"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine, connected components.

1. Equal vectors of one label collapse to one node, so copies cost nothing further.
2. Each table hashes a node to the signs of its products with ``bits`` random hyperplanes. ``bits`` grows with
   the logarithm of the largest label, so that buckets of vectors that have nothing in common stay small at every
   size; the number of tables follows from it, so that a pair at the threshold shares a bucket with a
   probability of at least ``1 - miss``. Only keys and node numbers are shuffled; keys of one node end there.
3. Nodes of a bucket whose sketches (128 more signs) differ in few enough places are joined. A
   bucket of more than ``block`` nodes is joined as it stands. What is connected so is a family: a superset of the
   components looked for, cut finely enough that its vectors can be compared.
4. Families are cut into blocks and all pairs of blocks multiplied; the cosine of every pair of a family is taken in double
   precision. Only numbers of links per node and edges of a spanning forest leave a task, never pairs.
5. Components of these edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.blocks import bounds, whole_groups
from tidebar.llm.common import drop_saved, saved, table
from tidebar.llm.components import components

QUERY = "op11_vector_dedup"
ORACLE_SQL = None  # all pairs of a label are too slow in SQL on whole tables; tests compare with brute force

COSINE = 0.98
#: Probability that a pair at the threshold shares no bucket.
MISS = 1e-5
#: Bits of a key beyond the logarithm of the largest label's number of nodes.
SPARE_BITS = 4
SKETCH = 128
#: Nodes of a bucket that are compared by sketch, and of a block of a family.
BLOCK = 2048
#: Numbers of repeated vectors, and of nodes in families, are broadcast up to so many (1.6 MB).
FEW = 100_000
SEED = 20


def plan_tables(nodes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits of a key, number of tables) for labels of up to ``nodes`` nodes."""
    bits = max(4, math.ceil(math.log2(max(nodes, 2)))) + SPARE_BITS
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def sketch_radius(cosine: float = COSINE, miss: float = MISS) -> int:
    """Least number of differing signs that a pair at the threshold exceeds with a probability of at most ``miss`` / 10."""
    p, tail = math.acos(cosine) / math.pi, 1.0
    for differ in range(SKETCH + 1):
        tail -= math.comb(SKETCH, differ) * p**differ * (1 - p) ** (SKETCH - differ)
        if tail <= miss / 10:
            return differ
    return SKETCH


class Planes:
    """Hyperplanes of one number of dimensions."""

    def __init__(self, dim: int, bits: int, tables: int) -> None:
        normal = np.random.Generator(np.random.PCG64((SEED, dim))).standard_normal((dim, bits * tables + SKETCH))
        self.keys, self.sketch, self.tables = normal[:, SKETCH:], normal[:, :SKETCH], tables
        #: Random odd factors mix a key's signs into 64 bits.
        self.factors = np.random.Generator(np.random.PCG64((SEED, dim, 1))).integers(1 << 62, size=(tables, bits + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hash(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, one column a table; sketches, two longs) of vectors."""
        signs = (v @ self.keys > 0).reshape(len(v), self.tables, -1).astype(np.uint64)
        keys = (signs * self.factors[:, 1:]).sum(axis=2, dtype=np.uint64) + self.factors[:, 0]
        sketch = np.packbits(v @ self.sketch > 0, axis=1).view(np.int64)
        return keys.view(np.int64), sketch


def _hashed(bits: int, tables: int):
    """Rows (row, label, v) to (row, label, keys, s0, s1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, Planes] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, v = part.num_rows, part.column("v")
                flat, ends = np.asarray(v.flatten(), float), np.asarray(v.offsets)
                sizes = np.diff(ends)
                keys, sketch = np.zeros((n, tables), np.int64), np.zeros((n, 2), np.int64)
                for dim in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == dim)
                    if dim not in planes:
                        planes[dim] = Planes(dim, bits, tables)
                    keys[own], sketch[own] = planes[dim].hash(_scaled(flat[(ends[own] - ends[0])[:, None] + np.arange(dim)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("label"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(keys.ravel())), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                    names=["node", "label", "dim", "keys", "s0", "s1"],
                )

    return run


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


class _Forest:
    """Union-find over the places of one group."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric adjacency matrix, breadth first: every place is visited once."""
    left, out = np.ones(len(near), bool), []
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & left)
            left[new] = False
            todo += new.tolist()
            out += [(i, j) for j in new.tolist()]
    return out


def _bucket_edges(radius: int):
    """Rows (key, node, s0, s1), ordered by key, to edges between nodes whose sketches are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["key"]):
            node, s = rows.column("node").to_numpy(), np.column_stack([rows.column("s0").to_numpy(), rows.column("s1").to_numpy()]).view(np.uint64)
            at = bounds(rows.column("key").to_numpy())
            two = at[:-1][np.diff(at) == 2]
            two = two[np.bitwise_count(s[two] ^ s[two + 1]).sum(axis=1) <= radius]
            a, b = [node[two]], [node[two + 1]]
            for lo, hi in zip(at[:-1][np.diff(at) > 2].tolist(), at[1:][np.diff(at) > 2].tolist(), strict=True):
                own = s[lo:hi]
                near = sum(np.bitwise_count(own[:, None, k] ^ own[None, :, k]) for k in (0, 1)) <= radius
                if edges := _spanning(near):
                    i, j = np.array(edges).T
                    a.append(node[lo + i])
                    b.append(node[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _family_links(cosine: float):
    """Rows (family, i, j, side, node, copies, v), ordered by block, to (node, links) and edges (node, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["family", "i", "j"]):
            node, copies, side = (rows.column(c).to_numpy() for c in ("node", "copies", "side"))
            v = rows.column("v").combine_chunks()
            flat, ends = np.asarray(v.flatten(), float), np.asarray(v.offsets)
            own = [rows.column(c).to_numpy() for c in ("family", "i", "j")]
            at, blocks = bounds(*own), own[1] == own[2]
            nodes, links, others = [], [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x = _scaled(flat[ends[lo] - ends[0] : ends[hi] - ends[0]].reshape(hi - lo, -1))
                length = np.sqrt((x * x).sum(axis=1))
                if blocks[lo]:
                    left = right = np.arange(hi - lo)
                else:
                    left, right = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
                near = (x[left] @ x[right].T) / (length[left][:, None] * length[right]) >= cosine
                if blocks[lo]:
                    np.fill_diagonal(near, False)
                    found = near @ copies[lo:hi]
                    edges = _spanning(near)
                    told = left
                else:
                    found = np.concatenate([near @ copies[lo + right], near.T @ copies[lo + left]])
                    told = np.concatenate([left, right])
                    edges = _two_sided(near, left, right)
                some = np.flatnonzero(found)
                nodes += node[lo + told[some]].tolist() + [int(node[lo + i]) for i, _ in edges]
                links += found[some].tolist() + [None] * len(edges)
                others += [None] * len(some) + [int(node[lo + j]) for _, j in edges]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(others, pa.int64())], names=["node", "links", "other"])

    return run


def _two_sided(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest between two blocks."""
    forest, out = _Forest(len(left) + len(right)), []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        for j in np.flatnonzero(near[i]).tolist():
            if forest.join(i, len(left) + j):
                out.append((int(left[i]), int(right[j])))
    return out


def _in(df: DataFrame, column: str, these: DataFrame, of: str, how: str) -> DataFrame:
    """Semi or anti join; ``these`` (a written table) is broadcast if it is counted to be small."""
    own = these.select(F.col(of).alias(column))
    return df.join(F.broadcast(own) if these.count() <= FEW else own, column, how)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Per row of ``df``: vec_id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and not null, their vectors equally long, and the cosine
    is at least ``cosine``. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing. n_links counts other rows, repeated rows and identifiers among them;
    component_id is the smallest identifier reachable, null only if no row of the component has one. An empty table
    gives no rows. Other columns are not read.
    """
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("v", lambda x: x != 0)
    read = df.select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(label_col).alias("label"), F.col(label_col).isNotNull().alias("named"), F.col(vector_col).alias("v"))
    read = read.withColumn("links", F.col("named") & finite).withColumn("row", F.monotonically_increasing_id())
    digest = F.xxhash64("v").alias("d0"), F.xxhash64(F.lit(1), "v").alias("d1")  # 128 bits that stand for a vector
    rows = saved(read.select("row", "vec_id", "label", "links", *digest, F.when(F.col("links"), F.col("v")).alias("v")), "vectors")
    linking = rows.where("links")
    same = ["label", "d0", "d1"]
    first = F.min(F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "row")).alias("first")
    nodes = linking.groupBy(*same).agg(first, F.count("*").alias("copies"))
    nodes = saved(nodes.select(F.col("first.row").alias("node"), "first.vec_id", *same, "copies"), "nodes")
    most = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan_tables(most, cosine, miss)
    # the vectors of nodes: rows that repeat one go, found from the groups of more than one row
    many = nodes.where("copies > 1")
    repeated = saved(linking.join(many.select(*same, "node"), same).where("row <> node").select("row"), "repeated")
    own = _in(linking, "row", repeated, "row", "left_anti").select("row", "label", "v")
    hashed = own.mapInArrow(_hashed(bits, tables), "node long, label long, dim int, keys array<long>, s0 long, s1 long")
    keys = hashed.select("node", "label", "dim", F.posexplode("keys").alias("t", "k")).select("node", F.xxhash64("label", "dim", "t", "k").alias("key"))
    # counted first, so that a key of very many nodes is added up before it is shuffled, and split in the join
    shared = saved(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "shared")
    buckets = saved(keys.join(shared, "key"), "buckets")
    large = buckets.where((F.col("n") > block) & (F.col("node") != F.col("head"))).select(F.col("head").alias("a"), F.col("node").alias("b"))
    small = buckets.where(F.col("n") <= block).select("key", "node")
    signed = _in(own, "row", saved(small.select("node").distinct(), "sharing"), "node", "left_semi").mapInArrow(_hashed(bits, 1), "node long, label long, dim int, keys array<long>, s0 long, s1 long").select("node", "s0", "s1")
    compared = small.join(signed, "node").repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges(sketch_radius(cosine, miss)), "a long, b long")
    edges = saved(compared.distinct().unionByName(large), "candidates")
    drop_saved(buckets)
    families = components(edges).toDF("node", "family")
    families = saved(families.join(nodes.select("node", "copies"), "node"), "families")
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / block).alias("parts"))
    place = families.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    other = place.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    place = other.select("node", "family", "copies", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    vectors = _in(own, "row", families, "node", "left_semi").select(F.col("row").alias("node"), "v")
    blocks = place.join(vectors, "node").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    found = saved(blocks.select("family", "i", "j", "side", "node", "copies", "v").mapInArrow(_family_links(cosine), "node long, links long, other long"), "links")
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("others"))
    # of every component the smallest identifier, then back to all rows by their vectors
    known = nodes.join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = known.where("root <> node OR others IS NOT NULL")
    least = saved(joined.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least")
    joined = joined.join(least, "root").select("node", "component_id", "others")
    told = saved(many.select("node", "vec_id", "copies", *same).join(joined, "node", "full_outer"), "told")
    # rows outside linked groups and copies keep their own identifier
    single = rows.select("row", "vec_id").join(told.where("copies IS NULL").select(F.col("node").alias("row"), "component_id", "others"), "row", "left")
    single = _in(single, "row", repeated, "row", "left_anti").join(told.where("copies > 1").select(F.col("node").alias("row")), "row", "left_anti")
    single = single.select("vec_id", F.coalesce("others", F.lit(0)).alias("n_links"), F.when(F.col("others").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    groups = told.where("copies > 1").select(*same, (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("others").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    copies = linking.select("vec_id", *same).join(groups, same).select("vec_id", "n_links", "component_id")
    return single.unionByName(copies).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
