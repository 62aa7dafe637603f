"""MinHash near-deduplication: one-permutation hashing, banded buckets, star-shaped candidates.

1. Every text's shingle set becomes a signature by one-permutation hashing with optimal
   densification. Texts with the same set collapse to one node, so copies cost nothing further.
2. Bands of the signature make buckets. A bucket of n nodes gives n - 1 candidates: a star from its
   smallest node. Candidates are confirmed on full sets.
3. Components of the confirmed links. A bucket that still holds several components may hide a link
   that its star could not see. All nodes of such buckets whose largest component is the same one form
   a family. Within a family every node outside that component is compared with every node of
   another component, by counting common shingles over an inverted index. Families are cut into
   blocks of a bounded size, and only links leave a block, never pairs.

The bands find a pair at the threshold with a probability of 1 - (1 - 0.8**5)**32, over 0.999997.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import drop_saved, saved, table
from tidebar.llm.components import components
from tidebar.llm.shingles import band_keys, fingerprint, shingle_sets, signatures

QUERY = "op8_near_dedup"
ORACLE_SQL = None  # too slow in SQL on whole tables; tests compare with brute force

WORDS = 4
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 80
BANDS, ROWS = 32, 5
#: Nodes of a block of a family, and shingles of all its nodes.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20

_SKETCH = "doc_id long, row long, text_key long, n_shingles long, key_a long, key_b long, bands array<long>"


def _sketch(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets([t.encode() for t in part.column("text").to_pylist()], words)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), bands), np.int64)
                if full:
                    keys[full] = band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows)
                marks = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("row"), part.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                    ],
                    names=["doc_id", "row", "text_key", "n_shingles", "key_a", "key_b", "bands"],
                )

    return run


def _confirm(words: int, percent: int):
    """Candidate rows with both texts to those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            heads, texts = batch.column("a").to_pylist(), batch.column("text_b").to_pylist()
            sets: list[np.ndarray] = []
            for at in range(0, len(texts), 256):
                sets += shingle_sets([t.encode() for t in texts[at : at + 256]], words)
            ok = []
            for i, s in enumerate(sets):
                if heads[i] != last:
                    last, last_set = heads[i], shingle_sets([batch.column("text_a")[i].as_py().encode()], words)[0]
                both = len(np.intersect1d(last_set, s, assume_unique=True))
                ok.append(100 * both >= percent * (len(last_set) + len(s) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _block_links(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between (node, root, set) entries of different roots, by an inverted index over ``right``."""
    sizes = np.array([len(s) for _, _, s in right])
    roots = np.array([r for _, r, _ in right])
    shingles = np.concatenate([s for _, _, s in right])
    owners = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(shingles, kind="stable")
    shingles, owners = shingles[order], owners[order]
    out = []
    for node, root, s in left:
        lo, hi = np.searchsorted(shingles, s, "left"), np.searchsorted(shingles, s, "right")
        n = hi - lo
        # places of all postings of the set's shingles
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owners[at], minlength=len(right))
        for k in np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (roots != root)).tolist():
            out.append((node, right[k][0]))
    return out


def _family_links(words: int, percent: int):
    """Rows (g, lb, rb, side, node, root, text), ordered by block and side, to the blocks' links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for batch in _and_end(batches):
            rows = [] if batch is None else zip(*(batch.column(c).to_pylist() for c in ("g", "lb", "rb", "side", "node", "root")), shingle_sets([t.encode() for t in batch.column("text").to_pylist()], words), strict=True)
            found: list[tuple[int, int]] = []
            for g, lb, rb, side, node, root, s in rows:
                if (g, lb, rb) != now:
                    if sides[0] and sides[1]:
                        found += _block_links(*sides, percent)
                    now, sides = (g, lb, rb), ([], [])
                sides[side].append((node, root, s))
            if batch is None and sides[0] and sides[1]:
                found += _block_links(*sides, percent)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _and_end(batches: Iterator) -> Iterator:
    """The batches in parts of 256 rows, then None."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)
    yield None


def _shared(buckets: DataFrame) -> DataFrame:
    """Only keys of several nodes: most have one and end here. One shuffle serves both uses."""
    dealt = buckets.repartition("key")
    many = dealt.groupBy("key").agg(F.count("*").alias("n_")).where("n_ > 1").select("key")
    return dealt.join(many, "key")


def _stars(buckets: DataFrame) -> DataFrame:
    """A candidate from each bucket's smallest node to each other one. buckets: key, node."""
    heads = buckets.groupBy("key").agg(F.min("node").alias("a"))
    return buckets.join(heads, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _families(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(g, node, root): nodes of buckets with several components, by the root of the bucket's largest one."""
    held = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    parts = held.groupBy("key", "root").agg(F.count("*").alias("n_"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n_", "root")).alias("top_"), F.count("*").alias("parts_")).where("parts_ > 1").select("key", F.col("top_.root").alias("g"))
    return held.join(mixed, "key").select("g", "node", "root").distinct()


def _blocks(family: DataFrame, block: int, shingles: int) -> DataFrame:
    """Each family (g, node, root, n_shingles) dealt into blocks: side 0 has the nodes outside its component g, side 1 all of them."""
    outside = F.col("root") != F.col("g")
    parts = lambda n, held: F.greatest(F.ceil(n / block), F.ceil(held / shingles))
    left = parts(F.count_if(outside), F.coalesce(F.sum(F.when(outside, F.col("n_shingles"))), F.lit(0)))
    sizes = family.groupBy("g").agg(left.alias("n_l"), parts(F.count("*"), F.sum("n_shingles")).alias("n_r"))
    f = family.join(sizes, "g").where("n_l > 0")
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = f.where("root <> g").select("g", own(F.col("n_l")).alias("lb"), every("n_r").alias("rb"), F.lit(0).alias("side"), "node", "root")
    right = f.select("g", every("n_l").alias("lb"), own(F.col("n_r")).alias("rb"), F.lit(1).alias("side"), "node", "root")
    return left.unionByName(right)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row of ``df``: doc_id, n_shingles, component_id, kept, and text_key, row_kept.

    Letters A-Z are lower-cased; words are parted by space and \\x09 to \\x0D. Null and empty texts
    have an empty set and are linked with nothing. component_id is the smallest doc_id reachable
    over links; null only if no document of the component has an identifier. Of repeated rows all
    are ``kept`` that bear the component's identifier, and exactly one row of each component is
    ``row_kept``. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    docs = saved(read.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sketch(words, bands, rows), _SKETCH), "sketches")
    named = docs.where("n_shingles > 0")
    # one node for each distinct set; its number is a row's, its text the row's of the smallest doc_id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_key")).alias("first")
    nodes = named.groupBy("n_shingles", "key_a", "key_b").agg(first)
    nodes = saved(nodes.select(F.col("first.row").alias("node"), "first.doc_id", "first.text_key", "n_shingles", "key_a", "key_b"), "nodes")
    own = named.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.posexplode("bands").alias("band", "own"))
    buckets = saved(_shared(own.select("node", F.xxhash64("band", "own").alias("key"))), "buckets")
    # from here on only nodes that share a band with another one matter
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("id_"), F.col("text_key").alias("text_key_"))
    texts = read.join(wanted, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("text_key_"))).select("node", "text")
    texts = saved(texts.dropDuplicates(["node"]), "texts")
    full = _stars(buckets).join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    links = saved(full.sortWithinPartitions("a").mapInArrow(_confirm(words, percent), "a long, b long"), "links")
    roots = saved(components(links), "roots")
    sized = _families(buckets, roots).join(nodes.select("node", "n_shingles"), "node")
    blocks = _blocks(saved(sized, "families"), block, shingles)
    place = ["g", "lb", "rb"]
    dealt = blocks.join(texts, "node").repartition(*place).sortWithinPartitions(*place, "side")
    more = saved(dealt.select(*place, "side", "node", "root", "text").mapInArrow(_family_links(words, percent), "a long, b long"), "links")
    if not more.isEmpty():
        roots = saved(components(links.unionByName(more)), "roots")
    drop_saved(buckets)
    drop_saved(texts)
    # the smallest document of every component, then back to all rows by their sets
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("best"))
    placed = placed.join(best, "root").select("n_shingles", "key_a", "key_b", F.col("best.doc_id").alias("component_id"), F.col("best.node").alias("best_row"))
    linked = named.join(placed, ["n_shingles", "key_a", "key_b"]).select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", (F.col("row") == F.col("best_row")).alias("row_kept"),
    )
    alone = docs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_key", F.lit(True).alias("row_kept"))
    return linked.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("text_key", "row_kept")
