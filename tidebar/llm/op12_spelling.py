"""Spelling variants: words that differ by one code point, and the frequent form that each belongs to.

1. Runs of letters are counted over all texts with column functions, added up before they are shuffled.
2. Dense prefix-suffix tiling. Let L be the longer length of two words. They differ by a single edit exactly if
   the lengths of their common prefix and common suffix add up to L - 1 or more; so they share the
   first or the last L // 2 code points. Words that share such a half are dealt into blocks, and padded
   code-point matrices compare pairs of blocks, aligned left for prefixes and right for suffixes. A pair that shares
   both halves counts where its first half is shared. Only sums and the best partner of each word leave a task.
3. Forms are followed by pointer jumping: a form is at least ``ratio`` times as frequent as its word, so that chains are
   at most as long as the logarithm of the largest count.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.blocks import bounds, whole_groups
from tidebar.llm.common import drop_saved, saved, table

QUERY = "op12_spelling"
ORACLE_SQL = None  # pairs of all words are too slow in SQL, and it has no crc32; tests compare with brute force

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Code points and occurrences of a word, and how much more frequent its form must be.
LENGTH, OCCURRENCES, RATIO = 7, 2, 10
#: Of the runs of a document, one in so many loses a code point.
SLIPS = 31
#: Words and code points of a block.
BLOCK, CELLS = 1024, 1 << 22


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, length: int = LENGTH, occurrences: int = OCCURRENCES, slips: int | None = SLIPS) -> DataFrame:
    """(word, n): words of at least ``length`` code points that occur at least ``occurrences`` times.

    A word is a maximal run of ``letters`` (a character class) with A-Z in lower case. With ``slips``, a run loses the
    code point at ``h % length of the run`` if ``slips`` divides h, the CRC-32 of ``<identifier>:<run>``. Null texts have
    no words; a null identifier is written as nothing.
    """
    lower = F.translate(text_col, string.ascii_uppercase, string.ascii_lowercase)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = df.select(ident.alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"{letters}{{{length},}}"), F.lit(0))).alias("run"))
    if slips:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = "int(h % length(run))"
        runs = runs.select(F.expr(f"CASE WHEN h % {slips} = 0 THEN concat(substring(run, 1, {at}), substring(run, {at} + 2)) ELSE run END").alias("run"))
    counts = runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= length) & (F.col("n") >= occurrences))


def _matrix(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, padded with zeros behind and before."""
    joined = "".join(words)
    try:
        flat = np.frombuffer(joined.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        flat = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words])[:, None]
    left, right = np.zeros((2, len(words), width), flat.dtype)
    at = np.arange(width)
    left[at < sizes] = flat
    right[at >= width - sizes] = flat
    return left, right


def _shared(a: np.ndarray, b: np.ndarray, columns: range) -> np.ndarray:
    """For all rows of ``a`` and ``b``: how many of the columns agree before the first that does not."""
    same = np.ones((len(a), len(b)), bool)
    out = np.zeros((len(a), len(b)), np.int32 if len(columns) > 250 else np.uint8)
    for c in columns:
        same &= a[:, c, None] == b[None, :, c]
        out += same
    return out


def near_pairs(a: list[str], b: list[str], length: int, last: bool) -> np.ndarray:
    """Which words of ``a`` and ``b`` are one edit apart, of longer length ``length``, all sharing one half.

    ``last``: they share the last half, and pairs that share the first half too do not count here.
    """
    half = length // 2
    a_left, a_right = _matrix(a, length)
    b_left, b_right = (a_left, a_right) if b is a else _matrix(b, length)
    ends = range(length - 1, -1, -1)
    if last:  # common suffix from the half on, common prefix short of the half
        suffix = _shared(a_right, b_right, ends[half:])
        prefix = _shared(a_left, b_left, range(half))
        return (prefix < half) & (prefix + suffix.astype(np.int32) + half >= length - 1)
    prefix = _shared(a_left, b_left, range(half, length))
    suffix = _shared(a_right, b_right, ends[: length - 1 - half])
    return prefix + suffix.astype(np.int32) + half >= length - 1


def _tile(words: list[str], n: np.ndarray, length: int, last: bool, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[str, int, str, int]]:
    """(word, near words, the most frequent one, its count) of the words in ``left`` and ``right`` (the same places, or disjoint ones)."""
    own = [words[i] for i in left]
    near = near_pairs(own, own if left is right else [words[i] for i in right], length, last)
    long = np.array([len(w) == length for w in words])
    near &= long[left][:, None] | long[right]
    if left is right:
        near &= np.triu(np.ones(near.shape, bool), 1)
    i, j = np.nonzero(near)
    if not len(i):
        return
    i, j = left[i], right[j]
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    total, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for x, y in ((i, j), (j, i)):
        total += np.bincount(x, minlength=len(words))
        np.minimum.at(best, x, rank[y])
    for k in np.flatnonzero(total).tolist():
        top = order[best[k]]
        yield words[k], int(total[k]), words[top], int(n[top])


def _by_half(words: list[str], length: int, last: bool) -> Iterator[list[int]]:
    """Places of words that do share the half; keys are hashes, so others may have met."""
    half, found = length // 2, {}
    for k, w in enumerate(words):
        found.setdefault(w[-half:] if last else w[:half], []).append(k)
    yield from found.values()


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, side, last, length, word, n), ordered by key and blocks, to (word, near, best, best_n)."""
    for rows in whole_groups(batches, ["key", "i", "j"]):
        own = [rows.column(c).to_numpy() for c in ("key", "i", "j")]
        word, n, side = rows.column("word").to_pylist(), rows.column("n").to_numpy(), rows.column("side").to_numpy()
        length, last = rows.column("length").to_numpy(), rows.column("last").to_numpy()
        out: list[tuple[str, int, str, int]] = []
        at = bounds(*own)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            for part in _by_half(word[lo:hi], int(length[lo]), bool(last[lo])):
                places = np.array(part)
                sides = side[lo + places]
                every = np.arange(len(part))
                left, right = (every, every) if own[1][lo] == own[2][lo] else (every[sides == 0], every[sides == 1])
                if len(part) > 1 and len(left) and len(right):
                    out += _tile([word[lo + k] for k in part], n[lo + places], int(length[lo]), bool(last[lo]), left, right)
        a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string()), pa.array(d, pa.int64())], names=["word", "near", "best", "best_n"])


def near_words(words: DataFrame, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n; distinct, none empty) that have a near word.

    ``best`` is the most frequent near word; of several the first in the order of code points.
    """
    # a word of m code points is the longer or an equal one at length m, the shorter one at m + 1
    at = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("length"))
    halves = at.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("last"))
    half = F.expr("CASE WHEN last = 0 THEN substring(word, 1, length div 2) ELSE substring(word, -(length div 2)) END")
    keyed = halves.withColumn("key", F.xxhash64("length", "last", half))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("words"), F.count_if(F.length("word") == F.col("length")).alias("longer"), F.sum("length").alias("points"))
    sizes = sizes.where("words > 1 AND longer > 0").select("key", F.greatest(F.ceil(F.col("words") / block), F.ceil(F.col("points") / cells)).alias("parts"))
    dealt = keyed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("word"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "last", "length", "word", "n")
    place = ["key", "i", "j"]
    tiles = dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(_tiles, "word string, near long, best string, best_n long")
    found = tiles.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return found.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form) without circles: each word's last form, by pointer jumping."""
    now = saved(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_saved(now)
        now = new
        if now.where("moved").isEmpty():
            return now.drop("moved")


def variants(words: DataFrame, ratio: float = RATIO, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """Per word of ``words`` (word, n): word, n, n_near, form, form_n, root.

    ``form`` is the word's most frequent near word if that is at least ``ratio`` times as frequent, else null; ``root`` is where
    following forms ends, the word itself without a form. An empty table gives no rows.
    """
    words = saved(words.select("word", "n"), "words")
    near = saved(words.join(near_words(words, block, cells), "word"), "near")
    formed = near.where(F.col("best_n") >= ratio * F.col("n")).select("word", F.col("best").alias("form"), F.col("best_n").alias("form_n"))
    told = near.select("word", "n_near").join(formed, "word", "left").join(follow(formed), "word", "left")
    out = words.join(told, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(table(spark, sf_dir, "documents")))
