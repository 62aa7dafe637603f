"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

One dictionary is made of toxic text, the other of ordinary text. Most of a toxic document is
ordinary, so what goes into the toxic dictionary are the word beginnings that stand far oftener among
the words of toxic documents than among those of ordinary ones (a long ordinary document holds many by
chance, so occurrences are held against all words, not documents against documents). The ordinary
dictionary holds ordinary documents' usual words. A document is cut into windows of one word each.
Every window is compressed with either dictionary, and the difference of the compressed lengths is its
gain. How many windows reach which gain is turned into a score by calibrated thresholds.

Calibration is cross-fitted and the same at every size: dictionaries made from one half of the labelled
sample measure the other half, both ways. The contrast whose measurements part the classes best is
taken, the score is fitted on them, and the dictionaries that score documents are then made from the
whole sample. The share of toxic documents among all labels that may be learned from corrects the
score for a sample in which they are commoner.

Windows repeat: every distinct one is compressed once and its gain is kept in a bounded table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import drop_saved, id_and_text, saved, table
from tidebar.llm.labels import fold, learnable, logistic, sigmoid

QUERY = "op10_toxicity"
ORACLE_SQL = None  # a fitted classifier; tests hold it against held-out labels

#: Labelled documents that the dictionaries and the thresholds are made from, at most, per class.
TOXIC_DOCS, ORDINARY_DOCS = 3000, 12000
#: Entries of a dictionary.
ENTRIES = 400
#: Toxic texts of the sample that a stem must stand in: this many at least, and one of every so many.
LEAST_TEXTS, ONE_IN = 3, 200
#: How many times oftener a toxic entry must stand in toxic text: what is tried on the labelled sample.
CONTRASTS = (4.0, 8.0, 16.0, 32.0)
#: Characters of a word's beginnings.
STEMS = range(4, 11)
#: Gains kept by a worker process.
GAINS_KEPT = 200_000
EDGES = ".,;:!?#$%&*|\"'()[]{}<>-_"
#: What starts every window: known to both dictionaries, so that a block is never stored raw.
PRIMER = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ=+<>[]{}@^~_/"
#: What ends every window: zstandard looks for no match that starts in a block's last eight bytes.
TAIL = b"~^@=+<>;"
LEVELS = np.arange(1, 11)
#: The same for the share of a window that its gain is, in tenths: a whole word of the dictionary saves most of itself.
SHARES = np.arange(1, 9)
_WIDTH = 3 + 2 * len(LEVELS) + 2 * len(SHARES)


def words_of(text: str) -> list[str]:
    return [w.strip(EDGES) or w for w in text.lower().split()]


def stems_of(word: str) -> list[str]:
    """A word's beginnings, itself among them."""
    return [word[:k] for k in STEMS if len(word) > k] + [word] * (len(word) >= STEMS.start)


def _toxic_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stem the texts that hold it and its occurrences; the empty stem counts all words."""
    seen: Counter[str] = Counter()
    times: Counter[str] = Counter({"": 0})
    for batch in batches:
        for t in batch.column("text").to_pylist():
            own: Counter[str] = Counter()
            for w, n in Counter(words_of(t)).items():
                times[""] += n
                for s in stems_of(w):
                    own[s] += n
            seen.update(own.keys())
            times.update(own)
    yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array([seen[s] for s in times], pa.int64()), pa.array(list(times.values()), pa.int64())], names=["stem", "n", "times"])


def _ordinary_stems(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: Counter[str] = Counter({"": 0})
        words: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column("text").to_pylist():
                own = Counter(words_of(t))
                words.update(w for w in own if len(w) >= 5)
                for w, n in own.items():
                    stems[""] += n
                    for s in stems_of(w):
                        if s in wanted:
                            stems[s] += n
        yield pa.RecordBatch.from_arrays([pa.array([*stems, *words], pa.string()), pa.array([*stems.values(), *words.values()], pa.int64()), pa.array([True] * len(stems) + [False] * len(words))], names=["stem", "n", "asked"])

    return run


class Counts:
    """What bounded samples of toxic and ordinary documents with distinct texts say of stems.

    A stem counts if it stands in ``least_texts`` toxic texts at least, and in one of every ``one_in`` of the sample.
    """

    def __init__(self, toxic: DataFrame, ordinary: DataFrame, entries: int = ENTRIES, least_texts: int = LEAST_TEXTS, one_in: int = ONE_IN) -> None:
        n1, self.entries = toxic.count(), entries
        seen = toxic.select("text").mapInArrow(_toxic_stems, "stem string, n long, times long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))
        # stems of a bounded sample
        seen = seen.where((F.col("n") >= max(least_texts, n1 // one_in)) | (F.col("stem") == "")).collect()
        times = {r["stem"]: r["times"] for r in seen}
        words1 = times.pop("", 0)
        self.texts = {r["stem"]: r["n"] for r in seen if r["stem"]}
        rows = saved(ordinary.select("text").mapInArrow(_ordinary_stems(frozenset(times)), "stem string, n long, asked boolean").groupBy("stem", "asked").agg(F.sum("n").alias("n")), "stems")
        co = {r["stem"]: r["n"] for r in rows.where("asked").collect()}
        self.usual = [r["stem"] for r in rows.where("NOT asked").orderBy(F.desc("n"), "stem").limit(5 * entries).collect()]
        drop_saved(rows)
        words0 = co.pop("", 0)
        self.contrast = {s: (n + 0.5) / (words1 + 1) / ((co.get(s, 0) + 0.5) / (words0 + 1)) for s, n in times.items()}

    def dictionaries(self, least: float) -> tuple[bytes, bytes]:
        """Contents of the toxic and of the ordinary dictionary."""
        ct, contrast = self.texts, self.contrast
        chosen: list[str] = []
        stands: dict[str, int] = {}  # of every beginning of those chosen, the most texts that one of them is in
        for s in sorted((s for s in ct if contrast[s] > least), key=lambda s: (-len(s), -ct[s], s)):
            if stands.get(s, 0) < 0.9 * ct[s]:  # else a longer one stands for it
                chosen.append(s)
                for k in range(STEMS.start, len(s) + 1):
                    stands[s[:k]] = max(stands.get(s[:k], 0), ct[s])
        chosen = sorted(chosen, key=lambda s: (-ct[s] * np.log(contrast[s]), s))[: self.entries]
        plain = [w for w in self.usual if contrast.get(w, 0.0) < 2][: max(1, len(chosen))]
        spell = lambda ws: b"".join(b" " + w.encode() for w in reversed(ws)) + b" " + PRIMER  # noqa: E731  the best ones last, where offsets are short
        return spell(chosen), spell(plain)


def dictionaries(toxic: DataFrame, ordinary: DataFrame, least: float, entries: int = ENTRIES, least_texts: int = LEAST_TEXTS, one_in: int = ONE_IN) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary, from bounded samples with distinct texts."""
    return Counts(toxic, ordinary, entries, least_texts, one_in).dictionaries(least)


def _loss(x: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss of a score fitted on one half of the rows and tried on the other, both ways."""
    half, out = np.arange(len(y)) % 2 == 0, 0.0
    for fit in (half, ~half):
        mean, scale, w = logistic(x[fit], y[fit], ridge=1.0)
        p = np.clip(sigmoid(w[0] + (x[~fit] - mean) / scale @ w[1:]), 1e-9, 1 - 1e-9)
        out -= float(np.where(y[~fit] == 1, np.log(p), np.log(1 - p)).sum())
    return out / len(y)


def calibrated(sample: DataFrame, share: float, entries: int = ENTRIES, least_texts: int = LEAST_TEXTS, one_in: int = ONE_IN) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(contrast, fitted score) by cross-fitting over a bounded sample (doc_id, text_key, text, y).

    ``share``: the share of toxic documents that the score is to expect.
    """
    half = F.pmod(F.xxhash64("text_key"), F.lit(2))
    y: list[float] = []
    x: dict[float, list] = {c: [] for c in CONTRASTS}
    for k in (0, 1):
        rest, own = sample.where(half != k), sample.where(half == k)
        counts = Counts(rest.where("y = 1"), rest.where("y = 0"), entries, least_texts, one_in)
        pairs = {c: counts.dictionaries(c) for c in CONTRASTS}
        distinct = list(dict.fromkeys(pairs.values()))
        found = own.mapInArrow(_measure(distinct, "y"), "text_key long, y int, x array<array<double>>")
        rows = sorted(tuple(r) for r in found.collect())  # a bounded sample, a few numbers each
        y += [r[1] for r in rows]
        for c in CONTRASTS:
            x[c] += [r[2][distinct.index(pairs[c])] for r in rows]
    labels = np.array(y, float)
    if not len(labels):
        return CONTRASTS[0], (np.zeros(_WIDTH), np.ones(_WIDTH), np.zeros(_WIDTH + 1))
    tables = {c: np.array(v, float) for c, v in x.items()}
    best = min(CONTRASTS, key=lambda c: (_loss(tables[c], labels), c))
    mean, scale, w = logistic(tables[best], labels, ridge=1.0)
    odds = lambda p: np.log(p / (1 - p)) if 0 < p < 1 else 0.0
    if 0 < labels.mean() < 1:
        w[0] += odds(share) - odds(float(labels.mean()))
    return best, (mean, scale, w)


class Gains:
    """Gain of a window: its length compressed with the ordinary dictionary less that with the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        import zstandard as zstd

        params = zstd.ZstdCompressionParameters(window_log=17, hash_log=12, chain_log=12, search_log=4, min_match=4, target_length=32, strategy=zstd.STRATEGY_GREEDY, write_content_size=0, write_dict_id=0, write_checksum=0)
        self.sides = [zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT)) for d in (ordinary, toxic)]
        self.kept: dict[str, tuple[int, int]] = {}

    def of(self, windows: set[str]) -> dict[str, tuple[int, int]]:
        """Each window's (gain, gain in tenths of the window)."""
        new = list(windows.difference(self.kept))
        if len(self.kept) + len(new) > GAINS_KEPT:
            self.kept = {w: self.kept[w] for w in windows if w in self.kept}
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            data = [PRIMER + b" " + w.encode() + b" " + TAIL for w in part]
            sizes = []
            for side in self.sides:
                out = side.multi_compress_to_buffer(data)
                sizes.append([len(out[i]) for i in range(len(out))])
            self.kept.update((w, (a - b, 10 * (a - b) // (len(d) - len(PRIMER) - len(TAIL)))) for w, d, a, b in zip(part, data, *sizes, strict=True))
        return self.kept


_gains: dict[tuple[bytes, bytes], Gains] = {}


def features(found: np.ndarray) -> list[float]:
    """What the score sees of a document: its windows' gains; an empty one has none."""
    if not len(found):
        return [0.0] * _WIDTH
    gain, share = found[:, 0], found[:, 1]
    at_least = np.array([(gain >= k).sum() for k in LEVELS] + [(share >= k).sum() for k in SHARES], float)
    top = np.sort(np.partition(gain, -min(3, len(gain)))[-3:])
    return [float(top.mean()), float(top[-1]), float(np.log(len(gain))), *np.log1p(at_least), *np.sqrt(at_least / len(gain))]


def _measure(pairs: list[tuple[bytes, bytes]], other: str):
    """Rows (text_key, ``other``, text) to (text_key, ``other``, x): a document's features under every pair of dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_gains.setdefault(pair, Gains(*pair)) for pair in pairs]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                words = [words_of(t) for t in part.column("text").to_pylist()]
                distinct = set().union(*words)
                by_pair = []
                for gains in own:
                    gain = gains.of(distinct)
                    by_pair.append([features(np.array([gain[x] for x in w], np.int64).reshape(-1, 2)) for w in words])
                x = pa.array(list(map(list, zip(*by_pair, strict=True))), pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([part.column("text_key"), part.column(other), x], names=["text_key", other, "x"])

    return run


def _score(pair: tuple[bytes, bytes], mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
    measure = _measure([pair], "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in measure(batches):
            x = np.array([r[0] for r in found.column("x").to_pylist()], float).reshape(-1, len(mean))
            p = sigmoid(weights[0] + (x - mean) / scale @ weights[1:])
            yield pa.RecordBatch.from_arrays([found.column("doc_id"), found.column("text_key"), pa.array(p)], names=["doc_id", "text_key", "score"])

    return run


def _some(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of the identifier."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS, entries: int = ENTRIES, least_texts: int = LEAST_TEXTS, one_in: int = ONE_IN) -> DataFrame:
    """Per row of ``df``: doc_id, held_out, score, predicted, kept (not predicted toxic), text_key.

    Labels are learned only from documents whose crc32(doc_id as text) mod 5 is not 0; at most
    ``toxic_docs`` and ``ordinary_docs`` of them, chosen by a hash, are looked at, and dictionaries are made of stems
    in at least ``least_texts`` of the toxic ones and in one of every ``one_in``. Null and empty
    texts have no windows and get the score of that. Rows without identifier are scored, never
    learned from; repeated rows get equal scores; of several labels of one document the largest
    counts. With labels of one class only, its share decides. An empty table gives no rows. Columns
    other than identifier and text are not read.
    """
    docs = id_and_text(df, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    known = saved(learnable(labels, "toxic", lambda c: fold(c, 5) != 0).join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "known")
    share = known.agg(F.avg("y")).first()[0] or 0.0
    # both are bounded samples of identifiers, so they are broadcast
    chosen = saved(_some(known.where("y = 1"), toxic_docs).unionByName(_some(known.where("y = 0"), ordinary_docs)), "sample")
    sample = saved(docs.join(F.broadcast(chosen), "doc_id").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("y").alias("y")), "sampled")
    contrast, model = calibrated(sample, share, entries, least_texts, one_in)
    pair = dictionaries(sample.where("y = 1"), sample.where("y = 0"), contrast, entries, least_texts, one_in)
    out = docs.mapInArrow(_score(pair, *model), "doc_id long, text_key long, score double")
    predicted = (F.col("score") >= 0.5).cast("int")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", predicted.alias("predicted"), (predicted == 0).alias("kept"), "text_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")
