"""Alignment of two tokenizers' tokens by the byte offsets where both end.

1. Texts are encoded by both vocabularies; the spelled bytes of each must give the text back, after one space.
2. Galloping intersection of the two lists of end offsets: the shorter list drives. Every 64th of its ends is looked
   for first, then each end from where the one placed before it lies, by steps that double and a binary search in the
   last step. The lists of a batch of texts are laid end to end and searched at once.
3. Common ends cut both lists into groups; differences of ranks give each token's overlapping tokens. Tokens that end together
   are linked.
4. A chunk of texts has a dictionary of its linked pairs. Dictionaries, not texts, are added up over the corpus and looked up
   again; counts come back to the chunk, whose texts hold their links as places in its dictionary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import id_and_text, saved, table
from tidebar.llm.op3_bpe import default_pattern, ranks_path

QUERY = "op13_alignment"
ORACLE_SQL = None  # tokens are beyond SQL; tests compare with a brute-force version

#: The ranks of byte_bpe_50k.json, which give its ids (tests compare the two) in a third of the time.
VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of text of a batch that is aligned at once, and of a chunk that shares a dictionary.
BATCH, CHUNK = 1 << 20, 1 << 24
STRIDE = 64

_PLAIN = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")
_ENCODED = "chunk long, doc_id long, " + ", ".join(f"{c} long" for c in _PLAIN) + ", groups_sha256 string, links binary, pairs array<long>, counts array<long>"


class ByteVocabulary:
    """Byte-level BPE: a file of ranks, or a tokenizer's JSON."""

    def __init__(self, path: str, pattern: str) -> None:
        self.spelled: list[bytes]
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
            # the alphabet that writes bytes as letters: printable Latin-1 as itself, the others from 256 on
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            other = [b for b in range(256) if b not in plain]
            byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
            names = {i: t for t, i in own.get_vocab(with_added_tokens=False).items()}
            self.spelled = [bytes(byte[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        else:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [own.encode_ordinary(t) for t in texts]
            self.spelled = [b""] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                self.spelled[rank] = token


class PieceVocabulary:
    """A sentencepiece model; it puts a space before a text by itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = lambda texts: own.encode(texts, num_threads=1)
        piece = own.id_to_piece
        self.spelled = [bytes([int(piece(i)[3:-1], 16)]) if own.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]


def gallop(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of the increasing numbers ``x`` how many of the increasing numbers ``y`` are smaller."""
    heads = _from(x[::STRIDE], y, np.zeros(len(x[::STRIDE]), np.int64))
    return _from(x, y, np.repeat(heads, STRIDE)[: len(x)])


def _from(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The same, by steps that double from ``start`` (at most the answer) and a binary search in the last one."""
    lo, hi = start.copy(), np.full(len(x), len(y))
    still, step = np.arange(len(x)), 1
    while len(still):
        at = lo[still] + step - 1
        less = at < len(y)
        less[less] = y[at[less]] < x[still[less]]
        lo[still[less]] = at[less] + 1
        hi[still[~less]] = np.minimum(at[~less], len(y))
        still, step = still[less], step * 2
    still = np.flatnonzero(lo < hi)
    while len(still):
        mid = (lo[still] + hi[still]) // 2
        less = y[mid] < x[still]
        lo[still[less]] = mid[less] + 1
        hi[still[~less]] = mid[~less]
        still = still[lo[still] < hi[still]]
    return lo


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends that both have."""
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    at = gallop(x, y)
    found = at < len(y)
    found[found] = y[at[found]] == x[found]
    own, other = np.flatnonzero(found), at[found]
    return (own, other) if x is a else (other, own)


def overlap_ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token that ends at ``a``: the first, and the one after the last, of the tokens ending at ``b`` with a byte in common."""
    last = gallop(a, b) + 1
    first = np.concatenate(([0], last[:-1] - (b[last[:-1] - 1] > a[:-1])))
    return first, last


class Aligned(NamedTuple):
    """Texts laid end to end: ids, where each text's tokens start, and the places of common ends in both lists."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    #: Where each text's groups start.
    groups: np.ndarray


class Aligner:
    """Two vocabularies and what follows from them."""

    def __init__(self, path_a: str, path_b: str, pattern: str) -> None:
        self.a, self.b = ByteVocabulary(path_a, pattern), PieceVocabulary(path_b)
        self.size_a, self.size_b = (np.array([len(s) for s in v.spelled], np.int64) for v in (self.a, self.b))
        # ids as digits with what follows them: a comma, or the sign at the end of a group's part
        digits = [f"{i}{after}" for v, end in ((self.a, "|"), (self.b, ";")) for i in range(len(v.spelled)) for after in (",", end)]
        self.digits = np.array(digits, "S")

    def align(self, texts: list[str]) -> Aligned:
        """Texts whose bytes either vocabulary does not give back have no tokens."""
        spaced = [f" {t}" for t in texts]
        ids_a, ids_b = self.a.encode(spaced), self.b.encode(texts)
        spell_a, spell_b = self.a.spelled.__getitem__, self.b.spelled.__getitem__
        for i, text in enumerate(spaced):
            want = text.encode()
            if not texts[i] or b"".join(map(spell_a, ids_a[i])) != want or b"".join(map(spell_b, ids_b[i])) != want:
                ids_a[i] = ids_b[i] = []
        starts_a, starts_b = (np.cumsum([0, *map(len, ids)]) for ids in (ids_a, ids_b))
        all_a, all_b = (np.fromiter((i for own in ids for i in own), np.int64, n[-1]) for ids, n in ((ids_a, starts_a), (ids_b, starts_b)))
        ends_a, ends_b = np.cumsum(self.size_a[all_a]), np.cumsum(self.size_b[all_b])
        at_a, at_b = common_ends(ends_a, ends_b)
        return Aligned(all_a, all_b, starts_a, starts_b, ends_a, ends_b, at_a, at_b, np.searchsorted(at_a, starts_a))

    def written(self, x: Aligned) -> Iterator[bytes]:
        """Each text's groups, ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = len(x.ids_a), len(x.ids_b)
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[x.at_a] = last_b[x.at_b] = 1
        # a token comes after all of its own list before it, and after the other list's tokens of earlier groups (or, in b, of its own too)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(n_a + n_b, np.int64)
        order[np.arange(n_a) + np.concatenate(([0], x.at_b + 1))[group_a]] = 2 * x.ids_a + last_a
        order[np.arange(n_b) + (x.at_a + 1)[group_b]] = 2 * (x.ids_b + len(self.a.spelled)) + last_b
        told = self.digits[order]
        at = x.starts_a + x.starts_b
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield told[lo:hi].tobytes().translate(None, b"\0")[:-1]


_known: dict[tuple[str, str, str], Aligner] = {}


def aligner(path_a: str, path_b: str, pattern: str) -> Aligner:
    """One for each worker process."""
    if (path_a, path_b, pattern) not in _known:
        _known[path_a, path_b, pattern] = Aligner(path_a, path_b, pattern)
    return _known[path_a, path_b, pattern]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    """Identifiers and texts, about ``BATCH`` bytes at a time."""
    ids, texts, size, at = batch.column("doc_id"), [], 0, 0
    for k, text in enumerate(batch.column("text")):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= BATCH:
            yield ids.slice(at, len(texts)), texts
            texts, size, at = [], 0, k + 1
    if texts:
        yield ids.slice(at, len(texts)), texts


def _groups(paths: tuple[str, str, str]):
    """Texts to their groups of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for batch in batches:
            for ids, texts in _parts(batch):
                x = own.align(texts)
                inner = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], at + 1)), pa.int32()), pa.array(tokens, pa.int32())) for at, tokens in ((x.at_a, x.ids_a), (x.at_b, x.ids_b))]
                first, last = overlap_ranges(x.ends_a, x.ends_b)
                outer = pa.array(x.groups, pa.int32())
                spans = pa.StructArray.from_arrays([pa.array(first - np.repeat(x.starts_b[:-1], np.diff(x.starts_a)), pa.int32()), pa.array(last - np.repeat(x.starts_b[:-1], np.diff(x.starts_a)), pa.int32())], names=["first", "end"])
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.ListArray.from_arrays(outer, i) for i in inner], pa.ListArray.from_arrays(pa.array(x.starts_a, pa.int32()), spans)],
                    names=["doc_id", "groups_a", "groups_b", "overlaps"],
                )

    return run


def _encoded(paths: tuple[str, str, str], chunk_bytes: int):
    """Texts to a row each, with links as places in the dictionary of the chunk, and a row for each chunk's dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        chunk, size, rows, keys = TaskContext.get().partitionId() << 32, 0, [], []

        def done() -> pa.RecordBatch:
            pairs, places, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            pack, at, links = zstandard.ZstdCompressor(level=1).compress, 0, []
            for row in rows:
                n = row[4]
                links.append(pack(places[at : at + n].astype("<u4").tobytes()) if n else None)
                at += n
            columns = [[chunk] * (len(rows) + 1), *[[*c, None] for c in zip(*rows, strict=True)], [*links, None], [None] * len(rows) + [pairs], [None] * len(rows) + [counts]]
            kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["chunk", "doc_id", *_PLAIN, "groups_sha256", "links", "pairs", "counts"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for ids, texts in _parts(batch):
                x = own.align(texts)
                keys.append(x.ids_a[x.at_a] << 32 | x.ids_b[x.at_b])
                n_a, n_b, n_groups = (np.diff(c).tolist() for c in (x.starts_a, x.starts_b, x.groups))
                told = (hashlib.sha256(t).hexdigest() if n else "" for t, n in zip(own.written(x), n_a, strict=True))
                rows += [(i, a, b, g, g, a + b - g, t) for i, a, b, g, t in zip(ids.to_pylist(), n_a, n_b, n_groups, told, strict=True)]
                size += sum(map(len, texts))
                if size >= chunk_bytes:
                    yield done()
                    chunk, size, rows, keys = chunk + 1, 0, [], []
        if rows:
            yield done()

    return run


def _looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's texts, and its dictionary (at, total, best) with counts of the corpus, to the result."""
    at = right.column("at").to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    total[at], best[at] = right.column("total").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
    unpack, n_best, sums = zstandard.ZstdDecompressor().decompress, [], []
    for links in left.column("links").to_pylist():
        places = np.frombuffer(unpack(links), "<u4") if links else np.zeros(0, np.uint32)
        n_best.append(int(best[places].sum()))
        sums.append(int(total[places].sum()))
    out = left.select(["doc_id", *_PLAIN, "groups_sha256"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def _paths(path_a: str | None, path_b: str | None, pattern: str | None) -> tuple[str, str, str]:
    return path_a or ranks_path(VOCABULARY_A), path_b or ranks_path(VOCABULARY_B), pattern or default_pattern()


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row of ``df``: doc_id, groups_a and groups_b (the token ids of each group), overlaps.

    ``overlaps`` has for each token of the first vocabulary the places (first, end) of the second one's tokens that share
    a byte with it. Texts that are null, empty, or not given back by both vocabularies have no tokens. Repeated
    rows give a row each; an empty table gives none.
    """
    kinds = "doc_id long, groups_a array<array<int>>, groups_b array<array<int>>, overlaps array<struct<first: int, end: int>>"
    return _texts(df, id_col, text_col).mapInArrow(_groups(_paths(path_a, path_b, pattern)), kinds)


def alignment_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, pattern: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``df``: doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, n_best, count_sum.

    Tokens that end at the same byte are linked; a pair of ids counts as often as it is linked anywhere in ``df``. ``n_best``
    are the links whose pair is the most frequent one of its second id (ties included), ``count_sum`` adds up the
    counts of a text's links, ``n_overlaps`` the pairs of tokens that share a byte. Texts, repeated rows and
    empty tables as in ``align``.
    """
    made = saved(_texts(df, id_col, text_col).mapInArrow(_encoded(_paths(path_a, path_b, pattern), chunk), _ENCODED), "aligned")
    entries = made.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "e")).select("chunk", "at", "e.pairs", "e.counts")
    totals = saved(entries.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total")), "pairs")
    second = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = totals.groupBy(second.alias("b")).agg(F.max("total").alias("most"))
    marked = totals.withColumn("b", second).join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    known = entries.join(marked, F.col("pairs") == F.col("pair")).select(F.col("chunk").alias("of"), "at", "total", "best")
    texts = made.where("pairs IS NULL").select("chunk", "doc_id", *_PLAIN, "groups_sha256", "links")
    kinds = "doc_id long, " + ", ".join(f"{c} long" for c in _PLAIN) + ", groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_looked_up, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
