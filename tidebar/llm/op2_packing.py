"""Bounded-space online packing of token sequences into windows of a fixed length.

Every partition keeps ``open_windows`` windows. A document longer than a window is cut into whole
windows and a rest; the rest goes best-fit: into the open window that it leaves fullest. If none has
room, the fullest open window is emitted and a new one opened. What is open at a partition's end
is merged afterwards in a tree: the leftover windows of ``fan_in`` partitions are packed into each
other by the same rule, round by round, until one group is left; pieces move whole.

Only a window's fill level decides, so a partition's memory is its open windows and one batch.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import id_and_text, saved, table

QUERY = "op2_packing"
ORACLE_SQL = None  # token ids are beyond SQL; tests compare with whole-text encoding

WINDOW = 2048
OPEN_WINDOWS = 64
FAN_IN = 32
#: Id that ends every document.
END_ID = 1
#: Encoded words that one Python worker keeps; beyond this a new table starts and the one before is kept.
WORDS_KEPT = 150_000
#: Texts whose words are held at a time.
TEXTS = 200

#: What the vocabulary file's pre-tokeniser matches, for lower-cased Latin-1 text.
LATIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, fill int, group int"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes whole texts word by word: a word's ids depend on the word alone.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its
    words in order. Words are kept with their ids as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, ids: list[int]) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _latin(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is not None:
            return found
        pieces = [word] if word.isascii() and word.isalpha() else LATIN_PIECE.findall(word)
        out = []
        for piece in pieces:
            spelled = piece if piece.isascii() and piece.isprintable() else self.alphabet.pre_tokenize_str(piece)[0][0]
            if len(pieces) > 1 and (known := self.kept.get(piece) or self.old.get(piece)):
                out.append(known)
            else:
                out.append(self._ids([t.id for t in self.model.tokenize(spelled)]))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes."""
        split: list[list[str] | None] = []
        words: set[str] = set()
        for text in texts:
            own = None
            if "<|" not in text:  # special tokens' strings keep their meaning
                try:
                    text.encode("latin-1")
                    own = text.lower().split()
                except UnicodeEncodeError:
                    pass
                if own is not None and any(c in text for c in "\x1c\x1d\x1e\x1f"):
                    own = None
            split.append(own)
            if own is not None:
                words.update(own)
        if len(self.kept) > WORDS_KEPT:
            self.kept, self.old = {}, self.kept
        kept = self.kept
        for w in words.difference(kept.keys()):
            kept[w] = self._latin(w)
        return [self._other(t) if own is None else b"".join(map(kept.__getitem__, own)) for t, own in zip(texts, split, strict=True)]

    def _other(self, text: str) -> bytes:
        """Any other text: white space that every part of the tokeniser agrees on parts it."""
        parts = [p for p in re.split(r"[ \n\t\r]+", text) if p]
        return self._ids([i for e in self.whole.encode_batch(parts, add_special_tokens=False) for i in e.ids])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class OpenWindows:
    """The open windows of one partition: their fill levels and the pieces in them."""

    def __init__(self, window: int, most: int, first_id: int) -> None:
        self.window, self.most, self.next_id = window, most, first_id
        self.ids: list[int] = []
        self.fill = np.zeros(0, np.int64)

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset there) for a piece; a window closes when it is full or must make room."""
        fits = np.flatnonzero(self.fill <= self.window - length)
        if len(fits):
            k = int(fits[np.argmax(self.fill[fits])])
        else:
            if len(self.ids) >= self.most:
                self.close(int(np.argmax(self.fill)))
            self.ids.append(self.new_id())
            self.fill = np.append(self.fill, 0)
            k = len(self.ids) - 1
        at, offset = self.ids[k], int(self.fill[k])
        self.fill[k] += length
        if self.fill[k] == self.window:
            self.close(k)
        return at, offset

    def close(self, k: int) -> None:
        self.ids.pop(k)
        self.fill = np.delete(self.fill, k)


def _frame(rows: list[tuple], part: int) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "fill"]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    arrays = [pa.array(list(c), pa.int32() if n == "fill" else pa.int64()) for n, c in zip(names, columns, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int32())], names=[*names, "group"])


def _pack(path: str, window: int, most: int, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(path).encode
        space = OpenWindows(window, most, part << 36)
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                rows: list[tuple] = []
                some = batch.slice(first, TEXTS)
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encode(some.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        length = min(window, n - start)
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        at, offset = (space.new_id(), 0) if length == window else space.place(length)
                        rows.append((doc_id, start, length, crc, n, at, offset, 0))
                yield _frame(rows, part)
        # the windows still open: their pieces are already written, so only levels are told
        yield _frame([(None, -1, 0, 0, 0, s, 0, int(f)) for s, f in zip(space.ids, space.fill, strict=True)], part)

    return run


def _merge_group(window: int, most: int):
    """Pack the leftover windows of a group into each other; a window moves with all its pieces."""

    def run(levels: pd.DataFrame) -> pd.DataFrame:
        levels = levels.sort_values(["fill", "sequence_id"], ascending=[False, True])
        ids: list[int] = []
        fill = np.zeros(0, np.int64)
        moved = []
        closed = []
        for s, f in zip(levels["sequence_id"], levels["fill"], strict=True):
            fits = np.flatnonzero(fill <= window - f)
            if len(fits):
                k = fits[np.argmax(fill[fits])]
                moved.append((s, ids[k], int(fill[k])))
                fill[k] += f
            else:
                if len(ids) >= most:
                    k = int(np.argmax(fill))
                    closed.append((ids.pop(k), int(fill[k])))
                    fill = np.delete(fill, k)
                ids.append(s)
                fill = np.append(fill, f)
        g = int(levels["group"].iloc[0])
        out = [(s, t, o, -1, g) for s, t, o in moved] + [(s, s, 0, int(f), g) for s, f in zip(ids, fill, strict=True)]
        return pd.DataFrame(out, columns=["sequence_id", "into", "shift", "fill", "group"])

    return run


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    fan_in: int = FAN_IN,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone. Repeated rows are packed each. Null
    identifiers stay null. An empty table gives no rows. Every id lies in exactly one piece; pieces
    fill a sequence from offset 0 without gaps.
    """
    path = tokenizer or tokenizer_path()
    pieces = saved(id_and_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_pack(path, window, open_windows, end_id), _PIECES), "pieces")
    levels = pieces.where("start = -1").select("sequence_id", "fill", "group")
    moves: list[DataFrame] = []
    groups = (pieces.agg(F.max("group")).first()[0] or 0) + 1  # one for each partition that wrote pieces
    while groups > 1:
        groups = -(-groups // fan_in)
        step = saved(
            levels.withColumn("group", F.floor(F.col("group") / fan_in).cast("int")).groupBy("group").applyInPandas(_merge_group(window, open_windows), "sequence_id long, into long, shift long, fill int, group int"),
            "leftovers",
        )
        moves.append(step.where("fill = -1").select("sequence_id", "into", "shift"))
        levels = step.where("fill >= 0").select("sequence_id", "fill", "group")
    out = pieces.where("start >= 0").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    for move in moves:
        out = out.join(move, "sequence_id", "left").select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            F.coalesce("into", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
