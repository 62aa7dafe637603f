"""Byte-level BPE encoding of whole texts, in overlapping chunks, and decoding.

A text longer than ``chunk`` characters is dealt out as chunks that overlap, so that one very long
text is work for many tasks. Every chunk is pre-tokenised alone, from its own start. The pattern
looks only at what follows a position, so two runs over the same text that share one boundary share
all that follow; where the boundaries of a chunk's end and of the next one's start first coincide
inside the overlap, the runs have resynchronised and the text is cut there. The pieces between
the cuts are encoded in parallel; their ids are joined in order and decoded. A text in which two chunks
never coincide (one pre-token longer than the overlap) is encoded whole instead.

A text of at most ``chunk`` characters is a single chunk: it is its own only piece and moves nowhere.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import id_and_text, saved, table

QUERY = "op3_bpe"
ORACLE_SQL = None  # byte-pair merges are beyond SQL; tests compare with whole-text encoding

#: Characters of a chunk, and by how many the next chunk is overlapped.
CHUNK = 1 << 13
OVERLAP = 1 << 8
#: Matches that end closer than this to a chunk's end may depend on what follows.
MARGIN = 16
#: Row numbers of texts that never resynchronise are broadcast up to so many (1.6 MB).
FEW = 100_000

_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        top = max(ranks.values()) + 1
        #: How ids travel between tasks: in two bytes where the vocabulary allows it.
        self.kind = "<u2" if top <= 1 << 16 else "<u4"
        self.spelled: list[bytes] = [b""] * top
        for token, rank in ranks.items():
            self.spelled[rank] = token

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of the ids; they need not be valid UTF-8."""
        return b"".join(map(self.spelled.__getitem__, ids))

    def ends(self, text: str, start: int, stop: int) -> list[int]:
        """Where matches end, from ``start`` up to ``stop``."""
        return [m.end() for m in self.pattern.finditer(text) if start <= m.end() <= stop]


_known: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process."""
    if (path, pattern) not in _known:
        _known[path, pattern] = ByteBpe(path, pattern)
    return _known[path, pattern]


def packed(ids: list[int], kind: str = "<u4") -> bytes:
    return np.asarray(ids, kind).tobytes()


def _digests(path: str, pattern: str):
    """Whole texts to their result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text)
                out.append((len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            n, a, b = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _boundaries(path: str, pattern: str, chunk: int, overlap: int):
    """Chunk rows to the boundaries in the overlap before and after, counted from where the later chunk starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        kind = pa.list_(pa.int16() if overlap < 1 << 15 else pa.int32())
        for batch in batches:
            head, tail = [], []
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = own.ends(text, 1, len(text) - MARGIN)
                head.append([e for e in found if e <= overlap - MARGIN] if k else [])
                tail.append([e - chunk for e in found if e > chunk])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(head, kind), pa.array(tail, kind)], names=["row", "k", "head", "tail"])

    return run


def _encode_pieces(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [packed(own.encode(t), own.kind) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("k"), pa.array(ids, pa.binary())], names=["doc_id", "row", "k", "ids"])

    return run


def _joined(path: str, pattern: str):
    """Rows (doc_id, parts) of one text's pieces, in order, to its result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for parts in batch.column("parts"):
                count, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for part in parts:
                    found = np.frombuffer(part["ids"].as_py(), own.kind)
                    count += len(found)
                    ids.update(found.astype("<u4").tobytes())
                    decoded.update(own.decode(found.tolist()))
                n.append(count)
                a.append(ids.hexdigest())
                b.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``df``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens. Repeated rows and identifiers give a row each; a null
    identifier stays null. An empty table gives no rows. The ids are those that the vocabulary's
    usual library gives for the whole text, without special tokens.
    """
    path, pattern = ranks or ranks_path(), pattern or default_pattern()
    docs = id_and_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    short = docs.where(F.length("text") <= chunk).mapInArrow(_digests(path, pattern), _OUT)
    # longer texts: numbered once and written, so that every later plan sees the same rows
    long = saved(docs.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()), "long")
    last = F.floor((F.length("text") - 1) / chunk)
    chunks = long.select("doc_id", "row", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    chunks = chunks.select("doc_id", "row", "k", F.expr(f"substring(text, int(k * {chunk}) + 1, {chunk + overlap})").alias("text"))
    kind = "smallint" if overlap < 1 << 15 else "int"
    found = saved(chunks.select("row", "k", "text").mapInArrow(_boundaries(path, pattern, chunk, overlap), f"row long, k long, head array<{kind}>, tail array<{kind}>"), "boundaries")
    # where chunk k and the next one agree first; null after the last chunk
    after = found.select("row", (F.col("k") - 1).alias("k"), F.col("head").alias("next"))
    cuts = found.join(after, ["row", "k"], "left").select("row", "k", F.col("next").isNull().alias("ends"), F.array_min(F.array_intersect("tail", "next")).cast("int").alias("cut"))
    lost = saved(cuts.where(F.col("cut").isNull() & ~F.col("ends")).select("row").distinct(), "lost")
    n_lost = lost.count()
    starts = cuts.select("row", (F.col("k") + 1).alias("k"), F.col("cut").alias("from"))
    spans = cuts.join(lost, "row", "left_anti").join(starts, ["row", "k"], "left")
    at = F.coalesce("from", F.lit(0))
    upto = F.when(F.col("ends"), F.length("text")).otherwise(F.col("cut") + chunk)
    pieces = chunks.join(spans, ["row", "k"]).select("doc_id", "row", "k", F.substring("text", (at + 1).cast("int"), (upto - at).cast("int")).alias("text"))
    parts = pieces.mapInArrow(_encode_pieces(path, pattern), "doc_id long, row long, k long, ids binary").groupBy("row")
    parts = parts.agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    joined = parts.select("doc_id", "parts").mapInArrow(_joined(path, pattern), _OUT)
    out = short.unionByName(joined)
    if not n_lost:
        return out
    # the longer texts stay where they are if the rows looked for are few
    found_whole = long.join(F.broadcast(lost) if n_lost <= FEW else lost, "row", "left_semi")
    return out.unionByName(found_whole.select("doc_id", "text").mapInArrow(_digests(path, pattern), _OUT))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
