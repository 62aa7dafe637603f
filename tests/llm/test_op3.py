import hashlib

import numpy as np
import tiktoken  # noqa: F401

from tidebar.llm.op3_bpe import codec, default_pattern, encode, ranks_path


def expected(text):
    own = codec(ranks_path(), default_pattern())
    ids = own.encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_chunks_agree_with_whole_texts(spark):
    base = "It's a  long\n\n text, 123 we'll   see... naïve 日本語 \t\n "
    texts = [None, "", "a", base, base * 40, "x" * 3000, ("ab  " * 5 + "\n" * 7) * 90, "don't " * 500, " " * 2500, "'" * 999 + "ll " * 300]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(None, base * 7, "k"), (3, base, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = sorted(map(tuple, encode(df, chunk=200, overlap=60).collect()), key=str)
    assert got == sorted([(i, *expected(t)) for i, t, _ in rows], key=str)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_supplied_long_texts_are_cut_and_joined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from tidebar.llm.op3_bpe import CHUNK

    rows = docs.collect()
    assert sum(len(r.text or "") > CHUNK for r in rows) > 10
    base = rows[0].text or "a b"
    edges = [(10**9 + k, (base * (2 * CHUNK // len(base) + 2))[: CHUNK + k]) for k in (-1, 0, 1, 255, 256, 257)]
    edges += [(2 * 10**9, "x" * (CHUNK + 5)), (2 * 10**9 + 1, " " * (3 * CHUNK)), (2 * 10**9 + 2, "y" * 2 * CHUNK + base * 40)]  # never resynchronise
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(edges, "doc_id long, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in encode(df).collect()}
    assert len(got) == len({r.doc_id for r in rows}) + len(edges)
    for r in [*rows[:400], *(r for r in rows if len(r.text or "") > CHUNK)]:
        assert got[r.doc_id] == expected(r.text)
    for i, t in edges:
        assert got[i] == expected(t)
