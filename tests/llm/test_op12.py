import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidebar.llm.op12_spelling import count_words, near_pairs, variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out, form = {}, {}
    for w in n:
        near = sorted((-n[x], x) for x in n if one_edit(w, x))
        form[w] = near[0][1] if near and -near[0][0] >= 10 * n[w] else None
        out[w] = len(near)
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def documents(spark, sf="0.001", n=60):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").orderBy("doc_id").limit(n).collect()]
    planted = "Strassen strassen Strässen strassenn trassen strassem " + "strasse " * 3 + "ÀÉÎÕÜçñÿ ÀÉÎÕÜçñÿ ÀÉÎÕÜçñ Àéîõüçñÿ " * 3
    chain = "abcdefgh " * 300 + "abcdefgx " * 25 + "abcdefyx " * 2 + "aaaaaaa " * 4 + "aaaaaaaa " * 4 + "aaaaaaaaa " * 50
    rows += [(9001, planted), (9002, planted + chain), (9002, planted + chain), (9003, None), (9004, ""), (None, chain + "x" * 70_000 + " " + "x" * 70_000 + " " + "x" * 69_999 + "y"), (9005, "x" * 70_000 + " " + "X" * 69_999 + "y" + " 丁strassen丁")]
    return rows


@pytest.mark.parametrize(("block", "cells"), [(1024, 1 << 22), (7, 1 << 22)])
def test_equals_all_pairs(spark, block, cells):
    rows = documents(spark)
    df = spark.createDataFrame([(*r, "w", 5, 6) for r in rows], "doc_id long, text string, word string, n int, run int").repartition(3)
    got = [tuple(r) for r in variants(count_words(df), block=block, cells=cells).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] is not None for r in want) > 3 and any(r[2] not in (r[0], r[1]) for r in want)


def test_pairs_of_both_halves_count_once():
    words = ["abcdefg", "abcdefx", "xbcdefg", "abcxefg", "abcdefgh", "abcxdefg", "zzzzzzz"]
    for a in words:
        for b in words:
            if len(a) >= len(b) and a != b:
                length = len(a)
                half = length // 2
                told = (a[:half] == b[:half] and near_pairs([a], [b], length, False)[0, 0]) + (a[-half:] == b[-half:] and near_pairs([a], [b], length, True)[0, 0])
                assert told == one_edit(a, b), (a, b)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = variants(count_words(df))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
    assert variants(count_words(spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("einzeln").alias("text")))).count() == 0
