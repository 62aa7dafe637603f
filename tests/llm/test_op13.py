import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidebar.llm.op13_alignment import ByteVocabulary, align, alignment_counts, common_ends, gallop, overlap_ranges
from tidebar.llm.op3_bpe import default_pattern, ranks_path


def letters_to_bytes():
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): b for b in shown}
    n = 0
    for b in range(256):
        if b not in shown:
            out[chr(256 + n)] = b
            n += 1
    return out


def tokens(rows):
    """(doc_id, [(id, end)] of both vocabularies) by the libraries themselves; empty where the bytes differ."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = letters_to_bytes()
    out = []
    for doc, text in rows:
        lists = ([], [])
        if text:
            told = a.encode(" " + text, add_special_tokens=False)
            spelled = [(i, bytes(byte[c] for c in t)) for i, t in zip(told.ids, told.tokens, strict=True)], []
            for i in b.encode(text):
                piece = b.id_to_piece(i)
                spelled[1].append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
            if all(b"".join(s for _, s in own) == (" " + text).encode() for own in spelled):
                for own, found in zip(spelled, lists, strict=True):
                    end = 0
                    for i, s in own:
                        end += len(s)
                        found.append((i, end))
        out.append((doc, *lists))
    return out


def brute(rows):
    docs, count = [], Counter()
    for doc, a, b in tokens(rows):
        common = sorted({e for _, e in a} & {e for _, e in b})
        links = [(i, j) for i, e in a for j, f in b if e == f]
        parts, before = [], 0
        for c in common:
            parts.append("|".join(",".join(str(i) for i, e in own if before < e <= c) for own in (a, b)))
            before = c
        count.update(links)
        docs.append((doc, len(a), len(b), len(common), links, hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [(d, a, b, g, len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), sha) for d, a, b, g, x, sha in docs]


def texts(spark):
    rows = [(r.doc_id, r.text[:3000]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(50).collect() if r.text]
    odd = ["", None, " ", "  two  spaces ", "<s> </s> <unk> <|endoftext|> <0x41>", "a▁b", "日本語のテキスト 😀 ñandú", "tab\tand\r\nlines\n\n", " non​breaking", "é combined ﬁ ㎏", "x" * 5000, "ab " * 3000, "\0zero", "<0xE2>"]
    return rows + [(1000 + k, t) for k, t in enumerate(odd)] + [(1000, "again"), (1000, "again"), (None, "no identifier")]


@pytest.mark.parametrize("chunk", [1 << 24, 1 << 12])
def test_equals_brute_force(spark, chunk):
    rows = texts(spark)
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "doc_id long, text string, chunk int, links string, pairs int, at int").repartition(3)
    got = alignment_counts(df, chunk=chunk).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_real_groups_and_overlaps(spark):
    rows = texts(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for d, a, b in tokens(rows):
        want.setdefault(d, []).append((a, b))
    for r in align(df).collect():
        assert [([i for g in r.groups_a for i in g], [i for g in r.groups_b for i in g])].count(([i for i, _ in want[r.doc_id][0][0]], [i for i, _ in want[r.doc_id][0][1]])) or len(want[r.doc_id]) > 1
        if len(want[r.doc_id]) == 1 and len(want[r.doc_id][0][0]) < 300:
            a, b = want[r.doc_id][0]
            span = lambda own, k: (own[k - 1][1] if k else 0, own[k][1])
            for k, o in enumerate(r.overlaps):
                lo, hi = span(a, k)
                assert [o.first, o.end] == [min(x := [j for j in range(len(b)) if span(b, j)[0] < hi and span(b, j)[1] > lo]), max(x) + 1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment_counts(df).count() == 0 and align(df).count() == 0


def test_galloping():
    rng = np.random.default_rng(5)
    for n, m in ((0, 5), (5, 0), (1, 1), (500, 20000), (3000, 3100), (64, 65), (129, 1)):
        x, y = (np.sort(rng.choice(40000, k, replace=False)) for k in (n, m))
        assert (gallop(x, y) == np.searchsorted(y, x)).all()
        a, b = common_ends(x, y)
        assert x[a].tolist() == y[b].tolist() == sorted(set(x.tolist()) & set(y.tolist()))
    assert [r.tolist() for r in overlap_ranges(np.array([3, 5, 9]), np.array([2, 5, 6, 9]))] == [[0, 1, 2], [2, 2, 4]]


def test_ranks_give_the_ids_of_the_json():
    by_ranks, by_json = (ByteVocabulary(ranks_path(f"byte_bpe_50k.{k}"), default_pattern()) for k in ("tiktoken", "json"))
    assert by_ranks.spelled == by_json.spelled[: len(by_ranks.spelled)] or by_ranks.spelled == by_json.spelled
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    around = [f"a{c}1{c} {c}! {c}{c}  {c}" for c in every]
    told = ["".join(around[k : k + 500]) for k in range(0, len(around), 500)] + [" " * 200_000 + "x", "a" * 20_000, "don't I'LL\r\n\n  x<|endoftext|>"]
    assert by_ranks.encode(told) == by_json.encode(told)
