import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidebar.llm.op2_packing import WordEncoder, pack, tokenizer_path

whole = Tokenizer.from_file(tokenizer_path())
words = WordEncoder(tokenizer_path())


def ids(text):
    return whole.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB'sé ²9.ßΣİ日\x1c\x85́\n\t<|>_Ъ")) | st.text())
def test_word_by_word_is_whole_text(text):
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == ids(text)


def test_special_strings_and_whitespace():
    for text in ("<|endoftext|> <|ENDOFTEXT|> a", "  a  b\x1cc", "It's WE'LL o'clock", "a\xa0b\x85c"):
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == ids(text)


def test_pieces_cover_every_document_once(spark):
    texts = [None, "", "one two", "a b c " * 900, "word, " * 50, "zebra stripes " * 4000] + [f"text number {i} " * (i % 37) for i in range(200)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(2, "one two", 1), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(5)
    out = pack(df, window=128, open_windows=4, fan_in=2).collect()
    by_seq = defaultdict(list)
    for r in out:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 128
    got = sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out), key=str)
    want = []
    for i, t, _ in rows:
        x = np.asarray([*ids(t), 1], "<u4")
        for s in range(0, len(x), 128):
            part = x[s : s + 128]
            want.append((i, s, len(part), zlib.crc32(part.tobytes()), len(x)))
    assert got == sorted(want, key=str)
    tokens = sum(r.length for r in out)
    assert tokens / (128 * len(by_seq)) > 0.9


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
