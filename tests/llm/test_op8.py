import random

import numpy as np

from tidebar.llm.op8_near_dedup import near_groups
from tidebar.llm.shingles import shingle_sets


def sets_of(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ")
    for c in "\t\n\r\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k=4):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * u:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(ids[find(i)])) for i, (d, _) in enumerate(rows)]


def family_rows(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    texts = [None, "", " \n\t", "one", "One  ", "a b c", "a b c d", "x y z w v", "X Y z\x0bw v", "\x1c a", "b" * 50_000 + " é É"]
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([6, 12, 40, 150, 300]))
        for _ in range(rng.choice([1, 3, 9])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own))
    drift = rng.choices(vocab, k=120)  # a chain: neighbours are linked, its ends are not
    for _ in range(25):
        drift = list(drift)
        drift[rng.randrange(len(drift))] = rng.choice(vocab)
        drift[rng.randrange(len(drift))] = rng.choice(vocab)
        texts.append(" ".join(drift))
    texts += [" ".join(passage + rng.choices(vocab, k=25)) for _ in range(80)]
    rng.shuffle(texts)
    texts += texts[:30]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_matches_brute_force(spark):
    rows = family_rows()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int").repartition(5)
    for block in (512, 3):  # 3: families are cut into blocks
        out = near_groups(df, block=block).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == sorted(brute(rows))
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_nulls_and_repeats(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a  b c d e"), (7, "a  b c d e"), (None, None), (3, "q")]
    out = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6
    assert {r.component_id for r in out if r.n_shingles == 2} == {7}
    assert sum(r.row_kept for r in out if r.n_shingles == 2) == 1
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_set_sizes_are_exact():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\tA\x0bé") for _ in range(rng.randint(0, 400))) for _ in range(300)] + ["word " * 900_000]
    for t, s in zip(texts, shingle_sets([t.encode() for t in texts], 4), strict=True):
        assert len(s) == len(sets_of(t)) and (np.diff(s.astype(object)) > 0).all()


def test_blocks_are_bounded_by_shingles(spark):
    rows = family_rows(7)
    want = sorted((i, c) for i, _, c in brute(rows))
    got = sorted((r.doc_id, r.component_id) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=1000, shingles=300).collect())
    assert got == want
