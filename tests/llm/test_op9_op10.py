import random

import numpy as np

from tidebar.llm.op9_quality import fit, moments, quality_scores, statistics
from tidebar.llm.op10_toxicity import PRIMER, TAIL, Gains, dictionaries, features, toxicity_scores


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(20, 150))
        bad = i % 5 == 0
        toxic = not bad and i % 4 == 0
        if bad:
            words = [w.upper() + "!!" for w in words]
        for _ in range(4 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["worthless", "pathetic", "disgusting"])
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(None, "no id", "en"), (n, None, "en"), (n + 1, "", "en"), (n + 2, "x" * 200_000, "en"), (0, docs[0][1], "en")]
    return docs, labels


def held_accuracy(rows, labels, at):
    want = {r[0]: r[at] for r in labels}
    held = [r for r in rows if r.held_out and r.doc_id in want]
    return np.mean([r.predicted == want[r.doc_id] for r in held])


def test_scores_learn_their_labels(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    ls = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f, at, least in ((quality_scores, 1, 0.98), (toxicity_scores, 2, 0.9)):
        out = f(df, ls).collect()
        assert len(out) == len(docs)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
        assert held_accuracy(out, labels, at) >= least
        assert f(df.where("false"), ls).count() == 0
        one = f(df, ls.where("false")).collect()
        assert len(one) == len(docs)


def test_moments_are_sums(spark):
    texts = ["a b", "", "C D! e", "\n\n", "é" * 9]
    x = np.array([statistics(t) for t in texts])
    assert np.isfinite(x).all()
    rows = [(x[i].tolist(), i % 2) for i in range(5)]
    m = moments(spark.createDataFrame(rows, "x array<double>, y int").repartition(3))
    assert m[0][0] == 3 and np.allclose(m[0][1], x[::2].sum(axis=0)) and np.allclose(m[1][2], x[1::2].T @ x[1::2])
    model = fit(m)
    z = (x - model.mean) / model.scale
    inverse = [np.linalg.inv(f @ f.T) for f in model.factors]
    want = [model.constants[1] - 0.5 * (v - model.centres[1]) @ inverse[1] @ (v - model.centres[1]) - model.constants[0] + 0.5 * (v - model.centres[0]) @ inverse[0] @ (v - model.centres[0]) for v in z]
    assert np.allclose(model.log_ratio(x), want)


def test_words_of_long_ordinary_texts_do_not_hide_toxic_ones(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(400)]
    toxic = [(" ".join(rng.choices(vocab, k=40) + ["pathetic"] * 3),) for _ in range(60)]
    ordinary = [(" ".join(rng.choices(vocab, k=3000) + ["pathetic"] * (i % 2)),) for i in range(60)]  # half of them hold it, once in 3000 words
    found = dictionaries(spark.createDataFrame(toxic, "text string"), spark.createDataFrame(ordinary, "text string"), 8.0)
    assert b" pathetic" in found[0] and b" pathetic" not in found[1]


def test_gains_are_differences_of_compressed_lengths():
    import zstandard as zstd

    toxic, ordinary = b" worthless loser scum moron " + PRIMER, b" window table morning bread " + PRIMER
    gains = Gains(toxic, ordinary)
    words = {"scum", "moron", "loser", "window", "x", "", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é" * 40}
    found = gains.of(words)
    for w in words:
        data = PRIMER + b" " + w.encode() + b" " + TAIL
        a, b = (len(side.compress(data)) for side in gains.sides)
        assert found[w] == (a - b, 10 * (a - b) // (len(data) - len(PRIMER) - len(TAIL)))
    assert isinstance(gains.sides[0], zstd.ZstdCompressor)
    # a word shorter than the eight bytes in which no match starts still gains
    assert found["scum"][0] > 0 and found["moron"][0] > 0 and found["window"][0] < 0
    assert features(np.zeros((0, 2), int)) == [0.0] * len(features(np.ones((1, 2), int)))


def test_short_toxic_words_are_caught_and_kept_marks_the_rest(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(700):
        words = rng.choices(vocab, k=rng.randint(20, 120))
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["scum", "moron", "loser", "trash"])
        docs.append((i, " ".join(words), 1, 2.0, "p"))
        labels.append((i, int(toxic)))
    labels += [(i, 0) for i in range(0, 700, 5)]  # a second label of the same document: the largest counts
    df = spark.createDataFrame(docs, "doc_id long, text string, y int, score double, text_key string").repartition(5)
    ls = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity_scores(df, ls).collect()
    held = [r for r in rows if r.held_out]
    caught = [r.predicted for r in held if r.doc_id % 5 == 0]
    assert len(rows) == 700 and np.mean(caught) >= 0.95
    assert np.mean([r.predicted for r in held if r.doc_id % 5]) <= 0.01
    assert all(r.kept == (r.predicted == 0) for r in rows)
    # the same scores whatever the partitions
    again = {r.doc_id: r.score for r in toxicity_scores(df.coalesce(1), ls).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_the_floor_of_stems_is_an_argument(spark):
    texts = lambda n, word: spark.createDataFrame([(f"plain talk of {word if i < n else 'weather'} number{i}",) for i in range(40)], "text string")
    ordinary = texts(0, "")
    held = lambda **kw: b" pathetic" in dictionaries(texts(4, "pathetic"), ordinary, 1.5, **kw)[0]
    assert held() and held(least_texts=4) and not held(least_texts=5) and not held(one_in=8)
