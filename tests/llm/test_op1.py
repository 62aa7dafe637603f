import numpy as np
from pyspark.sql import functions as F

from tidebar.llm.op1_ann import nearest


def brute(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            own = [(-float((w * v).sum()), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = [j for _, j in sorted(own)[:k]]
    return out


def test_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16) * rng.uniform(0.2, 3)]) for i in range(900)]
    rows += [(i, rows[7][1]) for i in range(1000, 1030)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] + [1.0] * 14), (2003, [float("nan")] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (2010, [1.0, 2.0]), (2020, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, block int").repartition(3)
    want = brute(rows + odd, 20, 10)
    got = {}
    for r in nearest(df, F.col("vec_id") % 10 == 0, block=400, query_block=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    assert set(got) ^ {i for i in want if want[i]} == set()
    hit = sum(len(set(got[i]) & set(want[i])) for i in got)
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert got[2010] == [2020]
    assert got[1000][:5] == want[1000][:5]
    assert nearest(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_recall_with_spread_norms_and_an_outlier(spark):
    rng = np.random.default_rng(11)
    unit = rng.standard_normal((4000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    spread = unit * np.exp(0.5 * rng.standard_normal(4000))[:, None]
    outlier = unit.copy()
    outlier[17] *= 10
    for vectors in (spread, outlier):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
        got = {}
        for r in nearest(df, F.col("vec_id") % 80 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        recall = []
        for q in range(0, 4000, 80):
            products = vectors @ vectors[q]
            products[q] = -np.inf
            recall.append(len(got[q] & set(np.argsort(-products)[:20].tolist())) / 20)
        assert np.mean(recall) >= 0.95 and min(recall) >= 0.7, (np.mean(recall), min(recall))


def test_a_repeated_query_is_asked_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[10], rows[20], rows[20]], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest(df, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == list(range(0, 60, 10))
    assert all([rank for rank, _ in found] == [1, 2, 3, 4, 5] and q not in [v for _, v in found] for q, found in got.items())
