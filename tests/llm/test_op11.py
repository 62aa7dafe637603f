import math

import numpy as np
import pytest

from tidebar.llm.op11_vector_dedup import near_vectors, plan_tables, sketch_radius

SCHEMA = "vec_id long, embedding array<double>, label int, node int, row string, links int, v int, key long"


def brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) of every row, from all pairs."""
    fine = [label is not None and v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v, label in rows]
    links = [set() for _ in rows]
    unit = [np.array(v) / np.max(np.abs(v)) if ok else None for (_, v, _), ok in zip(rows, fine, strict=True)]
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                x, y = unit[i], unit[j]
                if float(x @ y) / math.sqrt(float(x @ x)) / math.sqrt(float(y @ y)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        todo, group = [i], {i}
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        least = min(ids) if ids else None
        for k in group:
            out[k] = (rows[k][0], len(links[k]), least, rows[k][0] == least)
    return out


def made(seed=1, dim=24):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for label in range(3):
        for _ in range(60):
            rows.append((at := at + 1, rng.standard_normal(dim).tolist(), label))
        for size, noise in ((40, 0.02), (25, 0.12), (30, 0.19), (12, 0.3)):  # tight groups, and some across the threshold
            centre = rng.standard_normal(dim)
            for _ in range(size):
                v = centre + noise * rng.standard_normal(dim)
                rows.append((at := at + 1, (v * rng.uniform(0.1, 9)).tolist(), label))
    step = rng.standard_normal(dim)
    turn = rng.standard_normal(dim)
    for k in range(30):  # a chain whose ends are far apart
        rows.append((at := at + 1, (step * math.cos(0.15 * k) + turn * math.sin(0.15 * k)).tolist(), 0))
    copied = rows[70][1]
    rows += [(2000 + k, copied, rows[70][2]) for k in range(50)]
    rows += [(2100, copied, 2), (2101, copied, None), (2102, copied, None), (2103, [2 * x for x in copied], rows[70][2]), (2000, copied, rows[70][2])]
    odd = [None, [], [0.0] * dim, [1.0, None] + [1.0] * (dim - 2), [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1)]
    rows += [(3000 + k, v, 1) for k, v in enumerate(odd * 2)]
    rows += [(4000, [1.0, 2.0], 1), (4001, [1.0, 2.0], 1), (4002, [2.0, -1.0], 1), (None, [1.0, 2.0], 1), (None, [7.0, 0.0, 0.0], 1), (None, [7.0, 0.0, 0.1], 1)]
    rows += [(5000, [1e200] * dim, 7), (5001, [3e200] * dim, 7), (5002, [1e-200] * dim, 7), (5003, [-1e-200] * dim, 7)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_equals_all_pairs(spark, block):
    rows = made()
    df = spark.createDataFrame([(*r, 0, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in near_vectors(df, block=block).select("vec_id", "n_links", "component_id", "kept").collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty_table_and_no_links(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_vectors(df).columns == ["vec_id", "n_links", "component_id", "kept"] and near_vectors(df).count() == 0
    apart = spark.createDataFrame([(1, [1.0, 0.0], 0, 0, "", 0, 0, 0), (2, [0.0, 1.0], 0, 0, "", 0, 0, 0)], SCHEMA)
    assert sorted(map(tuple, near_vectors(apart).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_plan_keeps_its_recall_at_every_size():
    last = 0
    for n in (2, 1000, 10**6, 10**10):
        bits, tables = plan_tables(n)
        share = (1 - math.acos(0.98) / math.pi) ** bits
        assert bits >= math.log2(n) and (1 - share) ** tables <= 1e-5 and tables >= last
        last = tables
    p, r = math.acos(0.98) / math.pi, sketch_radius()
    assert sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(r + 1)) >= 1 - 1e-6 and r < 40
