import hashlib
import re

from tidebar.llm.op5_exact_dedup import drop_copies, exact_groups


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    return groups


def test_groups_match_brute_force(spark):
    texts = ["a b", "a  b", "a\tb\n", " a b", "", None, " ", "x" * 100_000, "é", "a b"]
    rows = [(i % 23 if i % 7 else None, texts[i % len(texts)] if i % 3 else "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups = brute(rows)
    out = exact_groups(df, fan_in=2).collect()
    assert len(out) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_drop_keeps_columns_and_one_row(spark):
    rows = [(1, "a", "k"), (1, "a", "k"), (0, "a ", "k"), (2, None, "k"), (None, "", "k"), (None, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = drop_copies(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a", "k"), (0, "a ", "k"), (2, None, "k"), (None, "z", None)], key=str)
    assert drop_copies(df.where("false")).count() == 0 and exact_groups(df.where("false")).count() == 0


def test_rounds_end_at_one_entry_whatever_the_plan_above(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 37 AS STRING) AS text")
    shuffled = df.join(df.selectExpr("doc_id", "text AS other"), "doc_id").groupBy("doc_id").agg({"text": "max"}).toDF("doc_id", "text")
    for source in (shuffled, shuffled.repartition(23), shuffled.orderBy("text")):
        out = exact_groups(source, fan_in=2).collect()
        assert len(out) == 400 and sum(r.kept for r in out) == 37
        assert all(r.keep_id == r.doc_id % 37 for r in out)
