import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tests.llm.test_op2 import ids  # noqa: E402
from tests.llm.test_op8 import brute  # noqa: E402
from tests.llm.test_op9_op10 import corpus  # noqa: E402
from tidebar.llm.op9_quality import quality_scores  # noqa: E402
from tidebar.llm.op10_toxicity import toxicity_scores  # noqa: E402


def test_stages_take_effect(spark, tmp_path):
    docs, labels = corpus(400, seed=9)
    docs += [(10_000 + i, docs[i][1].replace(" ", "\t ", 1), "en") for i in (3, 7)] + [(20_000, docs[9][1] + " and one more word", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == df.columns
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = now.collect()
    quality, toxic = {i: q for i, q, _ in labels}, {i: t for i, _, t in labels}
    left = {r.doc_id for r in seen["quality"]}
    assert sum(i in left for i in quality if quality[i]) > 0.97 * sum(quality.values())
    assert sum(i in left for i in quality if not quality[i]) < 0.03 * len(quality)
    left2 = {r.doc_id for r in seen["toxicity"]}
    assert sum(i in left2 for i in left if toxic.get(i)) <= 0.15 * sum(toxic.values())
    left3 = {r.doc_id for r in seen["exact_dedup"]}
    assert not left3 & {10_003, 10_007} and len(seen["exact_dedup"]) == len(left3)
    left4 = {r.doc_id for r in seen["near_dedup"]}
    assert left4 <= left3 and (20_000 in left4) + (9 in left4) == min(1, (9 in left3) + (20_000 in left3))
    tokens = {}
    for r in seen["packing"]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    texts = {r.doc_id: r.text for r in seen["near_dedup"]}
    assert tokens == {i: len(ids(t)) + 1 for i, t in texts.items()}


def test_run_gives_the_stages_result(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.columns[:2] == ["doc_id", "start"]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def near_kept(rows):
    """Rows (doc_id, text) that stay of every group of linked texts: those of the smallest doc_id."""
    groups = {i: g for i, _, g in brute(rows, 5)}
    return {i for i, _ in rows if groups[i] == i}


def test_stages_equal_brute_force_with_clashing_columns(spark, tmp_path):
    docs, labels = corpus(300, seed=4)
    docs = [d for d in docs if d[0] is not None and d[0] != 0]  # identifiers once each, for a plain comparison
    rng = random.Random(1)
    docs += [(5_000 + k, docs[k][1].replace(" ", " \n", 2), "en") for k in range(0, 60, 3) if docs[k][1]]
    for k in range(1, 60, 4):
        words = (docs[k][1] or "").split(" ")
        words[rng.randrange(len(words))] = "changed"
        docs.append((6_000 + k, " ".join(words), "en"))
    names = ["x", "row", "score", "y", "text_key", "predicted", "node", "kept", "group", "digest"]
    df = spark.createDataFrame([(i, t, lang, *range(len(names))) for i, t, lang in docs], "doc_id long, text string, lang string, " + ", ".join(f"{n} long" for n in names)).repartition(6)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labelled = spark.read.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        out = stage(spark, now, str(tmp_path))
        if name == "packing":
            rows = out.collect()
            pieces = {}
            for r in rows:
                pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
            for i, text in before.items():
                whole = [*ids(text), 1]
                own = sorted(pieces.pop(i))
                assert [p[0] for p in own] == [sum(q[1] for q in own[:k]) for k in range(len(own))] and sum(p[1] for p in own) == len(whole)
                assert all(zlib.crc32(np.asarray(whole[a : a + n], "<u4").tobytes()) == crc for a, n, crc in own)
            assert not pieces
            continue
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.columns == df.columns
        if name in ("quality", "toxicity"):
            score, good = (quality_scores, 1) if name == "quality" else (toxicity_scores, 0)
            again = spark.read.parquet(f"{tmp_path}/documents.parquet" if name == "quality" else f"{tmp_path}/quality")
            want = {r.doc_id for r in score(again, labelled).collect() if r.predicted == good}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(normal(before[i]), i)
            want = set(first.values())
        else:
            want = near_kept(sorted(before.items()))
        rows = now.collect()
        assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        assert want < set(before), name
        assert all(r.text == before[r.doc_id] and [r[n] for n in names] == list(range(len(names))) for r in rows)


def test_an_empty_table_goes_through_all_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
