import zlib
from collections import Counter

from tidebar.llm.op4_sharding import assign_shards, settle, walks


def sequential(counts, shards, vnodes):
    """The same rounds, key by key."""
    keys = [(a, r) for a in sorted(counts) for r in range(counts[a])]
    n = len(keys)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    placed = {}
    for k in range(shards):
        for key in keys:
            s = walks(shards, vnodes)[key[0]][k]
            if key not in placed and room[s]:
                placed[key] = s
                room[s] -= 1
    return placed


def test_runs_match_key_by_key():
    counts = {0: 50, 3: 1, 7: 20, 11: 0, 12: 9}
    want = sequential(counts, 5, 4)
    got = {(a, r): s for a, f, u, s, _ in settle(counts, 5, 4) for r in range(f, u)}
    assert got == want


def test_counts_and_slots(spark):
    rows = [(i if i % 11 else None, None if i % 13 == 0 else f"té{i % 7}", 1, "x") for i in range(1003)] + [(5, "té5", 1, "x")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, cell_ string").repartition(5)
    out = assign_shards(df).collect()
    assert len(out) == len(rows)
    per = Counter(r.shard for r in out)
    assert sorted(per) == list(range(8)) and max(per.values()) - min(per.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(per[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert assign_shards(df.where("false")).count() == 0


def test_few_keys_move_when_rows_are_added(spark):
    one = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    two = spark.range(4100).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    a = {r.doc_id: r.shard for r in assign_shards(one).collect()}
    b = {r.doc_id: r.shard for r in assign_shards(two).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.15 * len(a)
