import json
import random

from tidebar.llm.op6_chat import format_chat
from tidebar.llm.op7_licenses import CONTAINED, SIBLINGS, TEMPLATES, plain, scan_licenses


def call(i, name="get", **arguments):
    return json.dumps({"tool_call": {"id": i, "name": name, "arguments": arguments}})


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_calls_are_linked_ordered_and_checked(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n\u0001é'), (1, 1, "tool", result("a")), (1, 2, "assistant", call("a", city="Bern")),
        (1, 3, "assistant", call("b", city={"$result": "c"})), (1, 4, "assistant", call("c", city="X", days=2)), (1, 5, "tool", result("c")), (1, 6, "tool", result("b")),
        (1, 7, "assistant", call("d")), (1, 8, "assistant", call("d", city="again")), (1, 9, "tool", result("zzz")),
        (1, 10, "assistant", call("e", name="other", x=1)), (1, 11, "tool", result("e")), (1, 12, "assistant", call("f", city=5)), (1, 13, "tool", result("f")),
        (2, None, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (3, 0, "assistant", "{not json"), (None, 1, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string").repartition(3)
    out = format_chat(df, {"get": {"city": "string", "days": "integer?"}}).collect()
    assert len(out) == len(rows)
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)
    order = [(r.kind, r.call_id) for r in one]
    assert order.index(("call", "a")) < order.index(("result", "a"))
    assert order.index(("call", "c")) < order.index(("result", "c")) < order.index(("call", "b")) < order.index(("result", "b"))
    problems = {(r.turn): r.problem for r in one if r.problem}
    assert problems == {7: "call without result", 8: "repeated call identifier", 9: "result without call", 10: "unknown tool", 12: "argument city is no string"}
    for r in one:
        parsed = json.loads(r.line)
        assert list(parsed) == sorted(parsed)
    assert json.loads(one[0].line) == {"content": 'say "hi"\n\u0001é', "role": "user"}
    assert [r.line for r in sorted((r for r in out if r.conv_id == 2), key=lambda r: r.position)] == ['{"content":"","role":"user"}'] * 2 + ['{"content":null,"role":null}']
    assert format_chat(df.where("false")).count() == 0


def test_cycles_end(spark):
    rows = [(1, 0, "assistant", call("a", x={"$result": "b"})), (1, 1, "assistant", call("b", x={"$result": "a"})), (1, 2, "tool", result("a")), (1, 3, "tool", result("b"))]
    out = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.problem for r in out if r.kind == "call"} == {"calls wait for one another"}


def shingles(text, k=5):
    words = plain(text).decode().lower().split()
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def test_planted_notices_are_found(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    rows, want = [], set()
    for i in range(300):
        words = rng.choices(vocab, k=rng.randint(0, 400))
        name = rng.choice(sorted(TEMPLATES))
        if i % 3 == 0:
            notice = TEMPLATES[name].split()
            if len(notice) > 30 and i % 2:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = notice
        text = " ".join(words)
        own = set(shingles(text))
        for n, t in TEMPLATES.items():
            s = set(shingles(t))
            if len(s & own) >= CONTAINED * len(s):
                want.add((i, n))
        rows.append((i, text, "k"))
    rows += [(500, None, "k"), (501, "", "k"), (None, TEMPLATES["MIT-line"], "k")]
    want.add((None, "MIT-line"))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string").repartition(3)).collect()
    assert {(r.doc_id, r.license) for r in got} == want
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_siblings_are_told_apart(spark):
    rows, want = [], set()
    for name, notice in sorted((TEMPLATES | SIBLINGS).items()):
        rows += [(len(rows), notice), (len(rows) + 1, "some words before it stand here " + notice + " and some words after it")]
        names = {name, "Apache-2.0-line"} if name == "Apache-2.0" else {name}  # that notice begins with the line
        want |= {(len(rows) - i, n) for i in (1, 2) for n in names}
    rows.append((900, TEMPLATES["GPL-3.0"] + " " + SIBLINGS["GPL-2.0"]))
    rows.append((901, TEMPLATES["GPL-3.0-line"].replace("3", "9")))
    want |= {(900, "GPL-3.0"), (900, "GPL-2.0")}
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == want


def test_long_conversations_and_texts_and_white_space(spark):
    rows = [(1, t, "user", "x" * 200_000 if t == 300 else f"m{t}") for t in range(700)] + [(1, None, "user", "last"), (2, 0, "assistant", "\n\t  " + call("a", city="B")), (2, 1, "tool", "  " + result("a"))]
    out = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), {"get": {"city": "string"}}).collect()
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)
    assert [r.position for r in one] == list(range(701)) and [r.turn for r in one] == [*range(700), None]
    assert len(json.loads(one[300].line)["content"]) == 200_000
    assert sorted((r.kind, r.call_id, r.problem) for r in out if r.conv_id == 2) == [("call", "a", None), ("result", "a", None)]


def test_query_reaches_calls_results_and_problems(spark):
    from tidebar.llm.op6_chat import query

    out = query(spark, "/root/testdata/sf0.01").collect()
    assert {r.kind for r in out} == {"message", "call", "result"}
    assert {"call without result", "result without call", "repeated call identifier", "unknown tool", "argument chars is no integer"} <= {r.problem for r in out}
    at = {(r.conv_id, r.kind, r.call_id, r.problem): r.position for r in out}
    waits = 0
    for r in out:
        if r.kind == "call" and "$result" in r.line:
            need = json.loads(json.loads(r.line)["arguments"])["of"]["$result"]
            answers = [p for (c, kind, i, _), p in at.items() if (c, kind, i) == (r.conv_id, "result", need)]
            waits += len(answers)
            assert all(p < r.position for p in answers)
    assert waits > 5


def places(rows):
    """(at, step) of every call by following its needs, by hand; None: it waits for itself or for such a call."""
    turn = {c: t for c, t, _, _ in rows}
    needs = {c: n for c, _, n, _ in rows}
    reply = {c: r for c, _, _, r in rows}
    now = {c: (t, 0) for c, t in turn.items()}
    for k in range(3 * len(rows) + 3):
        then = {c: max([now[c], *((reply[d], 1) if reply[d] is not None and reply[d] > now[d][0] else (now[d][0], now[d][1] + 2) for d in needs[c] if d in now)]) for c in now}
        if k > len(rows) + 1:
            endless = {c for c in now if then[c] != now[c]}
        now = then
    return {c: None if c in endless else v for c, v in now.items()}


def test_places_equal_those_by_hand(spark, small_plans):
    from pyspark.sql import functions as F

    from tidebar.llm.op6_chat import _placed

    rng = random.Random(11)
    graphs = []
    for g in range(14):
        n = rng.randint(1, 14)
        several = g % 3 == 0
        rows = []
        for i in range(n):
            k = rng.randint(0, 3) if several else rng.choice([0, 1, 1, 1])
            pool = range(i) if g % 2 else range(n)  # even ones may have cycles
            rows.append((f"c{i}", rng.randint(0, 12), sorted({f"c{rng.choice(pool)}" for _ in range(k)} if pool else set()), rng.choice([None, rng.randint(0, 20)])))
        graphs.append(rows)
    own = spark.createDataFrame([(g, c, t) for g, rows in enumerate(graphs) for c, t, _, _ in rows], "conv_id long, call_id string, turn long").select("conv_id", "call_id", F.struct(F.col("turn").alias("at"), F.lit(0).cast("long").alias("step")).alias("own"))
    needs = spark.createDataFrame([(g, c, d) for g, rows in enumerate(graphs) for c, _, n, _ in rows for d in n], "conv_id long, call_id string, need string")
    replies = spark.createDataFrame([(g, c, r) for g, rows in enumerate(graphs) for c, _, _, r in rows if r is not None], "conv_id long, need string, reply long")
    got = {(r.conv_id, r.call_id): None if r.step < 0 else (r["at"], r.step) for r in _placed(own, needs, replies).collect()}
    want = {(g, c): v for g, rows in enumerate(graphs) for c, v in places(rows).items()}
    print(sum(v is None for v in want.values()), len(want))
    assert got == want and None in want.values()


def test_a_chain_of_a_thousand_calls_takes_few_rounds(spark, small_plans, monkeypatch):
    from tidebar.llm import op6_chat

    rounds, real = [], op6_chat.saved
    monkeypatch.setattr(op6_chat, "saved", lambda df, name: (rounds.append(name), real(df, name))[1])
    rows = [(1, i, "assistant", call(f"c{i}", **({"x": {"$result": f"c{i + 1}"}} if i < 999 else {}))) for i in range(1000)]
    out = sorted(op6_chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.position)
    print(rounds.count("jumps"))
    assert [r.call_id for r in out] == [f"c{i}" for i in reversed(range(1000))]
    assert rounds.count("jumps") <= 12 + 2  # the first table, and the one without cycles


def test_turns_that_are_null_or_equal_and_columns_that_clash(spark, small_plans):
    texts = [f"m{i:03}" for i in range(60)]
    said = [(1, None, "user", t) for t in texts] + [(2, 7, "user", t) for t in texts] + [(3, None, "assistant", call("a", city="B")), (3, None, "tool", result("a"))]
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in reversed(said)], "conv_id long, turn long, role string, text string, kind string, call_id string, at int, step int").repartition(4)
    out = sorted(format_chat(df, {"get": {"city": "string"}}).collect(), key=lambda r: (r.conv_id, r.position))
    for c in (1, 2):
        one = [r for r in out if r.conv_id == c]
        assert [r.position for r in one] == list(range(60)) and [json.loads(r.line)["content"] for r in one] == texts
    assert [(r.position, r.kind, r.call_id, r.problem) for r in out if r.conv_id == 3] == [(0, "call", "a", None), (1, "result", "a", None)]
