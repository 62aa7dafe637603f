"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

A message is a row (conv_id, turn, role, text). An assistant's text that is a JSON object with the
key ``tool_call`` ({"tool_call": {"id", "name", "arguments"}}) is a call; a tool's text that is an
object with ``tool_call_id`` is a result. Calls and results are linked by a hash join on conversation
and identifier. Order is topological: a result comes after its call, a call after the results that its
arguments name as {"$result": id}; else turns decide. Arguments are validated against the tools'
schemas. Every message becomes one line of canonical JSON (keys in order, no white space), so a
conversation is its lines in order of ``position``; no conversation is gathered into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.llm.common import drop_saved, saved, table

QUERY = "op6_chat_format"

#: Argument types of a tool's schema, by how canonical JSON of such a value looks.
TYPES = {"string": '^"', "number": r"^-?\d", "integer": r"^-?\d+$", "boolean": "^(true|false)$", "object": r"^\{", "array": r"^\["}

#: Tools and argument types that ``query`` validates against.
SCHEMAS = {"measure": {"chars": "integer"}, "count": {"of": "integer?", "words": "integer"}}
#: Turns of a conversation that are numbered in one task.
TURNS = 256
#: The step of calls that wait for one another, and a place before all turns.
ENDLESS, NEVER = 1 << 40, -(1 << 62)

ORACLE_SQL = r"""
WITH a AS (
  SELECT DISTINCT conv_id, turn, text, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL
), b AS (
  SELECT *, 'c' || turn AS id, CASE WHEN n % 17 = 0 THEN 'forget' WHEN n % 3 = 0 THEN 'count' ELSE 'measure' END AS name,
         n % 17 <> 0 AND n % 3 = 0 AND n % 2 = 0 AS asks
  FROM a
), c AS (
  SELECT b.*, b.asks AND later.turn IS NOT NULL AS waits,
         CASE WHEN b.asks THEN '{"of":{"$result":"c' || (b.turn + 2) || '"},"words":' || (b.n // 6) || '}'
              WHEN b.name = 'count' THEN '{"words":' || (b.n // 6) || '}'
              WHEN b.n % 5 = 0 THEN '{"chars":"' || b.n || '"}' ELSE '{"chars":' || b.n || '}' END AS arguments
  FROM b LEFT JOIN (SELECT DISTINCT conv_id, turn FROM b) AS later ON later.conv_id = b.conv_id AND later.turn = b.turn + 2
), d AS (
  SELECT *, min(CASE WHEN NOT waits THEN turn END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last
  FROM c
), rows_ AS (
  SELECT conv_id, turn, role, text, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS VARCHAR) AS problem, turn AS at_, 0 AS step,
         '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS line
  FROM conversations
  UNION ALL
  SELECT conv_id, turn, 'assistant', CASE WHEN n % 7 = 0 THEN '  ' ELSE '' END || '{"tool_call":{"id":"' || id || '","name":"' || name || '","arguments":' || arguments || '}}', 'call', id,
         CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN 'call without result' WHEN name = 'forget' THEN 'unknown tool' WHEN name = 'measure' AND n % 5 = 0 THEN 'argument chars is no integer' END,
         last, last - turn,
         '{"arguments":' || CAST(to_json(arguments) AS VARCHAR) || ',"id":"' || id || '","name":"' || name || '","role":"assistant"}'
  FROM d
  UNION ALL
  SELECT conv_id, turn + 1, 'assistant', '{"tool_call":{"id":"' || id || '","name":"measure","arguments":{"chars":' || (n + 1) || '}}}', 'call', id, 'repeated call identifier', turn + 1, 0,
         '{"arguments":"{\"chars\":' || (n + 1) || '}","id":"' || id || '","name":"measure","role":"assistant"}'
  FROM d WHERE n % 19 = 0
  UNION ALL
  SELECT conv_id, turn, 'tool', '{"tool_call_id":"' || CASE WHEN n % 13 = 0 THEN 'x' ELSE 'c' END || turn || '","content":"' || n || '"}', 'result', CASE WHEN n % 13 = 0 THEN 'x' ELSE 'c' END || turn,
         CASE WHEN n % 13 = 0 THEN 'result without call' END, CASE WHEN n % 13 = 0 THEN turn ELSE last END, CASE WHEN n % 13 = 0 THEN 0 ELSE last - turn + 1 END,
         '{"content":"' || n || '","role":"tool","tool_call_id":"' || CASE WHEN n % 13 = 0 THEN 'x' ELSE 'c' END || turn || '"}'
  FROM d WHERE n % 11 <> 0
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY at_ NULLS LAST, step, turn NULLS LAST, role NULLS LAST, text NULLS LAST) - 1 AS position, turn, kind, call_id, problem, line
FROM rows_
"""


def _parsed(text: Column) -> Column:
    """The text as canonical JSON if it is an object, white space before it or not; else null."""
    return F.when(F.ltrim(text, F.lit(" \t\r\n")).startswith("{"), F.to_json(F.try_parse_json(text)))


def _problem(name: Column, arguments: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """What is wrong with a call's arguments (canonical JSON), or null. A ``?`` after a type: optional."""
    checked = F.lit("unknown tool")
    for tool, fields in schemas.items():
        found: Column = F.when(~arguments.startswith("{"), "arguments are no object")
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        known = F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")
        found = found.when(F.size(F.array_except(keys, known)) > 0, F.concat(F.lit("unknown argument "), F.array_min(F.array_except(keys, known))))
        for field, kind in sorted(fields.items()):
            value = F.to_json(F.try_variant_get(F.try_parse_json(arguments), f"$['{field}']", "variant"))
            reference = value.startswith('{"$result":')
            there = F.array_contains(keys, field)
            if not kind.endswith("?"):
                found = found.when(~there, f"missing argument {field}")
            found = found.when(there & ~F.coalesce(reference | value.rlike(TYPES[kind.rstrip("?")]), F.lit(False)), f"argument {field} is no {kind.rstrip('?')}")
        checked = F.when(name == tool, found).otherwise(checked)
    return checked


def format_chat(df: DataFrame, schemas: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Per message: conv_id, position, turn, kind (message, call, result), call_id, problem, line.

    Null turns come last, and ties are ordered by role and text; null text is JSON null. A repeated
    call identifier links to its first call and is a problem, as are results without call, calls
    without result, and calls that wait for one another (these keep their turns). Repeated rows stay.
    An empty table gives no rows; other columns are not read. A conversation may be of any length:
    positions are numbered within ranges of turns and moved up by the counts of earlier ranges.
    """
    m = df.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.when(F.col("role").isin("assistant", "tool"), _parsed(F.col("text"))).alias("doc"))
    m = m.withColumn("call", F.when(F.col("role") == "assistant", F.get_json_object("doc", "$.tool_call")))
    m = m.withColumn("call_id", F.when(F.col("call").isNotNull(), F.get_json_object("call", "$.id")).when(F.col("role") == "tool", F.get_json_object("doc", "$.tool_call_id")))
    m = m.withColumn("kind", F.when(F.col("call").isNotNull(), "call").when(F.col("call_id").isNotNull(), "result").otherwise("message"))
    plain = m.where("kind = 'message'").select("conv_id", "turn", "role", "text", "kind", "call_id", F.lit(None).cast("string").alias("problem"), F.col("turn").alias("at"), F.lit(0).alias("step"), _line(content=F.col("text"), role=F.col("role")).alias("line"))
    tools = saved(m.where("kind <> 'message'").withColumn("row", F.monotonically_increasing_id()), "tools")
    linked = _linked(tools, schemas)
    all_ = plain.unionByName(linked)
    all_ = all_.withColumn("range_", F.floor(F.col("at") / TURNS))
    counts = all_.groupBy("conv_id", "range_").agg(F.count("*").alias("n_"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("range_").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("c_"), F.col("range_").alias("r_"), F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    placed = all_.join(counts, F.col("conv_id").eqNullSafe(F.col("c_")) & F.col("range_").eqNullSafe(F.col("r_")))
    order = Window.partitionBy("conv_id", "range_").orderBy(F.col("at").asc_nulls_last(), "step", F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    return placed.select("conv_id", (F.col("before_") + F.row_number().over(order) - 1).cast("long").alias("position"), "turn", "kind", "call_id", "problem", "line")


def _line(**fields: Column) -> Column:
    """Canonical JSON of one message: keys in order, nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def _later(v: Column, links: Column | int) -> Column:
    """A place ``links`` links of calls and results after ``v``."""
    return F.struct(v["at"].alias("at"), (v["step"] + 2 * links).alias("step"))


def _placed(own: DataFrame, needs: DataFrame, replies: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, step): where every call stands after the results that it names; step -1: calls wait for one another.

    A call's place is the greatest of its own, of the places of its results (step 1) and of those of the calls that it
    needs, two steps on. That is a maximum over paths, so calls that need one other are cut short by pointer doubling:
    a chain of n calls takes log2(n) rounds. What is left are calls that need several; they move on by a round for
    each of them on the longest path. What never ends is a cycle.
    """
    on = ["conv_id", "call_id"]
    known = own.select("conv_id", F.col("call_id").alias("need"))
    edges = needs.join(known, ["conv_id", "need"]).join(replies, ["conv_id", "need"], "left").select(*on, "need", F.struct(F.col("reply").alias("at"), F.lit(1).cast("long").alias("step")).alias("reply"))
    edges = saved(edges.join(edges.groupBy(*on).agg(F.count("*").alias("n")), on), "edges")
    one = saved(edges.where("n = 1").join(own, on).select(*on, F.col("need").alias("to"), F.lit(1).cast("long").alias("hops"), F.greatest("own", "reply").alias("v")), "jumps")
    most = one.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length() + 1 if most else 0):
        beyond = one.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("to_"), F.col("hops").alias("hops_"), F.col("v").alias("v_"))
        more = F.col("to_").isNotNull()
        new = saved(one.join(beyond, ["conv_id", "to"], "left").select(*on, F.coalesce("to_", "to").alias("to"), (F.col("hops") + F.coalesce("hops_", F.lit(0))).alias("hops"), F.when(more, F.greatest(F.col("v"), _later(F.col("v_"), F.col("hops")))).otherwise(F.col("v")).alias("v"), more.alias("more")), "jumps")
        drop_saved(one)
        one = new
        if one.where("more").isEmpty():
            break
    # what still points at a call that needs one other leads into a cycle; all places of the cycle are in ``v`` there
    cycle = one.select("conv_id", F.col("call_id").alias("to"), F.coalesce("v.at", F.lit(NEVER)).alias("latest"))
    free = F.coalesce("v.at", F.lit(NEVER)) > F.col("latest")
    one = saved(one.join(cycle, ["conv_id", "to"], "left").select(*on, F.when(F.col("latest").isNull(), F.col("to")).alias("to"), "hops", F.when(F.col("latest").isNull() | free, F.col("v")).otherwise(F.struct("v.at", F.lit(ENDLESS).alias("step"))).alias("v")), "jumps")
    several = edges.where("n > 1").select(*on).distinct()
    ends = own.join(one, on, "left_anti").join(several, on, "left_anti").select(*on, F.col("own").alias("v"))
    if not several.isEmpty():
        ends = saved(ends.unionByName(_relaxed(own, edges, one, several)), "ends")
    last = ends.select("conv_id", F.col("call_id").alias("to"), F.col("v").alias("end"))
    reached = F.when(F.col("end").isNull(), F.col("v")).otherwise(F.greatest(F.col("v"), _later(F.col("end"), F.col("hops"))))
    out = ends.unionByName(one.join(last, ["conv_id", "to"], "left").select(*on, reached.alias("v")))
    return saved(out.select(*on, "v.at", F.when(F.col("v.step") >= ENDLESS, -1).otherwise(F.col("v.step")).alias("step")), "at")


def _relaxed(own: DataFrame, edges: DataFrame, one: DataFrame, several: DataFrame) -> DataFrame:
    """(conv_id, call_id, v): places of the calls that need several, whose needs are followed over chains of calls that need one."""
    on = ["conv_id", "call_id"]
    chains = one.select("conv_id", F.col("call_id").alias("need"), "to", "hops", "v")
    met = edges.where("n > 1").join(chains, ["conv_id", "need"], "left")
    whence, links = F.when(F.col("hops").isNull(), F.col("need")).otherwise(F.col("to")), F.coalesce("hops", F.lit(0)) + 1
    met = met.select(*on, "reply", F.when(F.col("hops").isNotNull(), _later(F.col("v"), 1)).alias("chain"), whence.alias("whence"), links.alias("links"))
    there = several.select("conv_id", F.col("call_id").alias("whence"), F.lit(True).alias("open"))
    met = saved(met.join(there, ["conv_id", "whence"], "left").join(own.select("conv_id", F.col("call_id").alias("whence"), F.col("own").alias("start")), ["conv_id", "whence"], "left"), "met")
    fixed = met.groupBy(*on).agg(F.max(F.greatest("reply", "chain", F.when(F.col("start").isNotNull(), _later(F.col("start"), F.col("links"))))).alias("fixed"))
    now = saved(own.join(fixed, on).select(*on, F.greatest("own", "fixed").alias("v"), F.lit(False).alias("stuck")), "several")
    links = saved(met.where("open").select(*on, "whence", "links"), "links")
    # a path is no longer than its conversation's links
    longest = links.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for k in range(2 * longest + 3 if longest else 0):
        moves = links.join(now.select("conv_id", F.col("call_id").alias("whence"), "v"), ["conv_id", "whence"]).groupBy(*on).agg(F.max(_later(F.col("v"), F.col("links"))).alias("later"))
        moved = now.join(moves, on, "left").withColumn("then", F.greatest("v", "later"))
        stuck = F.col("stuck") | (F.lit(k > longest) & (F.col("then") != F.col("v")))
        new = saved(moved.select(*on, F.col("then").alias("v"), stuck.alias("stuck")), "several")  # what still moves after the longest path is a cycle or waits for one
        settled = new.exceptAll(now).isEmpty()
        drop_saved(now)
        now = new
        if settled:
            break
    return now.select(*on, F.when(F.col("stuck"), F.struct("v.at", F.lit(ENDLESS).alias("step"))).otherwise(F.col("v")).alias("v"))


def _linked(tools: DataFrame, schemas: dict[str, dict[str, str]] | None) -> DataFrame:
    first = Window.partitionBy("conv_id", "call_id").orderBy(F.col("turn").asc_nulls_last(), "row")
    calls = tools.where("kind = 'call'").withColumn("nth", F.row_number().over(first))
    name, arguments = F.get_json_object("call", "$.name"), F.coalesce(F.get_json_object("call", "$.arguments"), F.lit("{}"))
    calls = calls.select("conv_id", "call_id", "turn", "role", "text", "row", "nth", name.alias("name"), arguments.alias("arguments"))
    results = tools.where("kind = 'result'").select("conv_id", "call_id", "turn", "role", "text", "row", F.get_json_object("doc", "$.content").alias("content"))
    # effective turn and depth of every call: after the results that its arguments name
    needs = calls.where("nth = 1").select("conv_id", "call_id", F.explode(F.regexp_extract_all("arguments", F.lit(r'\{"\$result":"((?:[^"\\]|\\.)*)"\}'))).alias("need")).distinct()
    own = calls.where("nth = 1").select("conv_id", "call_id", F.struct(F.col("turn").alias("at"), F.lit(0).cast("long").alias("step")).alias("own"))
    replies = results.groupBy("conv_id", F.col("call_id").alias("need")).agg(F.min("turn").alias("reply"))
    at = _placed(saved(own, "own"), needs, replies)
    answered = results.select("conv_id", "call_id").distinct().withColumn("answered", F.lit(True))
    calls = calls.join(at, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    wrong = _problem(F.col("name"), F.col("arguments"), schemas) if schemas is not None else F.lit(None).cast("string")
    problem = F.when(F.col("call_id").isNull(), "call without identifier").when(F.col("nth") > 1, "repeated call identifier").when(F.col("step") < 0, "calls wait for one another").when(F.col("answered").isNull(), "call without result").otherwise(wrong)
    own = F.col("nth") > 1
    call_rows = calls.select(
        "conv_id", "turn", "role", "text", F.lit("call").alias("kind"), "call_id", problem.alias("problem"),
        F.when(own | (F.col("step") < 0), F.col("turn")).otherwise(F.coalesce("at", "turn")).alias("at"),
        F.when(own, 0).otherwise(F.greatest(F.coalesce("step", F.lit(0)), F.lit(0))).alias("step"),
        _line(arguments=F.col("arguments"), id=F.col("call_id"), name=F.col("name"), role=F.col("role")).alias("line"),
    )
    known = at.select("conv_id", "call_id", F.col("at").alias("call_at"), F.greatest("step", F.lit(0)).alias("call_step"))
    results = results.join(known, ["conv_id", "call_id"], "left")
    late = F.col("call_at").isNotNull() & ((F.col("turn") <= F.col("call_at")) | F.col("turn").isNull())
    result_rows = results.select(
        "conv_id", "turn", "role", "text", F.lit("result").alias("kind"), "call_id",
        F.when(F.col("call_step").isNull(), "result without call").alias("problem"),
        F.when(late, F.col("call_at")).otherwise(F.col("turn")).alias("at"),
        F.when(late, F.col("call_step") + 1).otherwise(0).alias("step"),
        _line(content=F.col("content"), role=F.col("role"), tool_call_id=F.col("call_id")).alias("line"),
    )
    return call_rows.unionByName(result_rows)


def stated_calls(df: DataFrame) -> DataFrame:
    """Calls and results that the assistants' messages of ``df`` state, as rows (conv_id, turn, role, text).

    The supplied conversations hold none, so every assistant's message states one, all of it derived
    from its turn and its text's length: a call of ``measure`` or ``count`` (of ``forget``, which no
    schema knows, where 17 divides the length), its number as a string (where 5 divides it), the
    next message's result as an argument, white space before it, an identifier used again a turn
    later (19), no result (11) or a result that names another call (13).
    """
    a = df.where("role = 'assistant' AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    div = lambda k: F.col("n") % k == 0
    name = F.when(div(17), "forget").when(div(3), "count").otherwise("measure")
    number = F.col("n").cast("string")
    words = F.floor(F.col("n") / 6).cast("string")
    asked = F.concat(F.lit('{"of":{"$result":"c'), F.col("turn") + 2, F.lit('"},"words":'), words, F.lit("}"))
    chars = F.concat(F.lit('{"chars":'), F.when(div(5), F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number), F.lit("}"))
    arguments = F.when((name == "count") & div(2), asked).when(name == "count", F.concat(F.lit('{"words":'), words, F.lit("}"))).otherwise(chars)
    call = lambda name, arguments: F.concat(F.lit('{"tool_call":{"id":"c'), F.col("turn"), F.lit('","name":"'), name, F.lit('","arguments":'), arguments, F.lit("}}"))
    first = F.concat(F.when(div(7), "  ").otherwise(""), call(name, arguments))
    again = call(F.lit("measure"), F.concat(F.lit('{"chars":'), F.col("n") + 1, F.lit("}")))
    result = F.concat(F.lit('{"tool_call_id":"'), F.when(div(13), "x").otherwise("c"), F.col("turn"), F.lit('","content":"'), number, F.lit('"}'))
    row = lambda turn, role, text: F.struct(turn.alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    stated = F.array(row(F.col("turn"), "assistant", first), F.when(div(19), row(F.col("turn") + 1, "assistant", again)), F.when(~div(11), row(F.col("turn"), "tool", result)))
    return a.select("conv_id", F.explode(F.array_compact(stated)).alias("row")).select("conv_id", "row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return format_chat(said.unionByName(stated_calls(said)), SCHEMAS)
