"""Tool-call linking with DataFrame functions only: calls and results are joined by identifier, calls are ordered
topologically after all calls they need, arguments are validated against schemas, and each linked call is written as
canonical JSON (keys sorted at every level, no white space).

The order is a depth per call: the longest chain of calls that it needs. It is found by doubling: a table of steps (call,
needed call, length) is joined with itself, steps that end at a call without needs stay, and of steps with the same ends the
longest is kept. A chain of n calls takes log2(n) joins, and no conversation is ever gathered in one task.

Edge cases: calls without an identifier are dropped as they can't be linked; repeated calls or results of one identifier
count, the least (by sequence, then content) is kept; results without a call are rows of status ``orphan``; a need that is
not there is ignored, a call without others is a root; calls on a cycle, and those that need one of them at any distance,
have status ``cycle`` and no depth; null or broken arguments fail validation; texts of any length and empty tables work;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, read

#: A schema: tool -> argument -> (type, required). Types are those of JSON: string, integer, boolean.
SCHEMAS = {
    "ask": {"query": ("string", True), "turn": ("integer", True), "lang": ("string", False)},
    "configure": {"prompt": ("string", True), "turn": ("integer", True)},
}
_KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "boolean": ("BOOLEAN",)}


def argument_errors(tool: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Sorted messages of what is wrong with a call's arguments (a variant), by its tool's schema."""
    checks = [F.when(~F.coalesce(tool.isin(list(schemas)), F.lit(False)), F.lit("tool")), F.when(arguments.isNull(), F.lit("json"))]
    for name, args in schemas.items():
        for arg, (kind, required) in args.items():
            value = F.try_variant_get(arguments, f"$.{arg}", "variant")
            typed = F.schema_of_variant(value).isin(*_KINDS[kind])
            checks.append(F.when((tool == name) & arguments.isNotNull() & value.isNull() & F.lit(required), F.lit(f"missing {arg}")))
            checks.append(F.when((tool == name) & value.isNotNull() & ~typed, F.lit(f"type {arg}")))
    return F.array_sort(F.array_compact(F.array(*checks)))


def depths(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """``call_id, depth``: the longest chain of needed calls below each; null where a chain never ends. ``calls``: unique
    ``call_id``; ``needs``: ``call_id, needs_id``, any number per call."""
    ids = calls.select(F.col("call_id").alias("id"))
    steps = needs.join(ids, F.col("needs_id") == F.col("id"), "left_semi").where("call_id IS NOT NULL")
    steps = cut(steps.select(F.col("call_id").alias("u"), F.col("needs_id").alias("v"), F.lit(1).cast("long").alias("w")).distinct())
    total, reach = calls.count(), 1
    inner = steps.select(F.col("u").alias("v")).distinct()
    while reach <= total and not steps.join(inner, "v", "left_semi").isEmpty():
        after = steps.select(F.col("u").alias("m"), F.col("v").alias("v2"), F.col("w").alias("w2"))
        longer = steps.join(after, F.col("v") == F.col("m"), "left")
        steps = cut(longer.select("u", F.coalesce("v2", "v").alias("v"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")).groupBy("u", "v").agg(F.max("w").alias("w")))
        reach *= 2
    ends = steps.join(inner.withColumn("inner", F.lit(True)), "v", "left").groupBy("u").agg(F.max("w").alias("w"), F.max("inner").alias("endless"))
    found = calls.select("call_id").join(ends, F.col("call_id") == F.col("u"), "left")
    return found.select("call_id", F.when(F.col("endless").isNull(), F.coalesce("w", F.lit(0))).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS, needs: DataFrame | None = None) -> DataFrame:
    """``calls``: conv_id, call_id, parent_id, seq, tool, arguments (JSON text); ``results``: call_id, seq, content;
    ``needs``: call_id, needs_id, by default each call's parent. One row per call, plus one per identifier of results
    without a call."""
    one = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("n_calls"), F.min(F.struct("seq", "conv_id", "parent_id", "tool", "arguments")).alias("c"))
    one = cut(one.select("call_id", "n_calls", "c.*"))
    answers = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("seq", "content")).alias("r"))
    linked = one.join(answers.select("call_id", "n_results", F.col("r.content").alias("result")), "call_id", "full")
    needs = one.select("call_id", F.col("parent_id").alias("needs_id")) if needs is None else needs
    linked = linked.join(depths(one, needs), "call_id", "left")
    arguments = F.try_parse_json("arguments")
    errors = F.when(F.col("n_calls").isNull(), F.array().cast("array<string>")).otherwise(argument_errors(F.col("tool"), arguments, schemas))
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("depth").isNull(), "cycle").when(F.size(errors) > 0, "invalid").when(F.col("n_results").isNull(), "open").otherwise("linked")
    head, tail = F.to_json(arguments), F.to_json(F.struct("call_id", "depth", F.col("result"), "tool"), {"ignoreNullFields": "false"})
    canonical = F.concat(F.lit('{"arguments":'), F.coalesce(head, F.lit("null")), F.lit(","), F.substr(tail, F.lit(2)))
    return linked.select("conv_id", "call_id", "tool", "depth", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"), F.array_join(errors, ",").alias("errors"), canonical.alias("message"))


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a conversation table: a turn that isn't the assistant's calls a tool with its text, on top of
    the call two turns earlier; an assistant's turn is the result of the turn before it."""
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    turns = turns.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    tool = F.when(F.col("role") == "system", "configure").otherwise("ask")
    arguments = F.when(F.col("role") == "system", F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt")))).otherwise(F.to_json(F.struct(F.col("turn"), F.col("text").alias("query"))))
    asked = turns.where("role IS DISTINCT FROM 'assistant'")
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), name(F.col("turn") - 2).alias("parent_id"), F.col("turn").alias("seq"), tool.alias("tool"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*calls_of_turns(read(spark, sf_dir, "conversations")))


OP7_SQL = """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c0 AS (SELECT conv_id, turn, count(*) AS n_calls, min(struct_pack(
         tool := CASE WHEN role = 'system' THEN 'configure' ELSE 'ask' END,
         arguments := CASE WHEN role = 'system' THEN CASE WHEN text IS NULL THEN '{"turn":' || turn || '}' ELSE '{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' END
                     ELSE CASE WHEN text IS NULL THEN '{"turn":' || turn || '}' ELSE '{"query":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' END END)) AS c
       FROM t WHERE role IS DISTINCT FROM 'assistant' GROUP BY conv_id, turn),
c AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM c0),
cd AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth FROM c),
r AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min(text) AS result FROM t WHERE role = 'assistant' GROUP BY conv_id, turn),
j AS (SELECT cd.conv_id AS conv_id, coalesce(cd.conv_id, r.conv_id) || '-' || coalesce(cd.turn, r.turn) AS call_id, c.tool AS tool, c.arguments AS arguments, depth, n_calls, n_results, result
      FROM cd FULL JOIN r ON cd.conv_id = r.conv_id AND cd.turn = r.turn),
e AS (SELECT *, CASE WHEN n_calls IS NOT NULL AND arguments NOT LIKE '{"query":%' AND arguments NOT LIKE '{"prompt":%'
        THEN 'missing ' || CASE WHEN tool = 'ask' THEN 'query' ELSE 'prompt' END ELSE '' END AS errors FROM j)
SELECT conv_id, call_id, tool, depth, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
  CASE WHEN n_calls IS NULL THEN 'orphan' WHEN errors <> '' THEN 'invalid' WHEN n_results IS NULL THEN 'open' ELSE 'linked' END AS status, errors,
  '{"arguments":' || coalesce(arguments, 'null') || ',"call_id":"' || call_id || '","depth":' || coalesce(depth::VARCHAR, 'null')
    || ',"result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"tool":' || coalesce('"' || tool || '"', 'null') || '}' AS message
FROM e
"""

QUERIES = {"op7_tool_calls": op7_tool_calls}
ORACLES = {"op7_tool_calls": OP7_SQL}
