"""Operator 1: chat formatting with tool calls, in DataFrame functions only.

`link_tool_calls` joins calls and results by identifier, gives each call its level in the order of
dependencies (a call stands after all calls it depends on), checks arguments against schemas and
serialises every call with its result as canonical JSON (keys sorted, no white space).

Cases: an identifier holds within its conversation; a row whose identifier or conversation is null links with nothing
and stays as a row of its own, a call without level; calls repeated under one identifier count once, the first by
(turn, name, arguments) stands, as does the first result by (turn, content); a result without a call is a
row with status `orphan_result`; a dependency that names no call is left out and listed; calls on a cycle,
or behind one, have a null level; arguments that are null or no JSON object are invalid; an empty table gives an
empty result; columns other than those named here are ignored, whatever their names. A conversation or
identifier may hold any share of the rows: all grouping is pre-aggregated and no window is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlane.llm.store import written

#: Types of values as a VARIANT names them, by the name a schema uses.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}


def argument_errors(arguments: Column, name: Column, schemas: dict) -> Column:
    """Sorted error messages. schemas: tool -> {field: {"type", "required", "max_length", "minimum", "maximum"}}."""
    v = F.try_parse_json(arguments)
    kind = F.schema_of_variant(v)
    per_tool = F.lit(None).cast("array<string>")
    for tool, fields in schemas.items():
        checks = []
        for field, rule in fields.items():
            path = f"$.{field}"
            got = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
            text = F.try_variant_get(v, path, "string")
            missing = got.isNull() | (got == "VOID")
            if rule.get("required"):
                checks.append(F.when(missing, F.lit(f"{field}: missing")))
            if "type" in rule:
                checks.append(F.when(~missing & ~F.regexp_extract(got, "^[A-Z]+", 0).isin(*TYPES[rule["type"]]), F.lit(f"{field}: not {rule['type']}")))
            if "max_length" in rule:
                checks.append(F.when(F.length(text) > rule["max_length"], F.lit(f"{field}: too long")))
            if "minimum" in rule:
                checks.append(F.when(text.try_cast("double") < rule["minimum"], F.lit(f"{field}: too small")))
            if "maximum" in rule:
                checks.append(F.when(text.try_cast("double") > rule["maximum"], F.lit(f"{field}: too large")))
        errors = F.array_sort(F.array_compact(F.array(*checks))) if checks else F.array().cast("array<string>")
        per_tool = F.when(name == tool, errors).otherwise(per_tool)
    unknown = F.array(F.concat(F.lit("unknown tool: "), F.coalesce(name, F.lit("null"))))
    return F.when(kind.isNull() | ~F.startswith(kind, F.lit("OBJECT")), F.array(F.lit("arguments: not an object"))).otherwise(F.coalesce(per_tool, unknown))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """call_id, topo_level: the longest chain of dependencies below each call. Identifiers may be of any type that compares.

    Chains of calls with one dependency are contracted first by doubling jumps, in as many rounds as the logarithm
    of their length; then each round settles the calls with several dependencies whose dependencies are settled.
    """
    edges = written(edges.select("child", "parent").distinct())
    count = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("to"))
    jumps = written(count.where("n = 1").select(F.col("child").alias("call_id"), "to", F.lit(1).alias("dist")))
    single = jumps.select("call_id")
    for _ in range(max(1, jumps.count()).bit_length() + 1):
        nxt = jumps.select(F.col("call_id").alias("to"), F.col("to").alias("far"), F.col("dist").alias("more"))
        if jumps.select("to").join(nxt.select("to"), "to", "left_semi").isEmpty():
            break
        jumps = written(jumps.join(nxt, "to", "left").select("call_id", F.coalesce("far", "to").alias("to"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")))
    jumps = jumps.join(single.withColumnRenamed("call_id", "to"), "to", "left_anti")  # what still jumps to a jump runs in a circle
    settled = calls.select("call_id").join(edges.select(F.col("child").alias("call_id")).distinct(), "call_id", "left_anti").withColumn("topo_level", F.lit(0))
    several = edges.join(count.where("n > 1").select("child"), "child", "left_semi")
    own = several.join(jumps.withColumnRenamed("call_id", "parent"), "parent", "left")
    circular = single.join(jumps.select("call_id"), "call_id", "left_anti").withColumnRenamed("call_id", "parent")
    waiting = written(own.join(circular.withColumn("lost", F.lit(True)), "parent", "left").select("child", F.when(F.col("lost"), None).otherwise(F.coalesce("to", "parent")).alias("parent"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"), F.lit(None).cast("int").alias("value")))
    front = written(settled)
    settled = front
    while not waiting.isEmpty():
        known = waiting.join(front.withColumnRenamed("call_id", "parent"), "parent", "left").select("child", "parent", "dist", F.coalesce("value", F.col("topo_level") + F.col("dist")).alias("value"))
        known = written(known)
        front = written(known.groupBy("child").agg(F.max("value").alias("topo_level"), F.count_if(F.col("value").isNull()).alias("open")).where("open = 0").select(F.col("child").alias("call_id"), "topo_level"))
        if front.isEmpty():
            break
        settled = settled.unionByName(front)
        waiting = written(known.join(front.select(F.col("call_id").alias("child")), "child", "left_anti"))
    by_jump = jumps.join(settled.withColumnRenamed("call_id", "to"), "to").select("call_id", (F.col("topo_level") + F.col("dist")).alias("topo_level"))
    return settled.unionByName(by_jump)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """calls: conv_id, turn, call_id, name, arguments (JSON), depends_on (array of call_id); results: conv_id, turn, call_id, content."""
    key = F.struct("conv_id", "call_id").alias("key")
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(known).groupBy(key).agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    one = written(one.select("key", "c.*", "n_calls"))
    answers = results.where(known).groupBy(key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    wanted = one.select(F.col("key").alias("child"), F.explode("depends_on").alias("on")).where(F.col("on").isNotNull()).select("child", F.struct("child.conv_id", F.col("on").alias("call_id")).alias("parent"))
    edges = wanted.join(one.select(F.col("key").alias("parent")), "parent", "left_semi")
    order = levels(one.select(F.col("key").alias("call_id")), edges)
    linked = one.join(order.withColumnRenamed("call_id", "key"), "key", "left").join(answers, "key", "full_outer")
    alone = calls.where(~known).select(key, "turn", "name", "arguments", "depends_on", F.lit(1).cast("long").alias("n_calls"))
    answers_alone = results.where(~known).select(key, F.struct("turn", "content").alias("r"), F.lit(1).cast("long").alias("n_results"))
    linked = linked.unionByName(alone, allowMissingColumns=True).unionByName(answers_alone, allowMissingColumns=True)
    is_call = F.col("n_calls").isNotNull()
    errors = argument_errors(F.col("arguments"), F.col("name"), schemas)
    args = F.to_json(F.try_parse_json("arguments"))
    text = lambda c: F.coalesce(F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"), F.lit("null"))
    body = F.concat(F.lit('{"arguments":'), F.coalesce(args, F.lit("null")), F.lit(',"id":'), text("key.call_id"), F.lit(',"name":'), text("name"), F.lit(',"result":'), F.when(F.col("n_results").isNull(), F.lit("null")).otherwise(text("r.content")), F.lit("}"))
    return linked.select(
        F.col("key.conv_id").alias("conv_id"),
        F.coalesce("turn", "r.turn").alias("turn"),
        F.col("key.call_id").alias("call_id"),
        "name",
        F.col("topo_level").cast("int").alias("topo_level"),
        F.when(~is_call, "orphan_result").when(F.col("n_results").isNull(), "no_result").otherwise("linked").alias("status"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(is_call, F.array_join(errors, "; ")).alias("errors"),
        F.when(is_call, F.size(errors) == 0).alias("arguments_valid"),
        body.alias("message_json"),
    )


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a conversation implies: a system or user turn asks, an assistant turn answers the turn before it.

    A system turn calls `configure`, a short user turn `lookup`, a longer one `discuss`; a call depends on the calls one and two turns before, where there are any.
    """
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ident = lambda back: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), F.col("turn") - back)
    calls = t.where(F.col("role").isin("system", "user")).select(
        "conv_id",
        "turn",
        ident(0).alias("call_id"),
        F.when(F.col("role") == "system", "configure").when(F.length("text") < 200, "lookup").otherwise("discuss").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text").alias("query"))).alias("arguments"),
        F.array(ident(1), ident(2)).alias("depends_on"),
    )
    return calls, t.where(F.col("role") == "assistant").select("conv_id", "turn", ident(1).alias("call_id"), F.col("text").alias("content"))


#: Schemas of the three calls above.
SCHEMAS = {
    "configure": {"query": {"type": "string", "required": True, "max_length": 300}, "turn": {"type": "integer", "required": True, "maximum": 0}},
    "lookup": {"query": {"type": "string", "required": True}, "turn": {"type": "integer", "required": True, "minimum": 0}},
    "discuss": {"query": {"type": "string", "required": True, "max_length": 1000}, "turn": {"type": "integer", "required": True, "minimum": 0, "maximum": 5}},
}

#: The same for DuckDB, for tables without repeated (conv_id, turn).
SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, 'call_' || conv_id || '_' || turn AS call_id,
         CASE WHEN role = 'system' THEN 'configure' WHEN length(text) < 200 THEN 'lookup' ELSE 'discuss' END AS name
  FROM conversations WHERE role IN ('system', 'user')),
r AS (SELECT conv_id, turn, text, 'call_' || conv_id || '_' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
lev AS (
  SELECT conv_id, turn, 0 AS l FROM c WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn IN (c.turn - 1, c.turn - 2))
  UNION ALL
  SELECT c.conv_id, c.turn, l + 1 FROM lev JOIN c ON c.conv_id = lev.conv_id AND lev.turn IN (c.turn - 1, c.turn - 2)),
top AS (SELECT conv_id, turn, max(l) AS topo_level FROM lev GROUP BY ALL),
e AS (
  SELECT call_id, concat_ws('; ',
    CASE WHEN text IS NULL THEN 'query: missing' END,
    CASE WHEN name = 'configure' AND length(text) > 300 OR name = 'discuss' AND length(text) > 1000 THEN 'query: too long' END,
    CASE WHEN name = 'configure' AND turn > 0 OR name = 'discuss' AND turn > 5 THEN 'turn: too large' END,
    CASE WHEN name <> 'configure' AND turn < 0 THEN 'turn: too small' END) AS errors FROM c)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id, c.name,
  CAST(topo_level AS INTEGER) AS topo_level,
  CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
  CAST(CASE WHEN c.call_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_calls, CAST(CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
  errors, errors = '' AS arguments_valid,
  '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '{"query":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '}' END
    || ',"id":' || CAST(to_json(coalesce(c.call_id, r.call_id)) AS VARCHAR) || ',"name":' || coalesce(CAST(to_json(c.name) AS VARCHAR), 'null')
    || ',"result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS message_json
FROM c FULL JOIN r ON c.call_id = r.call_id LEFT JOIN top ON top.conv_id = c.conv_id AND top.turn = c.turn LEFT JOIN e ON e.call_id = c.call_id
"""
