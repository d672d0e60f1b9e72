"""Chat formatting: tool calls linked to their results.

Calls and results are hash-joined by identifier within their conversation; calls are put in topological order by the call that each
comes after; arguments are validated against the tools' schemas; each linked call is serialised as canonical JSON (keys in order,
no white space). All of it is DataFrame functions: arguments are parsed as variants, whose objects hold their keys in order.

A call's depth is the number of calls before it, found by pointer doubling: each round, every call's pointer jumps to its
target's target, so the rounds grow with the logarithm of the longest chain. Nothing is collected per conversation, so one
conversation may hold any share of all rows.

Defined results, in ``status``, the first that applies: ``no_id`` (null identifier), ``duplicate_id`` (several calls of the
conversation have it), ``cycle`` (depth null), ``missing_dependency`` (comes after an unknown call; depth 0), ``unknown_tool``,
``invalid_json`` (not an object, or keys that repeat), ``invalid_arguments`` (named in ``errors``, in order of their names), ``no_result``,
``ok``. Of several results of a call the least content counts, their number is ``n_results``; results of no call are rows with
status ``orphan_result``. Rows of a null conversation are one conversation of their own. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared

#: The tools' parameters, for each tool either name -> (type, required) or a JSON schema of type object. Understood are type, properties,
#: required, additionalProperties (false if not given), items, enum, minimum and maximum, at any depth.
Tools = dict[str, dict]

_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID$"}


def canonical_json(text: Column) -> Column:
    """JSON text with its keys in order and without white space; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def schema_of(tool: dict) -> dict:
    """A tool's JSON schema."""
    if all(isinstance(v, tuple) for v in tool.values()):
        return {"type": "object", "properties": {k: {"type": t} for k, (t, _) in tool.items()}, "required": [k for k, (_, needed) in tool.items() if needed]}
    return tool


def _texts(*columns: Column) -> Column:
    return F.array(*columns).cast("array<string>")


def schema_errors(value: Column, path: Column, schema: dict) -> Column:
    """Where a variant breaks its schema: an array of texts, each beginning with a path."""
    kinds = schema.get("type", sorted(_TYPES))
    kinds = [kinds] if isinstance(kinds, str) else kinds
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    told = lambda what: F.concat(path, F.lit(f": {what}"))
    found = []
    if "enum" in schema:
        allowed = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in schema["enum"]]
        found.append(F.when(~F.coalesce(F.to_json(value).isin(allowed), F.lit(False)), _texts(told("not one of " + " ".join(allowed)))))
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in schema:
        found.append(F.when(number < schema["minimum"], _texts(told(f"under {schema['minimum']}"))))
    if "maximum" in schema:
        found.append(F.when(number > schema["maximum"], _texts(told(f"over {schema['maximum']}"))))
    if "properties" in schema:
        members = F.try_variant_get(value, "$", "map<string,variant>")
        inner = lambda k: F.when(path == "", k).otherwise(F.concat(path, F.lit("."), k))
        for name, sub in sorted(schema["properties"].items()):
            there = F.coalesce(F.map_contains_key(members, F.lit(name)), F.lit(False))
            found.append(F.when(there, schema_errors(F.try_element_at(members, F.lit(name)), inner(F.lit(name)), sub)).when(F.lit(name in schema.get("required", ())), _texts(F.concat(inner(F.lit(name)), F.lit(": missing")))))
        if not schema.get("additionalProperties", False):
            others = F.array_sort(F.array_except(F.map_keys(members), _texts(*map(F.lit, sorted(schema["properties"])))))
            found.append(F.transform(others, lambda k: F.concat(inner(k), F.lit(": unknown"))))
    if "items" in schema:
        elements = F.try_variant_get(value, "$", "array<variant>")
        place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        found.append(F.flatten(F.transform(elements, lambda e, i: schema_errors(e, place(i), schema["items"]))))
    deeper = F.concat(*[F.coalesce(x, _texts()) for x in found]) if found else _texts()
    return F.when(~kind.rlike("|".join(_TYPES[k] for k in kinds)), _texts(told("not " + " or ".join(kinds)))).otherwise(deeper)


def argument_errors(name: Column, arguments: Column, tools: Tools) -> Column:
    """What is wrong with a call's arguments, an array of texts: empty if nothing, null for a tool or JSON that can't be read."""
    parsed = F.try_parse_json(arguments)
    out = F.lit(None).cast("array<string>")
    for tool, params in sorted(tools.items()):
        out = F.when(name == tool, schema_errors(parsed, F.lit(""), schema_of(params))).otherwise(out)
    return F.when(F.schema_of_variant(parsed).rlike(_TYPES["object"]), out)


def _key(name: str = "call_id") -> Column:
    """An identifier within its conversation, which may be null; null where the identifier is."""
    return F.when(F.col(name).isNotNull(), F.struct(F.col("conv_id").alias("conv_id"), F.col(name).alias("call_id")))


def depths(calls: DataFrame, shared: Shared) -> DataFrame:
    """key, same (calls that have it), depth (null in a cycle), lost (comes after an unknown call) of each key of calls (key, after)."""
    ids = shared.table(calls.filter("key is not null").groupBy("key").agg(F.min("after").alias("after"), F.count(F.lit(1)).alias("same")))
    known = ids.select(F.col("key").alias("after"), F.lit(True).alias("known"))
    at = ids.join(known, "after", "left").select("key", "same", F.when(F.col("known"), F.col("after")).alias("up"), (F.col("after").isNotNull() & F.col("known").isNull()).alias("lost"))
    at = shared.table(at.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint")))
    shared.drop(ids)
    open_ = at.filter("up is not null").count()
    while open_:
        next_ = at.select(F.col("key").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        after = at.join(next_, "up", "left").select("key", "same", F.col("further").alias("up"), "lost", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        after = shared.table(after)
        shared.drop(at)
        at, before = after, open_
        open_ = at.filter("up is not null").count()
        if open_ == before:  # a chain would have lost a call to its root: the rest are circles
            break
    return at.select("key", "same", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), "lost")


def link_calls(calls: DataFrame, results: DataFrame, tools: Tools) -> DataFrame:
    """Rows conv_id, call_id, depth, status, errors, n_results, json of each call (conv_id, call_id, name, arguments, after), and of
    each orphan of the results (conv_id, call_id, content)."""
    shared = Shared(calls.sparkSession, "chat")
    calls = shared.table(calls.select(_key().alias("key"), "conv_id", "call_id", "name", "arguments", F.col("after").alias("_after"), _key("after").alias("after")))
    results = results.select(_key().alias("key"), "conv_id", "call_id", "content")
    said = results.filter("key is not null").groupBy("key").agg(F.min("content").alias("result"), F.count(F.lit(1)).alias("n_results"))
    info = depths(calls.select("key", "after"), shared)
    out = calls.drop("after").withColumnRenamed("_after", "after").join(said.hint("shuffle_hash"), "key", "left").join(info, "key", "left")
    known = F.coalesce(F.col("name").isin(sorted(tools)), F.lit(False))
    out = out.withColumn("errors", argument_errors(F.col("name"), F.col("arguments"), tools))
    status = (
        F.when(F.col("call_id").isNull(), "no_id")
        .when(F.col("same") > 1, "duplicate_id")
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("lost"), "missing_dependency")
        .when(~known, "unknown_tool")
        .when(F.col("errors").isNull(), "invalid_json")
        .when(F.size("errors") > 0, "invalid_arguments")
        .when(F.col("n_results").isNull(), "no_result")
        .otherwise("ok")
    )
    # fields in the order of their names
    said_json = F.struct(F.col("after"), F.try_parse_json("arguments").alias("arguments"), F.col("conv_id"), F.col("depth"), F.col("call_id").alias("id"), F.col("name"), F.col("result"))
    out = out.select("conv_id", "call_id", "depth", status.alias("status"), F.array_join("errors", "; ").alias("errors"), F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"), F.to_json(said_json).alias("json"))
    orphans = results.join(info.select("key"), "key", "left_anti")
    orphan_json = F.to_json(F.struct(F.col("conv_id"), F.col("call_id").alias("id"), F.col("content").alias("result")))
    orphans = orphans.select("conv_id", "call_id", F.lit(None).cast("bigint").alias("depth"), F.lit("orphan_result").alias("status"), F.lit(None).cast("string").alias("errors"), F.lit(1).cast("bigint").alias("n_results"), orphan_json.alias("json"))
    return out.unionByName(orphans)


#: How turns of a conversation read as calls: what a user or a system turn asks for, by role.
_TURN = {
    "type": "object",
    "properties": {
        "shape": {"type": "object", "properties": {"chars": {"type": "integer", "minimum": 1, "maximum": 1000}, "end": {"type": "string", "enum": [".", "!", "?"]}}, "required": ["chars", "end"]},
        "text": {"type": "string"},
        "turn": {"type": "integer", "minimum": 0},
    },
    "required": ["shape", "text", "turn"],
}
TURN_TOOLS: Tools = {"user": _TURN, "system": _TURN}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: every turn but the assistant's is a call named by its role, with its text, turn and
    the text's shape as arguments; an assistant's turn is the result of the call one turn earlier; a call comes after the call one turn
    earlier, or else two. Identifiers tell the turn, so that conversations share them."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    ident = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    results = turns.filter(assistant).select("conv_id", ident(1).alias("call_id"), F.col("text").alias("content"))
    calls = turns.filter(~assistant).withColumn("call_id", ident(0))
    calls = calls.withColumn("one", F.struct("conv_id", ident(1).alias("call_id"))).withColumn("two", F.struct("conv_id", ident(2).alias("call_id")))
    ids = calls.filter("call_id is not null").select(F.struct("conv_id", "call_id").alias("id")).distinct()
    calls = calls.join(ids.select(F.col("id").alias("one"), F.col("id.call_id").alias("after1")), "one", "left")
    calls = calls.join(ids.select(F.col("id").alias("two"), F.col("id.call_id").alias("after2")), "two", "left")
    shape = F.struct(F.length("text").alias("chars"), F.right(F.rtrim("text"), F.lit(1)).alias("end"))
    arguments = F.to_json(F.struct(shape.alias("shape"), "text", "turn"))
    return calls.select("conv_id", "call_id", F.col("role").alias("name"), arguments.alias("arguments"), F.coalesce("after1", "after2").alias("after")), results


def format_conversations(conversations: DataFrame) -> DataFrame:
    return link_calls(*turns_as_calls(conversations), TURN_TOOLS)


ORACLE_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text, 't' || turn AS call_id, length(text) AS chars, right(rtrim(text, ' '), 1) AS e FROM conversations WHERE coalesce(role <> 'assistant', true)
), r AS (
  SELECT conv_id, 't' || (turn - 1) AS call_id, min(text) AS result, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL
), n AS (SELECT conv_id, call_id, count(*) AS same FROM c GROUP BY ALL
), linked AS (
  SELECT c.*, n.same, coalesce(a.call_id, b.call_id) AS after,
    list_filter([CASE WHEN chars < 1 THEN 'shape.chars: under 1' WHEN chars > 1000 THEN 'shape.chars: over 1000' END,
      CASE WHEN e NOT IN ('.', '!', '?') THEN 'shape.end: not one of "." "!" "?"' END, CASE WHEN turn < 0 THEN 'turn: under 0' END], lambda x: x IS NOT NULL) AS errors
  FROM c JOIN n ON n.conv_id = c.conv_id AND n.call_id = c.call_id
  LEFT JOIN n a ON a.conv_id = c.conv_id AND a.call_id = 't' || (c.turn - 1)
  LEFT JOIN n b ON b.conv_id = c.conv_id AND b.call_id = 't' || (c.turn - 2)
), d AS (
  SELECT DISTINCT conv_id, call_id, 0 AS depth FROM linked WHERE after IS NULL
  UNION ALL
  SELECT l.conv_id, l.call_id, d.depth + 1 FROM (SELECT DISTINCT conv_id, call_id, after FROM linked) l JOIN d ON l.conv_id = d.conv_id AND l.after = d.call_id
)
SELECT l.conv_id, l.call_id, d.depth::BIGINT AS depth,
  CASE WHEN same > 1 THEN 'duplicate_id' WHEN role IS NULL OR role NOT IN ('user', 'system') THEN 'unknown_tool' WHEN len(errors) > 0 THEN 'invalid_arguments' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'ok' END AS status,
  array_to_string(errors, '; ') AS errors, coalesce(r.n_results, 0)::BIGINT AS n_results,
  '{' || CASE WHEN l.after IS NOT NULL THEN '"after":"' || l.after || '",' ELSE '' END
  || '"arguments":{"shape":{"chars":' || chars || ',"end":' || to_json(e) || '},"text":' || to_json(l.text) || ',"turn":' || l.turn || '},"conv_id":' || l.conv_id || ',"depth":' || d.depth
  || ',"id":"' || l.call_id || '","name":"' || l.role || '"' || CASE WHEN r.result IS NOT NULL THEN ',"result":' || to_json(r.result) ELSE '' END || '}' AS json
FROM linked l JOIN d USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)
UNION ALL
SELECT x.conv_id, 't' || (x.turn - 1), NULL, 'orphan_result', NULL, 1, '{"conv_id":' || x.conv_id || ',"id":"t' || (x.turn - 1) || '","result":' || to_json(x.text) || '}'
FROM conversations x WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = x.conv_id AND n.call_id = 't' || (x.turn - 1))
"""
