"""Chat formatting with linked tool calls, in DataFrame operations only.

``link`` hash-joins tool calls with their results by identifier within a conversation; ``levels`` orders
calls topologically by the calls they depend on; ``validate`` checks arguments against schemas;
``canonical`` writes JSON with sorted keys and no spaces.  Messages stay one row each, so a conversation
of any length never has to fit one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

#: JSON schema types and the types that a parsed value of them may have.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical(text: Column) -> Column:
    """A JSON text with keys sorted at every depth and without spaces; null if it does not parse."""
    return F.to_json(F.try_parse_json(text))


def explicit_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, name, arguments, depends_on) of messages whose text is a JSON object with ``tool_calls``."""
    shape = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant,depends_on:array<string>>>>"
    return (
        messages.filter(F.col("text").rlike(r'^\s*\{') & F.col("text").contains('"tool_calls"'))
        .select("conv_id", "turn", F.explode(F.from_json("text", shape)["tool_calls"]).alias("c"))
        .select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.to_json("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    )


def explicit_results(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, content) of messages of role ``tool`` whose text is a JSON object with ``call_id``."""
    return (
        messages.filter(F.col("role") == "tool")
        .select("conv_id", "turn", F.from_json("text", "struct<call_id:string,content:variant>").alias("r"))
        .select("conv_id", "turn", F.col("r.call_id").alias("call_id"), F.to_json("r.content").alias("content"))
    )


def turn_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain conversations imply.

    A user turn calls ``reply``, which depends on the call two turns before; the assistant turn after it is the result.
    """
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    calls = messages.filter(F.col("role") == "user").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn"))).alias("arguments"), F.array_compact(F.array(name(F.col("turn") - 2))).alias("depends_on"),
    )
    results = messages.filter(F.col("role") == "assistant").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("content"))
    return calls, results


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with result_turn and content (null without a result).

    Of several results of one identifier the earliest counts; a repeated call identifier is linked each
    time; null identifiers link with nothing.
    """
    first = results.filter(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("r")).select("conv_id", "call_id", "r.result_turn", "r.content")
    return calls.hint("shuffle_hash").join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call has."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


def _jumped(single: DataFrame) -> DataFrame:
    """Follows calls with one dependency, (conv_id, call_id, to, w), to the first call that has none or several.

    Each round doubles the steps behind a pointer, so a chain of n calls takes about log2(n) rounds.  Pointers
    that still move after so many rounds go round a cycle.
    """
    now = core.keep(single, "chains")
    for _ in range(int(now.count()).bit_length() + 1):
        ahead = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("w").alias("more"))
        moved = now.join(ahead, ["conv_id", "to"], "left").select("conv_id", "call_id", F.coalesce("next", "to").alias("to"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), F.col("next").isNotNull().alias("moved"))
        last, moved = now, core.keep(moved, "chains")
        core.drop_kept(last)
        now = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return now


def levels(calls: DataFrame) -> DataFrame:
    """Calls with level: 0 without dependencies, else one more than the highest level it depends on.

    Dependencies that name no call of the conversation are ignored, and a call without an identifier or a
    conversation has none.  Calls on a cycle, or behind one, have level null.  Chains of calls with one
    dependency are followed by doubling; then a round of joins settles a level of the calls with several,
    until a round settles none.  Each round is written to the shared folder in place of the one before.
    """
    ids = calls.select("conv_id", "call_id").filter("conv_id is not null and call_id is not null").distinct()
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("on")).join(ids.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi")
    edges = core.keep(edges.filter("call_id is not null").select("conv_id", "call_id", "on").distinct(), "edges")
    if edges.isEmpty():
        return calls.withColumn("level", F.lit(0))
    degree = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("on").alias("to"))
    single = _jumped(degree.filter("n = 1").select("conv_id", "call_id", "to", F.lit(1).alias("w")))
    through = single.select("conv_id", F.col("call_id").alias("on"), "to", "w")
    several = edges.join(degree.filter("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi").join(through, ["conv_id", "on"], "left")
    several = several.groupBy("conv_id", "call_id", F.coalesce("to", "on").alias("on")).agg(F.max(F.coalesce("w", F.lit(0)) + 1).alias("w"))
    several = core.keep(several, "several")
    done = core.keep(ids.join(edges.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "levels")
    while True:
        settled = done.select("conv_id", F.col("call_id").alias("on"), F.col("level").alias("below"))
        open_ = several.join(done.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").join(settled, ["conv_id", "on"], "left")
        ready = open_.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("below").alias("m"), F.max(F.col("below") + F.col("w")).alias("level")).filter("n = m").select("conv_id", "call_id", "level")
        ready = core.keep(ready, "ready")
        if ready.isEmpty():
            break
        last, done = done, core.keep(done.union(ready), "levels")
        core.drop_kept(last)
        core.drop_kept(ready)
    ends = done.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("below"))
    every = done.union(single.join(ends, ["conv_id", "to"]).select("conv_id", "call_id", (F.col("below") + F.col("w")).alias("level")))
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    return calls.join(core.keep(every, "levels"), ["conv_id", "call_id"], "left").withColumn("level", F.when(known, F.col("level")).otherwise(0))


def json_schema(shape: dict) -> dict:
    """A JSON schema: ``shape`` itself, or made from fields with (type, required)."""
    if not all(isinstance(x, tuple) for x in shape.values()):
        return shape
    return {"type": "object", "properties": {k: {"type": t} for k, (t, _) in shape.items()}, "required": [k for k, (_, r) in shape.items() if r], "additionalProperties": False}


def fits(value: Column, schema: dict) -> Column:
    """Whether a variant fits a JSON schema: type, enum, minimum, maximum, minLength, maxLength, pattern, properties,
    required, additionalProperties (true or false) and items, at any depth.  False for no value."""
    kind = F.schema_of_variant(value)
    ok = value.isNotNull()
    if "type" in schema:
        ok &= kind.rlike(f"^(?:{TYPES[schema['type']]})$")
    if "enum" in schema:
        ok &= F.to_json(value).isin([json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]])
    number, text = F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
    for name, good in {"minimum": lambda m: number >= m, "maximum": lambda m: number <= m, "minLength": lambda m: F.char_length(text) >= m, "maxLength": lambda m: F.char_length(text) <= m, "pattern": text.rlike}.items():
        if name in schema:
            ok &= F.coalesce(good(schema[name]), F.lit(False))
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    own = schema.get("properties", {})
    if schema.get("type") == "object" or own:
        there = F.coalesce(F.map_keys(fields), F.array().cast("array<string>"))
        for name in schema.get("required", []):
            ok &= F.array_contains(there, name)
        if schema.get("additionalProperties") is False:
            ok &= F.size(F.array_except(there, F.array(*(F.lit(x) for x in own)).cast("array<string>"))) == 0
        for name, part in own.items():
            ok &= ~F.array_contains(there, name) | fits(F.try_element_at(fields, F.lit(name)), part)
    if "items" in schema:
        ok &= F.coalesce(F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: fits(x, schema["items"])), F.lit(True))
    return F.coalesce(ok, F.lit(False))


def validate(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls with ``valid``: the arguments parse and fit the schema of the call's name (see :func:`fits`).

    ``schemas`` maps a name to a JSON schema, or to fields with (type, required) that allow no others.  Unknown
    names, null arguments and null names are not valid.
    """
    ok = F.lit(False)
    for name, shape in schemas.items():
        ok = F.when(F.col("name") == name, fits(F.try_parse_json("arguments"), json_schema(shape))).otherwise(ok)
    return calls.withColumn("valid", F.coalesce(ok, F.lit(False)))


def serialise(calls: DataFrame) -> DataFrame:
    """Calls with ``json``: one canonical line with the call, its result and its place in the order."""
    body = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"), F.col("conv_id").alias("conversation"), F.col("call_id").alias("id"), F.col("level").alias("level"), F.col("name").alias("name"),
            F.try_parse_json("content").alias("result"), F.col("result_turn").alias("result_turn"), F.col("turn").alias("turn"), F.col("valid").alias("valid"),
        )
    )
    return calls.withColumn("json", body)


#: The schema of the calls that plain conversations imply.
REPLY = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def format_calls(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """All calls of conversations (stated and implied), linked, ordered, validated and serialised.

    Messages with null conv_id or turn still appear; a null text makes an implied call without a prompt,
    which is not valid.  Repeated rows repeat calls.  No call at all gives an empty table.
    """
    implied, replies = turn_calls(messages)
    calls = explicit_calls(messages).unionByName(implied)
    results = explicit_results(messages).unionByName(replies)
    return serialise(validate(levels(link(calls, results)), {**REPLY, **(schemas or {})}))
