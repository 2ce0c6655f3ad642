"""Linking of tool calls to their results.

Contract. Calls ``(conv_id, call_id, turn, name, arguments, parent_id)`` and results ``(conv_id, call_id,
turn, content)`` are joined by conversation and call id. Each call gives one row with its place in
the topological order of its conversation, what is wrong with it, and one canonical JSON line.

Order: a call comes after its parent. level is the number of calls before it on the way from a call
without parent; a conversation read by (level, turn, call_id) is topologically sorted. A parent that
is no call of the conversation is an error and counts as none; calls on or behind a circle have no
level. Errors: "unknown tool", "bad json" and one for each way in which the arguments miss the schema
of their tool, "no result", "result before call", "unknown parent", "circle", sorted.

A call id that a conversation repeats counts once: the earliest turn, then the smallest name and
arguments; of several results the earliest, then the smallest content. Rows with null conversation
or call id link to nothing and are left out. Null names are unknown tools, null arguments bad json,
a null content an empty one. Results without a call are counted by ``orphans``. Empty tables give empty
results; further columns are ignored.

Canonical JSON has sorted keys, no white space and only the escapes JSON demands, so equal calls are
equal lines. Levels are found by pointer doubling: after round r each call knows its ancestor 2**r
calls before it, so a chain of a million calls takes twenty joins, and no conversation is gathered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import cut

KINDS = {
    "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list), "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool), "null": lambda x: x is None,
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
}


def canonical(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def misses(value: Any, schema: Mapping, where: str = "$") -> list[str]:
    """Ways in which a value misses a JSON schema: type, enum, bounds, lengths, properties, required, items."""
    kind = schema.get("type")
    if kind is not None and not any(KINDS[k](value) for k in ([kind] if isinstance(kind, str) else kind)):
        return [f"{where}: not {kind if isinstance(kind, str) else ' or '.join(kind)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{where}: not one of enum")
    if KINDS["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{where}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{where}: above maximum")
    elif isinstance(value, str | list):
        names = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if names[0] in schema and len(value) < schema[names[0]]:
            out.append(f"{where}: too short")
        if names[1] in schema and len(value) > schema[names[1]]:
            out.append(f"{where}: too long")
        if isinstance(value, list) and "items" in schema:
            for k, item in enumerate(value):
                out += misses(item, schema["items"], f"{where}[{k}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{where}.{x}: missing" for x in schema.get("required", ()) if x not in value]
        for name, item in value.items():
            if name in known:
                out += misses(item, known[name], f"{where}.{name}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{where}.{name}: not known")
    return out


def strict(text: str | None) -> Any:
    """The JSON value of a text; no repeated keys, no numbers that JSON lacks."""
    def pairs(items: list[tuple[str, Any]]) -> dict:
        if len(dict(items)) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def refuse(name: str) -> None:
        raise ValueError(name)

    return json.loads(text or "", object_pairs_hook=pairs, parse_constant=refuse)


def levels(calls: DataFrame) -> DataFrame:
    """``(c, i, level)`` of calls (conv_id, call_id, parent_id or null); no level on or behind circles."""
    at = cut(calls.select(
        F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("parent_id").alias("up"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("level"),
    ))
    total = at.count()
    reach = 1
    while reach <= total and not at.where("up is not null").isEmpty():
        step = at.select(F.col("c").alias("pc"), F.col("i").alias("pi"), F.col("up").alias("pup"), F.col("level").alias("plevel"))
        at = cut(
            at.join(step, (F.col("c") == F.col("pc")) & (F.col("up") == F.col("pi")), "left")
            .select("c", "i", F.col("pup").alias("up"), (F.col("level") + F.coalesce("plevel", F.lit(0))).alias("level"))
        )
        reach *= 2
    return at.select("c", "i", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def linked(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """``(conv_id, call_id, turn, level, name, valid, errors, line)``; see the module."""
    key = ["conv_id", "call_id"]
    calls = cut(
        calls.where("conv_id is not null and call_id is not null").groupBy(*key)
        .agg(F.min(F.struct("turn", "name", "arguments", "parent_id")).alias("one")).select(*key, "one.*")
    )
    answers = results.where("conv_id is not null and call_id is not null").groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call")).agg(
        F.min(F.struct(F.col("turn").alias("r_turn"), F.coalesce("content", F.lit("")).alias("content"))).alias("one")
    ).select("r_conv", "r_call", "one.r_turn", "one.content")
    # a child's parent has to be a call of the same conversation
    parents = calls.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"))
    known = cut(
        calls.join(parents, (F.col("conv_id") == F.col("p_conv")) & (F.col("parent_id") == F.col("p_call")), "left")
        .withColumn("lost", F.col("parent_id").isNotNull() & F.col("p_call").isNull())
        .select(*key, "turn", "name", "arguments", F.col("p_call").alias("parent_id"), "lost")
    )
    rows = (
        known.join(levels(known), (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")))
        .join(answers, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "left")
        .select(*key, "turn", "level", "name", "arguments", "parent_id", "lost", "r_turn", "content")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, lines = [], []
            for x in batch.to_pylist():
                wrong = []
                arguments = None
                if x["name"] not in schemas:
                    wrong.append("unknown tool")
                try:
                    arguments = strict(x["arguments"])
                    canonical(arguments)
                    if x["name"] in schemas:
                        wrong += misses(arguments, schemas[x["name"]])
                except (ValueError, RecursionError):
                    arguments = None
                    wrong.append("bad json")
                if x["r_turn"] is None and x["content"] is None:
                    wrong.append("no result")
                elif x["r_turn"] is not None and x["turn"] is not None and x["r_turn"] < x["turn"]:
                    wrong.append("result before call")
                if x["lost"]:
                    wrong.append("unknown parent")
                if x["level"] is None:
                    wrong.append("circle")
                errors.append(sorted(set(wrong)))
                lines.append(canonical({
                    "arguments": arguments, "id": x["call_id"], "name": x["name"], "parent": x["parent_id"], "result": x["content"],
                }))
            keep = [batch.column(n) for n in ("conv_id", "call_id", "turn", "level", "name")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array([not e for e in errors], pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(lines, pa.string())],
                names=["conv_id", "call_id", "turn", "level", "name", "valid", "errors", "line"],
            )

    kinds = {x: calls.schema[x].dataType.simpleString() for x in (*key, "turn", "name")}
    return rows.mapInArrow(
        run, f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, turn {kinds['turn']}, level bigint, name string, "
        "valid boolean, errors array<string>, line string",
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that belong to no call."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


#: Tools of the conversations table as read below.
SCHEMAS = {
    "answer": {
        "type": "object", "required": ["lines", "opening"], "additionalProperties": False,
        "properties": {"lines": {"type": "integer", "minimum": 1, "maximum": 3}, "opening": {"type": "string", "minLength": 1, "maxLength": 60}},
    },
    "instruct": {
        "type": "object", "required": ["opening"], "additionalProperties": False, "properties": {"opening": {"type": "string", "minLength": 1}},
    },
}


def read_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in a table of plain turns: what an assistant or system turn says is a call with
    its line count and first line as arguments (a system turn with the first line only), its parent the
    call two turns before; what stands in the next user turn is the result."""
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    opening = F.substring_index("text", "\n", 1)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    spoken = turns.where("role in ('assistant', 'system')")
    calls = spoken.select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn",
        F.when(F.col("role") == "system", "instruct").otherwise("answer").alias("name"),
        F.when(F.col("role") == "system", F.to_json(F.struct(opening.alias("opening"))))
        .otherwise(F.to_json(F.struct(opening.alias("opening"), lines.cast("long").alias("lines")))).alias("arguments"),
        F.when(F.col("turn") >= 3, name(F.col("turn") - 2)).alias("parent_id"),
    )
    results = turns.where("role = 'user' and turn > 0").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


#: The same for DuckDB.
LINKED_SQL = """
    with recursive turns as (
        select conv_id, turn, role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null
    ),
    calls as (
        select conv_id, 't' || turn as call_id, turn, case when role = 'system' then 'instruct' else 'answer' end as name,
               string_split(text, chr(10))[1] as opening, len(string_split(text, chr(10))) as n_lines,
               case when turn >= 3 then 't' || (turn - 2) end as parent_id
        from turns where role in ('assistant', 'system')
        qualify row_number() over (partition by conv_id, turn order by role, text) = 1
    ),
    results as (
        select conv_id, 't' || (turn - 1) as call_id, min(text) as content
        from turns where role = 'user' and turn > 0 group by all
    ),
    levels as (
        select c.conv_id, c.call_id, 0 as level from calls c
        where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.call_id = c.parent_id)
        union all
        select c.conv_id, c.call_id, level + 1 from levels l
        join calls c on c.conv_id = l.conv_id and c.parent_id = l.call_id
    ),
    checked as (
        select c.*, l.level, p.call_id as parent, r.content, r.call_id is not null as has_result,
               [e for e in [
                   case when c.name = 'answer' and c.n_lines > 3 then '$.lines: above maximum' end,
                   case when len(c.opening) = 0 then '$.opening: too short' end,
                   case when c.name = 'answer' and len(c.opening) > 60 then '$.opening: too long' end,
                   case when r.call_id is null then 'no result' end,
                   case when c.parent_id is not null and p.call_id is null then 'unknown parent' end
               ] if e is not null] as errors
        from calls c join levels l using (conv_id, call_id)
        left join calls p on p.conv_id = c.conv_id and p.call_id = c.parent_id
        left join results r on r.conv_id = c.conv_id and r.call_id = c.call_id
    )
    select conv_id, call_id, cast(turn as bigint) as turn, cast(level as bigint) as level, name, len(errors) = 0 as valid,
           array_to_string(errors, '; ') as errors,
           '{"arguments":{' || case when name = 'answer' then '"lines":' || n_lines || ',' else '' end
           || '"opening":' || to_json(opening) || '},"id":' || to_json(call_id) || ',"name":' || to_json(name)
           || ',"parent":' || coalesce(cast(to_json(parent) as varchar), 'null')
           || ',"result":' || coalesce(cast(to_json(content) as varchar), 'null') || '}' as line
    from checked"""
