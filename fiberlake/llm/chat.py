"""Chat formatting with tool-call linking.

Messages may hold <tool_call>{"id", "name", "arguments"}</tool_call> and <tool_result>{"id", "content"}</tool_result>.
Calls and results are hash-joined by conversation and identifier; arguments are validated against the schema of the
tool; a call whose arguments mention {"$result": id} depends on that call.  Calls are ordered topologically: `depth` is
0 without dependencies, else one more than the deepest of them; a result has its call's depth; calls in a cycle, and
those that wait for one, have none.  Every message, call and result becomes one row of canonical JSON (sorted keys, no
spaces, UTF-8), and the rows come sorted by conversation, depth, turn and place, by ranges.  Nothing gathers a
conversation in one task.

Edge cases: null texts are empty, null roles "unknown"; null conv_ids and turns stay null and link to nothing (their
calls are open, with depth 0); JSON that doesn't parse (numbers without an end among it), lacks an identifier, nests
deeper than Python's parser goes, or whose identifier is no Unicode text, stays text of its message; half a surrogate
pair within a text is written as its escape; of calls with one identifier the first (by turn, place, then JSON) is
linked, later ones are "repeated"; rows repeated whole are equal, and share their status; results without a call are
"orphan"; texts are parsed whole, whatever their length; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import Tables

_PART = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}

#: Tools whose arguments can be checked, as JSON schemas (type, properties, required, additionalProperties, enum, items).
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


_HALF = re.compile("[\ud800-\udfff]")


def canonical(value: Any) -> str:
    """JSON with sorted keys and without spaces; halves of surrogate pairs are escaped.  Deep values are written by a stack."""
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except RecursionError:
        out: list[str] = []
        todo: list[Any] = [(value,)]  # a tuple holds a value to write, a string is written as it is
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif isinstance(x[0], dict):
                parts: list[Any] = ["{"]
                for i, k in enumerate(sorted(x[0])):
                    parts += ["," * (i > 0) + json.dumps(k, ensure_ascii=False) + ":", (x[0][k],)]
                todo += reversed([*parts, "}"])
            elif isinstance(x[0], list):
                parts = ["["]
                for i, v in enumerate(x[0]):
                    parts += ["," * (i > 0), (v,)]
                todo += reversed([*parts, "]"])
            else:
                out.append(json.dumps(x[0], ensure_ascii=False, allow_nan=False))
        text = "".join(out)
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def is_result(value: Any) -> bool:
    return isinstance(value, dict) and set(value) == {"$result"}


def valid(value: Any, schema: dict) -> bool:
    todo = [(value, schema)]
    while todo:
        value, schema = todo.pop()
        if is_result(value):  # known when it runs
            continue
        kind = schema.get("type")
        if kind == "integer" and (isinstance(value, bool) or not (isinstance(value, int) or isinstance(value, float) and value.is_integer())):
            return False
        if kind == "number" and (isinstance(value, bool) or not isinstance(value, (int, float))):
            return False
        if kind in _TYPES and not isinstance(value, _TYPES[kind]):
            return False
        if "enum" in schema and value not in schema["enum"]:
            return False
        if isinstance(value, dict):
            known = schema.get("properties", {})
            if any(k not in value for k in schema.get("required", ())):
                return False
            if schema.get("additionalProperties") is False and any(k not in known for k in value):
                return False
            todo += [(v, known[k]) for k, v in value.items() if k in known]
        elif isinstance(value, list) and "items" in schema:
            todo += [(v, schema["items"]) for v in value]
    return True


def mentions(value: Any) -> list[str]:
    found, todo = set(), [value]
    while todo:
        value = todo.pop()
        if is_result(value) and isinstance(value["$result"], str):
            if not _HALF.search(value["$result"]):
                found.add(value["$result"])
        elif isinstance(value, dict):
            todo += value.values()
        elif isinstance(value, list):
            todo += value
    return sorted(found)


def _no_number(name: str) -> float:
    raise ValueError(name)


def event(kind: str, raw: str, schemas: dict[str, dict]) -> tuple | None:
    """(kind, call_id, json, valid, needs) of a call or result, or None if it is none."""
    try:
        body = json.loads(raw, parse_constant=_no_number)
        if not isinstance(body, dict) or not isinstance(body.get("id"), str) or _HALF.search(body["id"]):
            return None
        if kind == "result":
            return kind, body["id"], canonical({"content": body.get("content"), "id": body["id"], "type": "tool_result"}), None, []
        if not isinstance(body.get("name"), str):
            return None
        args = body.get("arguments", {})
        ok = valid(args, schemas[body["name"]]) if body["name"] in schemas else None
        return kind, body["id"], canonical({"arguments": args, "id": body["id"], "name": body["name"], "type": "tool_call"}), ok, mentions(args)
    except (ValueError, RecursionError):
        return None


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(place, kind, call_id, json, valid, needs) of a message and of what it holds."""
    events, rest, at = [], [], 0
    for m in _PART.finditer(text or ""):
        found = event(m[1], m[2], schemas)
        if found:
            events.append(found)
            rest.append((text or "")[at : m.start()])
            at = m.end()
    rest.append((text or "")[at:])
    message = ("message", None, canonical({"content": "".join(rest), "role": role or "unknown"}), None, [])
    return [(i, *e) for i, e in enumerate([message, *events])]


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): longest way back over needs.  Each round settles the calls whose needs are settled."""
    tables = Tables(calls.sparkSession)
    needs = calls.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    needs = tables.put("needs", needs.join(known, ["conv_id", "need"], "left_semi"))  # a call that isn't there is waited for by nobody
    done = tables.put("done", calls.join(needs, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("depth")))
    while not needs.isEmpty():
        settled = needs.join(done.select("conv_id", F.col("call_id").alias("need"), "depth"), ["conv_id", "need"], "left")
        ready = settled.groupBy("conv_id", "call_id").agg(F.count(F.when(F.col("depth").isNull(), 1)).alias("missing"), (F.max("depth") + 1).alias("depth"))
        ready = tables.put("ready", ready.where("missing = 0").select("conv_id", "call_id", "depth"))
        if ready.isEmpty():
            break  # what is left depends on itself
        done = tables.put("done", done.unionByName(ready))
        needs = tables.put("needs", needs.join(ready, ["conv_id", "call_id"], "left_anti"))
    return done


def format_chat(conversations: DataFrame, schemas: dict[str, dict] = SCHEMAS) -> DataFrame:
    """conv_id, depth, turn, place, kind, call_id, status, valid, json, in the order of the first four (no depth last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())]
        names = ["conv_id", "turn", "place", "kind", "call_id", "json", "valid", "needs"]
        for batch in batches:
            rows = [(c, t, *e) for c, t, r, x in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text"))) for e in parse(r, x, schemas)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    events = rows.mapInArrow(run, "conv_id long, turn long, place int, kind string, call_id string, json string, valid boolean, needs array<string>")
    tools = events.where("kind <> 'message'").persist(StorageLevel.DISK_ONLY)
    order = F.struct("turn", "place", "json")
    calls = tools.where("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min(order).alias("first"), F.min_by("needs", order).alias("needs"))
    results = tools.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.min(order).alias("answer"))
    calls = calls.where("conv_id is not null")
    calls = calls.join(depths(calls), ["conv_id", "call_id"], "left")
    links = calls.join(results, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "first", "answer", "depth")
    linked = tools.join(links, ["conv_id", "call_id"], "left").withColumn("depth", F.when(F.col("conv_id").isNull() & (F.col("kind") == "call"), 0).otherwise(F.col("depth")))
    status = F.when(F.col("kind") == "call", F.when(F.col("first").isNull() | (F.col("first") == order), F.when(F.col("answer").isNull(), "open").otherwise("linked")).otherwise("repeated")).otherwise(F.when(F.col("first").isNull(), "orphan").when(F.col("answer") == order, "linked").otherwise("repeated"))
    linked = linked.select("conv_id", "depth", "turn", "place", "kind", "call_id", status.alias("status"), "valid", "json")
    plain = events.where("kind = 'message'").select("conv_id", F.lit(0).alias("depth"), "turn", "place", "kind", "call_id", F.lit("message").alias("status"), "valid", "json")
    return plain.unionByName(linked).orderBy("conv_id", F.asc_nulls_last("depth"), "turn", "place")
