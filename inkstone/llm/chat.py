"""Chat formatting: tool calls are linked to their results, ordered, validated and serialised.

A message is a call message if its text is a JSON object with an array `tool_calls` of {id, name, arguments}, a result if it is one
with a string `tool_call_id`, and plain otherwise. Calls and results are hash-joined by (conversation, identifier). Where an
argument is {"$ref": id}, its call depends on the result of the call with that id. Items are put in topological order, which
is the given order but for items that come before something that they depend on: those follow it. Arguments are validated against
schemas, and every item is written as canonical JSON: keys sorted, no white space, no escapes but the needed ones.

No conversation is gathered in one place: order comes from range-sorting all items, so one conversation may hold any share of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed, written
from .rows import ranked

#: name -> parameters: name -> (type, required). Types are those of JSON schema.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "ask": {"text": ("string", True), "turn": ("integer", True), "system": ("string", False)},
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
_ITEM = "conv_id {conv}, turn long, item int, kind string, call_id string, json string, problems array<string>, refs array<string>"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _refs(value: object) -> Iterator[str]:
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if set(x) == {"$ref"} and isinstance(x["$ref"], str):
                yield x["$ref"]
            else:
                todo += x.values()
        elif isinstance(x, list):
            todo += x


def validate(name: object, arguments: object, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> list[str]:
    """What is wrong with a call, sorted; nothing if it fits its schema. A reference fits any type."""
    if not isinstance(name, str) or name not in schemas:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    schema, out = schemas[name], []
    for k, v in arguments.items():
        if k not in schema:
            out.append(f"unknown argument {k}")
        elif not (isinstance(v, dict) and set(v) == {"$ref"}):
            kind = schema[k][0]
            if not isinstance(v, _TYPES[kind]) or (isinstance(v, bool) and kind in ("integer", "number")):
                out.append(f"{k} is no {kind}")
    out += [f"missing {k}" for k, (_, needed) in schema.items() if needed and k not in arguments]
    return sorted(out)


def parsed(turn: int | None, role: str | None, text: str | None, schemas: Mapping) -> list[tuple[str, str | None, str, list[str], list[str]]]:
    """(kind, call id, canonical JSON, problems, ids referred to) of a message's items."""
    value = None
    if text and text.lstrip()[:1] == "{":
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            value = None
    if isinstance(value, dict) and isinstance(value.get("tool_calls"), list):
        out = []
        for call in value["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            own, arguments = call.get("id"), call.get("arguments")
            if isinstance(arguments, str):  # as some formats have it
                try:
                    arguments = json.loads(arguments)
                except (ValueError, RecursionError):
                    pass
            own = own if isinstance(own, str) else None
            problems = validate(call.get("name"), arguments, schemas) + ([] if own else ["no id"])
            out.append(("call", own, canonical({"arguments": arguments, "id": own, "name": call.get("name"), "type": "call"}), problems, sorted(set(_refs(arguments)))))
        return out
    if isinstance(value, dict) and isinstance(value.get("tool_call_id"), str):
        return [("result", value["tool_call_id"], canonical({"content": value.get("content"), "id": value["tool_call_id"], "type": "result"}), [], [])]
    return [("message", None, canonical({"content": text, "role": role, "type": "message"}), [], [])]


def linked(messages: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """(conv_id, position, turn, item, kind, call_id, status, problems, json): a row for each item of messages (conv_id, turn, role, text).

    A message has one item, or as many as it has calls (none for an empty array), numbered by item from 0. position is the item's place in
    its conversation, from 1 on. status is "linked" for a call and a result that belong together, "unanswered" for a call
    without result, "orphan" for a result without call or a call without id, "repeated" for a call or result whose id an earlier call or
    result of the conversation has, "cycle" for items whose references run in a circle or hang on one, and null for plain messages.
    problems are a call's violations of its schema.

    Items that depend on nothing keep the order of (turn, item); ties go by the JSON text. Rows with a null conv_id are one
    conversation; a null turn comes first; null texts are plain messages; broken JSON is a plain message. Repeated rows are kept and
    count as repeated calls or results. An empty table gives no rows; further columns are ignored. Rounds of joins are as many as the
    longest chain of references.
    """
    rows = messages.select(*fixed("conv_id", "turn", "role", "text")).toDF("conv_id", "turn", "role", "text").withColumn("turn", F.col("turn").cast("long"))
    conv = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "item", "kind", "call_id", "json", "problems", "refs"]
        for batch in batches:
            at, items, found = [], [], []
            for i, (turn, role, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                own = parsed(turn, role, text, schemas)
                at += [i] * len(own)
                items += range(len(own))
                found += own
            kind, call, text, problems, refs = zip(*found, strict=True) if found else ((),) * 5
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array(items, pa.int32()), pa.array(kind, pa.string()), pa.array(call, pa.string()), pa.array(text, pa.string()), pa.array(problems, lists), pa.array(refs, lists)], names)

    items = rows.mapInArrow(run, _ITEM.format(conv=conv))
    place = F.struct(F.coalesce("turn", F.lit(-1 << 62)).alias("turn"), "item", F.col("id").alias("id"))
    items = written(items.withColumn("id", F.monotonically_increasing_id())).withColumns({"conv": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")), "place": place})
    named = items.where("call_id IS NOT NULL").groupBy("conv", "call_id", "kind").agg(F.min("place").alias("first"))
    calls = named.where("kind = 'call'").select("conv", "call_id", F.col("first").alias("call"))
    results = named.where("kind = 'result'").select("conv", "call_id", F.col("first").alias("result"))
    links = written(calls.join(results, ["conv", "call_id"], "full").select("conv", "call_id", "call", "result"))
    both = items.where("call_id IS NOT NULL").join(links, ["conv", "call_id"], "left")
    status = F.when(F.col("place") != F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("result")), "repeated").when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered").otherwise("linked")
    known = both.select("id", status.alias("status"))

    # what waits for what, by number of the item; first occurrences only
    waits = links.where("call IS NOT NULL AND result IS NOT NULL").select(F.col("result.id").alias("id"), F.col("call.id").alias("on"))
    refs = items.where("size(refs) > 0").select("id", "conv", F.explode("refs").alias("call_id")).join(links, ["conv", "call_id"])
    refs = refs.select("id", F.coalesce("result.id", "call.id").alias("on")).where("on IS NOT NULL")
    edges = written(waits.unionByName(refs).distinct())
    due = _settled(items, edges)
    order = items.join(known, "id", "left").join(due, "id", "left").withColumns({"due": F.coalesce("due", F.struct("place.turn", "place.item")), "depth": F.coalesce("depth", F.lit(0))})
    order = order.withColumn("status", F.when(F.col("kind") == "message", F.lit(None)).when(F.coalesce("cycle", F.lit(False)), "cycle").otherwise(F.coalesce("status", F.lit("orphan"))))
    slots = order.select("conv", "conv_id", "turn", "item", "kind", "call_id", "status", "problems", "json", F.col("due.turn").alias("due_turn"), F.col("due.item").alias("due_item"), "depth", F.col("place.turn").alias("own_turn"), "id")
    placed = written(ranked(slots, ["conv", "due_turn", "due_item", "depth", "own_turn", "item", "json", "id"], "rank"))
    before = placed.groupBy("conv").agg((F.min("rank") - 1).alias("before"))
    return placed.join(before, "conv").select("conv_id", (F.col("rank") - F.col("before")).alias("position"), "turn", "item", "kind", "call_id", "status", "problems", "json")


def _settled(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, due, depth, cycle) of the items that are in edges (id waits on `on`): due is the latest place among the item and all it waits on."""
    nodes = edges.select("id").unionByName(edges.select(F.col("on").alias("id"))).distinct().join(items.select("id", F.struct("place.turn", "place.item").alias("own")), "id")
    nodes = written(nodes)
    done = written(nodes.join(edges, "id", "left_anti").select("id", F.col("own").alias("due"), F.lit(0).alias("depth")))
    every, left = done, edges
    while True:
        met = left.join(every.select(F.col("id").alias("on"), F.col("due").alias("x"), F.col("depth").alias("d")), "on", "left")
        state = met.groupBy("id").agg(F.count_if(F.col("d").isNull()).alias("open"), F.max("x").alias("x"), F.max("d").alias("d")).where("open = 0")
        now = written(state.join(nodes, "id").select("id", F.greatest("own", "x").alias("due"), (F.col("d") + 1).alias("depth")))
        if now.isEmpty():
            break
        every = written(every.unionByName(now))
        left = written(left.join(now.select("id"), "id", "left_anti"))
    stuck = left.select("id").distinct().join(nodes, "id").select("id", F.col("own").alias("due"), F.lit(0).alias("depth"), F.lit(True).alias("cycle"))
    return every.withColumn("cycle", F.lit(False)).unionByName(stuck)


def as_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool use: every user turn calls the tool `ask`, whose result is the assistant's next turn.

    The call of turn t has the id "c<conv_id>-<t>"; an assistant's turn t is the result of c<conv_id>-<t - 1>. Other turns are plain.
    """
    own = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"))
    call = F.to_json(F.struct(F.array(F.struct(F.concat(own, F.col("turn").cast("string")).alias("id"), F.lit("ask").alias("name"), F.struct("text", "turn").alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.concat(own, (F.col("turn") - 1).cast("string")).alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), text.alias("text"))
