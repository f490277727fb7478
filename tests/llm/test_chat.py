import json
from collections import defaultdict

import pytest
from inkstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {"sum": {"a": ("number", True), "b": ("number", True), "note": ("string", False)}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"content": content, "tool_call_id": i})


def brute(rows):
    """Rows by plain loops over conversations held in memory."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        for k, (kind, i, body, problems, refs) in enumerate(chat.parsed(turn, role, text, TOOLS)):
            convs[conv].append({"key": (-1 << 62 if turn is None else turn, k), "turn": turn, "item": k, "kind": kind, "id": i, "json": body, "problems": problems, "refs": refs})
    out = []
    for conv, items in convs.items():
        first = {}
        for n, x in sorted(enumerate(items), key=lambda e: (e[1]["key"], e[0])):
            first.setdefault((x["kind"], x["id"]), n)
        deps = defaultdict(set)
        for n, x in enumerate(items):
            x["status"] = None
            if x["kind"] == "message":
                continue
            if x["id"] is None:
                x["status"] = "orphan"
            else:
                c, r = first.get(("call", x["id"])), first.get(("result", x["id"]))
                own = c if x["kind"] == "call" else r
                x["status"] = "repeated" if own != n else "orphan" if c is None else "unanswered" if r is None else "linked"
                if x["kind"] == "result" and own == n and c is not None:
                    deps[n].add(c)
            for ref in x["refs"]:
                on = first.get(("result", ref), first.get(("call", ref)))
                if on is not None:
                    deps[n].add(on)
        due, depth = {}, {}
        while True:
            ready = [n for n in range(len(items)) if n not in due and all(d in due for d in deps[n])]
            if not ready:
                break
            new = {n: (max([items[n]["key"], *(due[d] for d in deps[n])]), 1 + max([depth[d] for d in deps[n]], default=-1)) for n in ready}
            due |= {n: v[0] for n, v in new.items()}
            depth |= {n: v[1] for n, v in new.items()}
        for n, x in enumerate(items):
            if n not in due:
                x["status"] = "cycle"
        ranked = sorted(range(len(items)), key=lambda n: (due.get(n, items[n]["key"]), depth.get(n, 0), items[n]["key"], items[n]["json"], n))
        out += [(conv, p + 1, items[n]["turn"], items[n]["item"], items[n]["kind"], items[n]["id"], items[n]["status"], items[n]["problems"], items[n]["json"]) for p, n in enumerate(ranked)]
    return out


ROWS = [
    (1, 0, "user", "hello"),
    (1, 1, "assistant", call(("x", "sum", {"b": 2, "a": 1}), ("y", "sum", {"a": {"$ref": "x"}, "b": True}))),
    (1, 2, "tool", result("y", {"z": 1, "a": "é "})),
    (1, 3, "tool", result("x", 3)),
    (1, 4, "tool", result("nobody", None)),
    (2, 5, "tool", result("late", 1)),
    (2, 9, "assistant", call(("late", "what", {}))),
    (2, 10, "assistant", call(("late", "sum", [1]), (None, "sum", {"a": "1", "c": 1}))),
    (2, 11, "assistant", "{broken"),
    (3, 1, "assistant", call(("p", "sum", {"a": {"$ref": "q"}, "b": 1}), ("q", "sum", {"a": {"$ref": "p"}, "b": 1}), ("r", "sum", {"a": {"$ref": "q"}, "b": 1}))),
    (3, 2, "assistant", call()),
    (None, None, None, None),
    (None, 1, "user", ""),
    (4, 1, "user", "same"),
    (4, 1, "user", "same"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS position", "'k' AS kind", "2 AS id").coalesce(1)
    got = [tuple(r) for r in chat.linked(docs, TOOLS).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(ROWS), key=key)
    assert chat.linked(docs.limit(0), TOOLS).count() == 0


def test_json_is_canonical(spark):
    for r in chat.linked(spark.createDataFrame(ROWS, SCHEMA), TOOLS).collect():
        assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]


@pytest.mark.parametrize(("arguments", "want"), [({"a": 1, "b": 2.5}, []), ({"a": 1}, ["missing b"]), ({"a": True, "b": 1}, ["a is no number"]), ({"a": 1, "b": 1, "x": 0}, ["unknown argument x"]), (None, ["arguments are no object"])])
def test_validation(arguments, want):
    assert chat.validate("sum", arguments, TOOLS) == want


def test_given_conversations(spark):
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = chat.linked(chat.as_messages(talk)).collect()
    rows = talk.collect()
    assert len(got) == len(rows) and not any(r["problems"] for r in got)
    roles = {(r["conv_id"], r["turn"]): r["role"] for r in rows}
    for r in got:
        role = roles[r["conv_id"], r["turn"]]
        if role == "user":
            assert r["status"] == ("linked" if roles.get((r["conv_id"], r["turn"] + 1)) == "assistant" else "unanswered")
        elif role == "assistant":
            assert r["status"] == ("linked" if roles.get((r["conv_id"], r["turn"] - 1)) == "user" else "orphan")
