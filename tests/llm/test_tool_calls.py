import json

import pytest

from turnscore.llm.tool_calls import TOOLS, link_tool_calls

CALLS = "conv_id long, call_id string, parent_id string, name string, arguments string, content string"
RESULTS = "conv_id long, call_id string, content string, name int"
ADD = [("add", [("a", "integer", True), ("b", "number", False), ("tags", "array", False)])]


def run(spark, calls, results, tools=ADD):
    df = link_tool_calls(spark.createDataFrame([(*c, "clash") for c in calls], CALLS),
                         spark.createDataFrame([(*r, 1) for r in results], RESULTS), spark.createDataFrame(tools, TOOLS))
    return {(r.conv_id, r.call_id): r for r in df.collect()}


def test_links_validates_and_serialises(spark):
    got = run(spark, [(1, "x", None, "add", '{ "b": 2.50, "a": 1 , "tags":["é\\n", null]}'), (1, "y", "x", "add", '{"a": "1"}'),
                      (1, "z", "y", "add", '{"b": 1e3, "c": {}}'), (2, "x", "q", "sub", "[1]"), (2, "w", None, "add", "{bad"),
                      (2, "n", None, None, None)],
              [(1, "x", "three"), (1, "y", ""), (3, "x", "lost"), (1, None, "nobody")])
    x = got[1, "x"]
    assert (x.status, x.errors, x.depth) == ("ok", "", 0)
    assert x.message == '{"arguments":{"a":1,"b":2.5,"tags":["é\\n",null]},"depth":0,"id":"x","name":"add","result":"three","type":"tool_call"}'
    assert (got[1, "y"].status, got[1, "y"].errors, got[1, "y"].depth) == ("invalid", "wrong type a", 1)
    assert (got[1, "z"].errors, got[1, "z"].depth) == ("missing a; unknown c", 2)
    assert got[2, "x"].errors == "arguments are not an object; unknown parent; unknown tool"
    assert got[2, "w"].errors == "arguments are not JSON" and json.loads(got[2, "w"].message)["raw_arguments"] == "{bad"
    assert got[2, "n"].errors == "arguments are not JSON; unknown tool"
    assert got[3, "x"].status == "orphan_result" and got[1, None].status == "orphan_result"
    assert len(got) == 8


def test_repeated_rows_nulls_and_cycles(spark):
    ok = '{"a": 1}'
    got = run(spark, [(None, "p", None, "add", ok), (None, "q", "p", "add", ok), (1, "a", "b", "add", ok), (1, "b", "a", "add", ok),
                      (1, "c", "b", "add", ok), (1, "d", None, "add", ok), (1, "d", None, "add", ok), (1, None, None, "add", ok),
                      (1, "self", "self", "add", ok)],
              [(None, "p", "1"), (None, "q", None), (1, "d", "r"), (1, "d", "r"), (1, "a", "x")])
    assert [(got[None, k].status, got[None, k].depth) for k in "pq"] == [("ok", 0), ("ok", 1)]
    assert all(got[1, k].errors == "cycle" and got[1, k].depth is None for k in ("a", "b", "c", "self"))
    assert got[1, "d"].errors == "repeated call; repeated result" and got[1, None].errors == "no identifier"
    assert len(got) == 8


@pytest.mark.parametrize("n", [1, 2, 37])
def test_depth_of_a_chain(spark, n):
    got = run(spark, [(5, str(i), str(i - 1) if i else None, "add", '{"a": 1}') for i in range(n)], [])
    assert [got[5, str(i)].depth for i in range(n)] == list(range(n))
    assert {r.status for r in got.values()} == {"no_result"}


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], [(1, "a", "b")])[1, "a"].status == "orphan_result"
    assert run(spark, [(1, "a", None, "add", "{}")], [], [])[1, "a"].errors == "unknown tool"


def test_every_distinct_row_stays(spark):
    calls = [(1, None, None, "add", '{"a": 1}'), (1, None, None, "add", '{"a": 2}'), (1, None, "d", "sub", "{}"), (None, None, None, None, None),
             (1, "d", None, "add", '{"a": 5}'), (1, "d", "e", "add", '{"a": 6}'), (1, "d", "d", "add", '{"a": 7}'), (1, "d", "d", "add", '{"a": 7}'),
             (1, "e", "d", "add", '{"a": 8}')]
    results = [(1, None, "r1"), (1, None, "r2"), (1, None, "r2"), (None, None, None), (1, "d", "r4"), (1, "d", "r3"), (1, "d", None),
               (1, "d", "r4"), (1, "z", "r5"), (1, "z", "r6")]
    df = link_tool_calls(spark.createDataFrame([(*c, "clash") for c in calls], CALLS),
                         spark.createDataFrame([(*r, 1) for r in results], RESULTS), spark.createDataFrame(ADD, TOOLS))
    got = []
    for r in df.collect():
        m = json.loads(r.message)
        got.append((r.conv_id, r.call_id, r.depth, r.status, r.errors, (m.get("arguments") or {}).get("a"), m.get("parent"), m.get("result")))
    none, call, result = "no identifier", "repeated call", "repeated result"
    want = [(1, None, None, "invalid", none, 1, None, None), (1, None, None, "invalid", none, 2, None, None),
            (1, None, None, "invalid", none + "; unknown tool", None, "d", None),
            (None, None, None, "invalid", "arguments are not JSON; no identifier; unknown tool", None, None, None),
            (1, "d", 0, "invalid", f"{call}; {result}", 5, None, "r3"), (1, "d", 2, "invalid", call, 6, "e", None),
            (1, "d", None, "invalid", "cycle; " + call, 7, "d", None), (1, "e", 1, "no_result", "", 8, "d", None),
            *((1, None, None, "orphan_result", "", None, None, r) for r in ("r1", "r2", "r2")),
            (None, None, None, "orphan_result", "", None, None, None),
            *((1, "d", None, "orphan_result", result, None, None, r) for r in ("r4", None)),
            *((1, "z", None, "orphan_result", result, None, None, r) for r in ("r5", "r6"))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_tool_listed_twice_has_its_least_parameters(spark):
    more = [("add", [("a", "string", True)]), ("add", None)]
    for tools in (ADD + more, more[::-1] + ADD):
        got = run(spark, [(1, "x", None, "add", '{"a": 1}'), (1, "y", None, "add", '{"a": "1"}')], [], tools)
        assert (got[1, "x"].errors, got[1, "y"].errors) == ("", "wrong type a")


def test_long_arguments_and_contents(spark):
    long = "é" * 300_000
    got = run(spark, [(1, "x", None, "add", json.dumps({"a": 1, "tags": [long]}))], [(1, "x", long)])[1, "x"]
    assert got.status == "ok" and json.loads(got.message)["result"] == long == json.loads(got.message)["arguments"]["tags"][0]
