import json
import random

import pytest

from stockline.llm import tool_calls as L


def frames(spark, calls, results, schemas):
    return (
        spark.createDataFrame(calls, L.CALLS),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"),
        spark.createDataFrame(schemas, "name string, argument string, type string, required boolean"),
    )


SCHEMAS = [("add", "a", "number", True), ("add", "b", "integer", True), ("add", "note", "string", False), ("put", "o", "object", True), ("put", "l", "array", False)]


def test_links_validates_and_serialises(spark):
    calls = [
        (1, "x", 1, "add", '{"b": 2, "a" :1.5}', []),
        (1, "y", 3, "add", '{"a": "1", "b": 2.5, "c": null}', ["x", "gone"]),
        (1, "z", 5, "put", '{"o": {"z": 1, "a": [true, null, "é\\n"]}, "l": []}', ["y"]),
        (1, "w", 7, "put", "not json", None),
        (2, "x", 1, "unknown", "[1]", []),
        (None, "x", 1, "add", None, []),
        (2, None, 2, "add", '{"a": 1, "b": 1}', []),
    ]
    results = [(1, "x", 2, 'said "hi"'), (1, "x", 4, "later"), (1, "y", 4, None), (3, "x", 2, "other"), (None, "x", 1, "n")]
    c, r, s = frames(spark, calls, results, SCHEMAS)
    got = {(x.conv_id, x.call_id): x for x in L.link(c, r, s).collect()}
    assert len(got) == 7
    assert got[1, "x"].valid and got[1, "x"].result_turn == 2 and got[1, "x"].linked
    assert got[1, "x"].json == '{"arguments":{"a":1.5,"b":2},"call_id":"x","name":"add","result":"said \\"hi\\""}'
    assert got[1, "y"].mistakes == ["a", "b", "c"] and got[1, "y"].missing_needs == 1 and got[1, "y"].linked
    assert got[1, "z"].valid and not got[1, "z"].linked
    assert json.loads(got[1, "z"].json)["arguments"] == {"o": {"z": 1, "a": [True, None, "é\n"]}, "l": []}
    assert '"o":{"a":[true,null,"é\\n"],"z":1}' in got[1, "z"].json
    assert got[1, "w"].mistakes == ["not an object"] and got[2, "x"].mistakes == ["unknown tool"]
    assert not got[None, "x"].linked and got[2, None].valid
    assert sorted((x.conv_id or 0, x.call_id) for x in L.orphans(c, r).collect()) == [(0, "x"), (3, "x")]
    assert L.link(c.where("false"), r, s).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_order_is_topological(spark, seed):
    rng = random.Random(seed)
    calls, want = [], {}
    for conv in range(12):
        n = rng.randint(1, 9)
        needs = {i: {rng.randrange(n) for _ in range(rng.choice([0, 1, 1, 2]))} for i in range(n)}
        if conv % 3 == 0:
            needs = {i: {j for j in x if j < i} for i, x in needs.items()}
        calls += [(conv, str(i), i, "add", "{}", [str(j) for j in needs[i]]) for i in range(n)]
        done, level = {}, 0
        while ready := [i for i in range(n) if i not in done and all(j in done for j in needs[i])]:
            done |= dict.fromkeys(ready, level)
            level += 1
        want[conv] = (needs, done)
    c, r, s = frames(spark, calls, [], SCHEMAS)
    rows = L.link(c, r, s).collect()
    for conv, (needs, done) in want.items():
        own = {int(x.call_id): x for x in rows if x.conv_id == conv}
        assert {i for i, x in own.items() if x.level is not None} == set(done)
        place = sorted(own, key=lambda i: (own[i].level is None, own[i].level or 0, own[i].turn))
        for i in done:
            assert all(place.index(j) < place.index(i) for j in needs[i])


def test_plan_has_no_python(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    calls, results, schemas = L.calls_of(conversations)
    got = L.link(calls, results, schemas)
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
    rows = got.collect()
    assert len(rows) == calls.count() and any(r.valid for r in rows) and any(not r.valid for r in rows)
