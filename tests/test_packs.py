"""Rows of a stream go between Python and the JVM in packs, and a stream's number of micro-batches doesn't grow with its files."""

import json
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_held import Counted
from test_sinks import call, closed, path, rewind, rows, seen

from stockline.plans import stream_queries
from stockline.streaming import fold, live, sinks


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def started(processor):
    maps = {}
    processor.init(SimpleNamespace(getMapState=lambda name, *_: maps.setdefault(name, Counted()), getValueState=lambda *_: Value()))
    return processor, maps


def test_packs_hold_every_row_and_value(spark):
    given = [{"session_id": 1, "kind": "call", "at": i, "ord": None if i % 3 == 0 else 10**15 + i, "b": i / 7, "call_id": 'm"é\n' if i % 2 else None, "miss": i % 5 == 0} for i in range(600)]
    given += [{"session_id": 1, "kind": "closed", "at": 7, "x_axis": 1e-300}, {"session_id": 1, "kind": "closed", "at": 8, "x_axis": None}, {"kind": "rewind", "at": 9}]
    packed = list(fold.packs(given))
    assert [p["n"] for p in packed] == [256, 256, 88, 2, 1]
    assert [dict(r, kind=p["kind"]) for p in packed for r in fold.rows_of(p["pack"], p["n"])] == [{k: v for k, v in r.items() if k != "session_id"} for r in given]
    frame = spark.createDataFrame([(1, p["kind"], p["n"], p["pack"]) for p in packed], fold.PACKED.format("long"))
    got = fold.unpacked(frame, live.CALL.format("long"))
    assert got.schema.names == live._names(live.CALL)
    names = ("session_id", "kind", "at", "ord", "b", "call_id", "miss", "x_axis")
    want = [tuple({"session_id": 1, **r}.get(c) for c in names) for r in given]
    assert sorted(map(tuple, got.select(*names).collect()), key=lambda r: (r[1], r[2])) == sorted(want, key=lambda r: (r[1], r[2]))


def test_a_session_leaves_python_in_few_rows():
    usage = Row("session_id", "ord", "message_id", "model", "cr", "cc", "inp", "outp", "human_turn", "ms")
    processor, _ = started(fold.FoldProcessor(None))
    out = list(processor.handleInputRows((1,), iter([usage(1, i, f"m{i}", "claude", 20_000 - 15_000 * (i % 40 == 39) + i, 5, 1, 1, False, i) for i in range(200)]), None))
    told = [(r.kind, x) for r in out for x in fold.rows_of(r.pack, r.n)]
    assert sum(k == "call" for k, _ in told) == 200 and sum(k == "closed" for k, _ in told) > 3 and len(out) < 5

    line = lambda i, **more: json.dumps({"call": f"m{i}", "ms": i, "model": "claude", "cr": 20_000 + i, "cc": 5, "inp": 1, "outp": 1, "used": True, "turn": False} | more)
    processor, maps = started(live.Sequencer(None))
    sent = list(processor.handleInputRows((1,), iter([(1, list(range(120)), [line(i) for i in range(120)])]), None))
    assert len(sent) == 1 and sent[0].n == 120
    # nothing is read again of lines without a tree: neither they nor their few calls are keys of a map
    assert not any(m.calls for m in maps.values())
    ledger, _ = started(live.Ledger(None))
    got = list(ledger.handleInputRows((1,), iter([(1, r.kind, r.n, r.pack, None) for r in sent]), None))
    assert len(got) == 1 and [x["ord"] for x in fold.rows_of(got[0].pack, got[0].n)] == list(range(120))

    processor, maps = started(live.Sequencer(None))
    list(processor.handleInputRows((1,), iter([(1, [0, 1], [line(0, uuid="a"), line(1, uuid="b", parent="a")])]), None))
    assert [v for (v,) in maps["runs"].rows.values()] == [[line(0, uuid="a"), line(1, uuid="b", parent="a")]]


def test_lines_of_a_session_come_as_runs():
    given = [(1, 0, "a"), (1, 1, None), (2, 5, "b"), (None, 0, "c"), (None, 1, "d"), (2, 6, "e"), (2, 7, "f")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*given, strict=True)], ["session_id", "ord", "row"])
    out = [tuple(r.values()) for b in live._in_runs([batch, batch.slice(0, 0), batch.slice(2, 1)]) for r in b.to_pylist()]
    assert [(s, o, t) for s, ords, texts in out for o, t in zip(ords, texts, strict=True)] == [*given, given[2]]
    assert [s for s, _, _ in out] == [1, 2, None, None, 2, 2]


def test_tables_of_packs_are_those_of_rows(spark, tmp_path):
    schema = spark.createDataFrame([], live.CALL.format("long")).schema
    batches = [[call(1, 0, 1), call(1, 0, 2), path(1, 0, "a", 5.0), closed(1, 0, 7), call(2, 0, 1)], [call(1, 0, 2, tokens=30), call(2, 0, 2), rewind(2, 1), call(2, 0, 1, tokens=9, rewinds=1)]]
    told = []
    for name in ("rows", "packs"):
        tables = sinks.LiveTables(spark, str(tmp_path / name), schema)
        for i, batch in enumerate(batches):
            packed = [(s, p["kind"], p["n"], p["pack"]) for s in (1, 2) for p in fold.packs(r for r in batch if r["session_id"] == s)]
            tables.write(rows(spark, *batch) if name == "rows" else spark.createDataFrame(packed, fold.PACKED.format("long")), i)
        told.append(seen(tables))
    assert told[0] == told[1] and told[0][1] == [(1, 0, 1, 10), (1, 0, 2, 10), (2, 0, 1, 9)]


def test_batches_do_not_grow_with_small_files(spark, tmp_path):
    source = stream_queries._streamed(spark, spark.range(400).repartition(40), str(tmp_path))
    batches = []
    fold.snapshot_sink(source, lambda df, i: batches.append(df.agg(F.sum("id")).first()[0]), None, str(tmp_path / "state")).awaitTermination(120)
    assert batches == [sum(range(400))]
