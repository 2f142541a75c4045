"""The live replay: shuffled micro-batches, restarts, forks and rewinds give what the batch replay gives for the whole transcripts."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from test_replay import RATES, session

from stockline.operators import billing, profiles
from stockline.operators import replay as R
from stockline.sources import transcripts as T
from stockline.streaming import fold, live, sinks

SAME = ("segment", "folded_seq", "miss", "l", "dead", "b", "deferred", "residual", "g", "burn", "cycles", "deep_water", "gate_fires", "dw_bills", "laps", "backstop_fires")


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6) if isinstance(a, float) and isinstance(b, float) else a == b


def linear(seed, n=160):
    """A session without forks, with a later root, falls, misses, MCP tools and malformed lines."""
    rng, entries, stock, waiting = random.Random(seed), [], 20_000, []
    for i in range(n):
        parent = None if i == 0 or i == n // 2 else entries[-1]["uuid"]
        if rng.random() < 0.5:
            stock = max(8_000, stock + rng.choice([0, 800, 3_000, 6_000]) if rng.random() < 0.98 else stock - 15_000)
            cr = rng.choice([stock, stock, stock, stock, stock - 400, stock // 2])
            name = rng.choice(["Write", "Edit", "mcp__x__y"])
            given = {"file_path": f"f{rng.randrange(3)}.py", "content": "some words of text\n" * rng.randrange(60), "old_string": "a\n" * rng.randrange(20), "new_string": "bb\n" * rng.randrange(60)}
            content = [{"type": "tool_use", "id": f"t{i}", "name": name, "input": given}]
            waiting.append(f"t{i}")
            usage = {"input_tokens": 3, "output_tokens": 7, "cache_read_input_tokens": cr, "cache_creation_input_tokens": stock - cr}
            entry = {"type": "assistant", "message": {"id": f"m{i // 2}", "model": "claude-opus-4-8", "usage": usage, "content": content}}
        elif waiting and rng.random() < 0.8:
            entry = {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": waiting.pop(rng.randrange(len(waiting))), "content": "ok", "is_error": rng.random() < 0.1}]}}
        else:
            entry = {"type": "user", "message": {"content": "hello"}}
        entries.append({"uuid": f"u{i}", "parentUuid": parent, "cwd": "/repo", "timestamp": f"2024-01-01T00:{i % 60:02d}:00Z", **entry})
    return entries


def lines_of(sessions):
    return [(s, i, json.dumps(e)) for s, entries in sessions.items() for i, e in enumerate(entries)]


def streamed(spark, parts, folder, restart_after=None, tables=False):
    """Rows of a stream that gets ``parts`` as one micro-batch each; it is stopped and started again after ``restart_after`` of them."""
    got = []

    def keep(df, i):
        got.extend(df.collect())
        if tables:
            sinks.LiveTables(spark, f"{folder}/tables", df.schema).write(df, i)

    for k, part in enumerate(parts):
        spark.createDataFrame(part, "session_id long, ord long, line string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k + 1 in (restart_after, len(parts)):
            stream = spark.readStream.schema("session_id long, ord long, line string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            out = live.live_replay(stream, *(F.lit(x) for x in RATES), timeout=False)
            query = fold.snapshot_sink(out, keep, None, f"{folder}/state")
            assert query.awaitTermination(300)
    return got


def kept(rows):
    """What stays of each session: its rows after the last rewind."""
    last = {}
    for r in rows:
        last[r.session_id] = max(last.get(r.session_id, 0), r.rewinds)
    return [r for r in rows if r.rewinds == last[r.session_id]]


def batch(spark, lines):
    entries = T.parse_entries(spark.createDataFrame(lines, "session_id long, ord long, line string"))
    calls = R.replay(entries, *(F.lit(x) for x in RATES))
    return billing.backstop(billing.alert_gate(billing.bill_meter(calls)))


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    sessions = {s: session(s) for s in range(5)} | {100 + s: linear(s) for s in range(4)}
    lines = lines_of(sessions)
    rng = random.Random(3)
    # a line comes near its place, but neither in order nor in the batch of its neighbours
    at = sorted(range(len(lines)), key=lambda i: lines[i][1] + rng.random() * 12)
    cuts = [0, 60, 200, 201, 500, len(lines)]
    parts = [[lines[i] for i in at[a:b]] for a, b in zip(cuts, cuts[1:]) if b > a]
    folder = str(tmp_path_factory.mktemp("live"))
    rows = streamed(spark, parts, folder, restart_after=3, tables=True)
    placed = batch(spark, lines).cache()
    return rows, placed, folder


def test_calls_equal_the_batch_replay(shuffled):
    rows, placed, _ = shuffled
    want = {(r.session_id, r.call_id): r for r in placed.collect()}
    got = {(r.session_id, r.call_id): r for r in kept(rows) if r.kind == "call"}
    assert got.keys() == want.keys() and len(want) > 200
    for key, w in want.items():
        for name in SAME:
            assert close(got[key][name], w[name]), (key, name, got[key], w)
    assert any(r.kind == "rewind" for r in rows) and sum(w.segment > 0 for w in want.values()) > 20
    assert sum(w.b > w.dead for w in want.values()) > 50 and sum((w.deferred or 0) > 0 for w in want.values()) > 20 and sum(w.deep_water for w in want.values()) > 5


def test_closed_segments_equal_the_batch_profiles(shuffled):
    rows, placed, _ = shuffled
    last = placed.groupBy("session_id").agg(F.max("segment").alias("last"))
    want = {(r.session_id, r.segment): r for r in profiles.segment_profiles(placed).join(last, "session_id").where("segment < last").collect()}
    got = {(r.session_id, r.segment): r for r in kept(rows) if r.kind == "closed"}
    assert want and got.keys() == want.keys()
    for key, w in want.items():
        for name in (*fold.PROFILE, "b_total"):
            # turns and times are those of a call's first snapshot in the stream, and of its last in the batch
            if name not in ("turns", "turn_at_br_amber") and (name, key[0] >= 100) != ("duration_ms", True):
                assert close(got[key][name], w[name]), (key, name, got[key], w)


def test_tables_hold_what_stays(spark, shuffled):
    rows, _, folder = shuffled
    tables = sinks.LiveTables(spark, f"{folder}/tables", spark.createDataFrame([], live.CALL.format("long")).schema)
    stays = kept(rows)
    assert {(r.session_id, r.segment, r.l_peak, r.rewinds) for r in tables.profiles().collect()} == {(r.session_id, r.segment, r.l_peak, r.rewinds) for r in stays if r.kind == "closed"}
    assert sorted((r.session_id, r.segment, r.folded_seq, r.call_id, r.b) for r in tables.steps().collect()) == sorted((r.session_id, r.segment, r.folded_seq, r.call_id, r.b) for r in stays if r.kind == "call")
    paths = sorted((r.session_id, r.segment, r.path, r.path_tokens) for r in tables.paths().collect())
    assert paths and paths == sorted((r.session_id, r.segment, r.path, r.path_tokens) for r in stays if r.kind == "path")


def test_linear_sessions_have_turns_and_no_rewinds(shuffled):
    rows, placed, _ = shuffled
    mine = [r for r in rows if r.session_id >= 100]
    assert not any(r.rewinds for r in mine)
    want = {(r.session_id, r.call_id): r.turn_seq for r in placed.where("session_id >= 100").collect()}
    got = {(r.session_id, r.call_id): r.turn_seq for r in mine if r.kind == "call"}
    assert sum(got[k] == want[k] for k in want) > 0.9 * len(want)  # a human turn between two snapshots of one call is seen too late


def test_anchors_equal_the_batch_and_lifetime_never_falls(spark, shuffled):
    calls = [r for r in shuffled[0] if r.kind == "call"]
    samples = spark.createDataFrame([(r.session_id, r.at + 10_000 * r.rewinds, f"{r.rewinds}:{r.segment}", r.folded_seq) for r in calls], "session_id long, ord long, state_key string, seq long")
    want = {(r.session_id, r.ord): r.anchor for r in fold.reanchor(samples).collect()}
    got = {(r.session_id, r.at + 10_000 * r.rewinds): r for r in calls}
    assert all(got[k].anchor == a for k, a in want.items()) and sum(want.values()) > 10
    by = {}
    for k in sorted(got):
        by.setdefault(k[0], []).append(got[k].lifetime)
    assert all(x == sorted(x) for x in by.values()) and any(x[-1] > 0 for x in by.values())


def test_rewind_is_found_and_a_longer_branch_is_not(spark, tmp_path):
    say = lambda u, p: {"uuid": u, "parentUuid": p, "type": "user", "message": {"content": "x"}}
    call = lambda u, p, cr: say(u, p) | {"type": "assistant", "message": {"id": u, "model": "claude", "usage": {"input_tokens": 1, "output_tokens": 1, "cache_read_input_tokens": cr, "cache_creation_input_tokens": 0}, "content": "x"}}
    first = [call("a", None, 1000), say("b", "a"), call("c", "b", 2000)]
    side = [say("d", "b"), call("e", "c", 3000)]  # goes on from c: d is a dead end
    back = [call("f", "b", 2500)]  # leaves c and e
    on = [call("g", "f", 2600)]
    parts, n = [], 0
    for part in (first, side, back, on):
        parts.append([(1, n + i, json.dumps(e)) for i, e in enumerate(part)])
        n += len(part)
    rows = streamed(spark, parts, str(tmp_path))
    assert sum(r.kind == "rewind" for r in rows) == 1
    assert [(r.call_id, r.rewinds) for r in sorted(rows, key=lambda r: (r.rewinds, r.at)) if r.kind == "call"] == [("a", 0), ("c", 0), ("e", 0), ("a", 1), ("f", 1), ("g", 1)]


def test_late_lines_bad_lines_and_late_results(spark, tmp_path):
    use = lambda u, p, name: {"uuid": u, "parentUuid": p, "type": "assistant", "cwd": "/r", "message": {"id": u, "model": "claude", "usage": {"input_tokens": 1, "output_tokens": 1, "cache_read_input_tokens": 1000, "cache_creation_input_tokens": 0}, "content": [{"type": "tool_use", "id": f"t{u}", "name": name, "input": {"file_path": "f", "content": "x y z\n" * 50}}]}}
    said = lambda u, p: {"uuid": u, "parentUuid": p, "type": "user", "message": {"content": "go on"}}
    result = lambda u, p, of: {"uuid": u, "parentUuid": p, "type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": of, "content": "ok"}]}}
    entries = [use("a", None, "mcp__s__f"), said("b", "a"), use("c", "b", "Write"), said("d", "c"), use("e", "d", "Write"), said("f", "e"), use("g", "f", "Write"), result("h", "g", "ta"), result("i", "h", "tc")]
    lines = [(1, i, json.dumps(e)) for i, e in enumerate(entries)]
    lines.insert(3, (1, None, "{broken"))
    lines = [(1, i, x[2]) for i, x in enumerate(lines)]
    order = [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]  # nothing can be folded before the last batch
    stream_in = [[lines[i]] for i in order[:2]] + [[lines[i] for i in order[2:9]], [lines[0]]]
    for k, part in enumerate(stream_in):
        spark.createDataFrame(part, "session_id long, ord long, line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session_id long, ord long, line string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    assert fold.snapshot_sink(live.sequenced(stream, timeout=False), lambda df, i: got.extend((i, r) for r in df.collect()), None, f"{tmp_path}/state").awaitTermination(120)
    assert {i for i, _ in got} == {3}
    assert [r.call_id for _, r in sorted(got, key=lambda x: x[1].at) if r.kind == "call"] == ["a", "c", "e", "g"]
    # the MCP use waited for more than two turns and is forgotten; the file tool's result counts
    assert [(r.id, r.turns) for _, r in got if r.kind == "tool"] == [("tc", 3)]


def test_a_batch_writes_only_what_it_touches(spark, tmp_path):
    """10,000 known calls, then one: the second batch updates a handful of rows of the state."""
    line = lambda i: json.dumps({"uuid": f"u{i}", "parentUuid": f"u{i - 1}" if i else None, "type": "assistant", "message": {"id": f"m{i}", "model": "claude", "usage": {"input_tokens": 1, "output_tokens": 1, "cache_read_input_tokens": 1000 + i, "cache_creation_input_tokens": 0}, "content": "x"}})
    for part in ([(1, i, line(i)) for i in range(10_000)], [(1, 10_000, line(10_000))]):
        spark.createDataFrame(part, "session_id long, ord long, line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("session_id long, ord long, line string").parquet(f"{tmp_path}/in")
        query = fold.snapshot_sink(live.sequenced(stream, timeout=False), lambda df, i: df.count(), None, f"{tmp_path}/state")
        assert query.awaitTermination(300)
        updated = query.lastProgress["stateOperators"][0]["numRowsUpdated"] if query.lastProgress["numInputRows"] else None
        last = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
        assert updated is None or updated == last[-1]
    assert 0 < last[-1] < 20
