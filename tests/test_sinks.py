"""Tables of a stream: batches that are written again, that fail half-way, that rewind, and tables that are compacted."""

import pytest

from stockline.operators.profiles import PRIORITY
from stockline.streaming import live, sinks

SCHEMA = live.CALL.format("long")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def rows(spark, *given):
    return spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in given], SCHEMA)


def call(session, segment, seq, tokens=10, rewinds=0, at=None):
    return {"session_id": session, "kind": "call", "segment": segment, "folded_seq": seq, "call_id": f"c{seq}", "ord": seq, "tokens": tokens, "l": tokens, "b": 1.0, "g": 1.0, "miss": False, "at": seq if at is None else at, "rewinds": rewinds}


def closed(session, segment, peak, rewinds=0, at=99):
    return {"session_id": session, "kind": "closed", "segment": segment, "l_peak": peak, "n_calls": 1, "b_total": 5.0, "at": at, "rewinds": rewinds}


def path(session, segment, name, tokens, rewinds=0):
    return {"session_id": session, "kind": "path", "segment": segment, "path": name, "path_tokens": tokens, "at": 99, "rewinds": rewinds}


def rewind(session, rewinds):
    return {"session_id": session, "kind": "rewind", "at": 1, "rewinds": rewinds}


def seen(tables):
    return (
        sorted((r.session_id, r.segment, r.l_peak, r.archive_source) for r in tables.profiles().collect()),
        sorted((r.session_id, r.segment, r.folded_seq, r.tokens) for r in tables.steps().collect()),
        sorted((r.session_id, r.segment, r.path, r.path_tokens) for r in tables.paths().collect()),
    )


@pytest.fixture
def tables(spark, tmp_path):
    return sinks.LiveTables(spark, str(tmp_path / "tables"), rows(spark).schema)


def test_a_batch_written_twice_leaves_one_copy(spark, tables):
    assert seen(tables) == ([], [], [])
    first = rows(spark, call(1, 0, 1), call(1, 0, 2), closed(1, 0, 20), path(1, 0, "a", 3.0), call(1, 1, 3))
    second = rows(spark, call(1, 1, 4), closed(1, 1, 40), call(2, 0, 1))
    for batch, part in ((0, first), (0, first), (1, second), (0, first), (1, second)):
        tables.write(part, batch)
    assert seen(tables) == ([(1, 0, 20, "live"), (1, 1, 40, "live")], [(1, 0, 1, 10), (1, 0, 2, 10), (1, 1, 3, 10), (1, 1, 4, 10), (2, 0, 1, 10)], [(1, 0, "a", 3.0)])


def test_a_batch_that_fails_half_way_is_written_once(spark, tables, monkeypatch):
    part = rows(spark, call(1, 0, 1), closed(1, 0, 20), path(1, 0, "a", 3.0))
    write, n = sinks.write_batch, []

    def fails(*args, **kwargs):
        n.append(1)
        if len(n) == 3:
            raise OSError("lost")
        return write(*args, **kwargs)

    monkeypatch.setattr(sinks, "write_batch", fails)
    with pytest.raises(OSError):
        tables.write(part, 0)
    assert seen(tables)[0] == []
    tables.write(part, 0)
    assert seen(tables) == ([(1, 0, 20, "live")], [(1, 0, 1, 10)], [(1, 0, "a", 3.0)])


def test_a_key_twice_fails_before_it_is_written(spark, tables):
    with pytest.raises(ValueError, match="twice"):
        tables.write(rows(spark, call(1, 0, 1), call(1, 0, 1)), 0)
    assert seen(tables) == ([], [], [])


def test_a_rewind_replaces_what_it_makes_void(spark, tables):
    tables.write(rows(spark, call(1, 0, 1), call(1, 0, 2), closed(1, 0, 20), path(1, 0, "a", 3.0), path(1, 0, "b", 1.0), call(1, 1, 3), closed(1, 1, 30), call(2, 0, 1), closed(2, 0, 9)), 0)
    tables.write(rows(spark, rewind(1, 1), call(1, 0, 1, rewinds=1), call(1, 0, 2, 12, rewinds=1), closed(1, 0, 25, rewinds=1), path(1, 0, "b", 2.0, rewinds=1)), 1)
    want = ([(1, 0, 25, "live"), (2, 0, 9, "live")], [(1, 0, 1, 10), (1, 0, 2, 12), (2, 0, 1, 10)], [(1, 0, "b", 2.0)])
    assert seen(tables) == want


def test_steps_of_a_complete_segment_stay(spark, tables):
    tables.write(rows(spark, call(1, 0, 1), closed(1, 0, 20)), 0)
    tables.write(rows(spark, call(1, 0, 1, 77), call(1, 1, 2)), 1)
    tables.write(rows(spark, call(1, 0, 1), closed(1, 0, 20)), 0)
    assert seen(tables)[1] == [(1, 0, 1, 10), (1, 1, 2, 10)]


def test_priorities_and_compaction(spark, tables, tmp_path):
    profile = rows(spark, closed(1, 0, 5), closed(3, 0, 7))
    for source, batch in (("replay", 0), ("snapshot", 2)):
        sinks.write_batch(sinks.snapshot_profiles(profile, source), batch, f"{tables.folder}/profiles")
    tables.write(rows(spark, call(1, 0, 1), closed(1, 0, 20)), 1)
    tables.write(rows(spark, rewind(1, 1), call(1, 0, 1, 11, rewinds=1), closed(1, 0, 21, rewinds=1), path(1, 0, "p", 1.0, rewinds=1)), 3)
    want = ([(1, 0, 21, "live"), (3, 0, 7, "replay")], [(1, 0, 1, 11)], [(1, 0, "p", 1.0)])
    assert seen(tables) == want and PRIORITY["live"] > PRIORITY["replay"] > PRIORITY["snapshot"]
    new = tables.compact(str(tmp_path / "compact"), 3)
    assert seen(new) == want and new.table("steps").select("batch").distinct().collect()[0][0] == 3
    new.write(rows(spark, call(2, 0, 1), closed(2, 0, 2)), 4)
    assert len(seen(new)[0]) == 3
