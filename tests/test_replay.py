"""A whole replay against a fold of one entry after the other."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stockline.operators import replay as R
from stockline.operators import tools
from stockline.sources import transcripts as T

RATES = (2.45, 0.59)


def session(seed):
    """Entries with forks, further roots, falls of the stock, misses, and files that are written and answered late or never."""
    rng = random.Random(seed)
    entries, stock, waiting = [], 20_000, []
    for i in range(60):
        parent = None if i == 0 or rng.random() < 0.04 else entries[-1]["uuid"] if rng.random() < 0.9 else rng.choice(entries[-6:])["uuid"]
        if rng.random() < 0.55:
            stock = max(8_000, stock + rng.choice([0, 300, 2_000, 9_000]) if rng.random() < 0.9 else stock - 15_000)
            cr = rng.choice([stock, stock, stock - 400, stock // 2, 0])
            content = [{"type": "text", "text": "x"}]
            if rng.random() < 0.6:
                content.append({"type": "tool_use", "id": f"t{i}", "name": "Write", "input": {"file_path": f"f{rng.randrange(4)}.py", "content": "some words of text\n" * rng.randrange(400)}})
                waiting.append(f"t{i}")
            usage = {"input_tokens": 3, "output_tokens": 7, "cache_read_input_tokens": cr, "cache_creation_input_tokens": stock - cr}
            entry = {"type": "assistant", "message": {"id": f"m{i}", "model": "claude-opus-4-8", "usage": usage, "content": content}}
        elif waiting and rng.random() < 0.8:
            done = waiting.pop(rng.randrange(len(waiting)))
            entry = {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": done, "content": "ok"}]}}
        else:
            entry = {"type": "user", "message": {"content": "hello"}}
        entries.append({"uuid": f"u{i}", "parentUuid": parent, "cwd": "/repo", "timestamp": "2024-01-01T00:00:00Z", **entry})
    return entries


def runs(entries):
    """Lists of entries as they are replayed: one for each root, or the active branch."""
    parent = {e["uuid"]: e["parentUuid"] for e in entries}
    children = {}
    for e in entries:
        children.setdefault(e["parentUuid"], []).append(e["uuid"])

    def branch(start):
        while start in children:
            start = children[start][-1]
        path = set()
        while start:
            path.add(start)
            start = parent[start]
        return [e for e in entries if e["uuid"] in path]

    roots = children[None]
    return [branch(r) for r in roots] if len(roots) > 1 else [branch(entries[-1]["uuid"])]


def fold(entries, writes):
    out, segment, bank = [], 0, 0.0
    state = None

    def fresh():
        return {"dead": 0, "prev_l": None, "prev_stock": 0, "prev_b": 0.0, "g": None, "paths": {}, "pending": {}, "deltas": {}, "ceiling": 0}

    for k, run in enumerate(runs(entries)):
        if k == 0 or any(o["segment"] == segment for o in out):
            segment += k > 0
        state, bank = fresh(), 0.0
        for e in run:
            message = e["message"]
            for b in message["content"] if isinstance(message["content"], list) else []:
                if b["type"] == "tool_use":
                    state["pending"][b["id"]] = True
                elif b["type"] == "tool_result" and state["pending"].pop(b["tool_use_id"], None):
                    path, total = writes[b["tool_use_id"]]
                    change = total - state["paths"].get(path, 0.0)
                    state["paths"][path] = total
                    state["deltas"][path] = state["deltas"].get(path, 0.0) + change
            if e["type"] != "assistant":
                continue
            u = message["usage"]
            cr, cc = u["cache_read_input_tokens"], u["cache_creation_input_tokens"]
            stock = cr + cc + u["input_tokens"]
            p = state["prev_l"]
            if state["prev_stock"] > 0 and stock < state["prev_stock"] - 100 and not (p and p > 0 and cr < p * 0.95):
                segment += 1
                state, bank = fresh(), 0.0
                p = None
            if state["dead"] == 0:
                state["dead"], state["ceiling"] = max(cr, cc, u["input_tokens"]), stock
            base = state["dead"] + sum(state["paths"].values())
            miss = p is not None and p > 0 and cr < 0.95 * p and stock >= state["prev_stock"] - 100
            length = cr + cc if miss else cr
            residual = None
            if p is not None:
                dl = length - p
                if p < state["ceiling"] and dl > 0:
                    dl = max(0, length - state["ceiling"])
                up, db = max(0, dl), base - state["prev_b"]
                positive = sum(max(0.0, x) for x in state["deltas"].values())
                ahead, behind = min(max(0.0, db - up), positive), max(0.0, up - db)
                retired = min(bank, behind)
                bank += ahead - retired
                residual = behind - retired
                state["g"] = 0.12 * residual + 0.88 * state["g"]
            else:
                state["g"] = 100.0
            state["deltas"] = {}
            state |= {"prev_l": length, "prev_stock": stock, "prev_b": base}
            out.append({"id": message["id"], "segment": segment, "l": length, "miss": miss, "dead": state["dead"], "b": base, "residual": residual, "deferred": bank, "g": max(100.0, state["g"])})
    return out


def test_replay_matches_a_sequential_fold(spark):
    sessions = {s: session(s) for s in range(14)}
    lines = [(s, i, json.dumps(e)) for s, entries in sessions.items() for i, e in enumerate(entries)]
    entries = T.parse_entries(spark.createDataFrame(lines, "session_id long, ord long, line string").repartition(3))
    rates = [F.lit(x) for x in RATES]
    every = T.blocks(entries)
    uses = every.where("kind = 'tool_use'").selectExpr("session_id", "id", "cwd", "name", "input", "ord AS result_ord", "'ok' AS result_text", "block_pos")
    written = tools.line_writes(uses, *rates).groupBy("session_id", "id", "path").agg((F.sum("tokens") + F.max("overhead")).alias("total")).collect()
    writes = {s: {r.id: (r.path, r.total) for r in written if r.session_id == s} for s in sessions}
    got = {(r.session_id, r.call_id): r for r in R.replay(entries, *rates).collect()}
    want = {(s, o["id"]): o for s, e in sessions.items() for o in fold(e, writes[s])}
    assert got.keys() >= want.keys() and len(want) > 200
    assert sum(o["miss"] for o in want.values()) > 10 and sum(o["segment"] > 0 for o in want.values()) > 30 and sum((o["deferred"] or 0) > 0 for o in want.values()) > 20
    for key, o in want.items():
        r = got[key]
        assert (r.segment, r.l, r.miss, r.dead) == (o["segment"], o["l"], o["miss"], o["dead"]), (key, o, r)
        for name in ("b", "residual", "deferred", "g"):
            assert getattr(r, name) == (None if o[name] is None else pytest.approx(o[name], abs=1e-6)), (key, name, o, r)
    assert len(got) == len(want)
