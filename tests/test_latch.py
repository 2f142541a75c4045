"""Rules that latch anew and recurrences as windows, against loops over rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from stockline.functions import economics as E
from stockline.operators import billing, calls, corpus, tree

SIZES = (1, 2, 3, 40, 700)


def loop_backstop(rows, consume=True):
    bills, laps, out = 0.0, 0, {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        fired = False
        if r["gate_open"] and not r["gate_fires"] and r["deep_water"]:
            bills += r["new_cycles"]
            if r["interval"] and 0 < r["interval"] < float("inf") and bills >= r["interval"]:
                fired = True
                if consume:
                    bills, laps = 0.0, laps + 1
        out[r["session_id"], r["segment"], r["ord"]] = (bills, laps, fired)
    return out


def test_backstop_equals_a_loop_and_can_leave_the_bills(spark):
    rng = random.Random(1)
    rows = []
    for s in range(12):
        opens = rng.randrange(5)
        for i in range(rng.choice(SIZES)):
            rows.append((s, s % 2, i * 3, rng.random() < 0.8, i >= opens, i == opens, rng.choice([0, 0, 1, 2, 9]), rng.choice([None, 0.0, 0.02, 0.05, 0.1, 0.3])))
    df = spark.createDataFrame(rows, "session_id long, segment long, ord long, deep_water boolean, gate_open boolean, gate_fires boolean, new_cycles long, mf double").repartition(3)
    interval = {r.mf: r.x for r in df.select("mf", E.backstop_interval(F.col("mf")).alias("x")).distinct().collect()}
    by = {}
    for r in df.collect():
        by.setdefault((r.session_id, r.segment), []).append(r.asDict() | {"interval": interval[r.mf]})
    for consume in (True, False):
        got = {(r.session_id, r.segment, r.ord): (r.dw_bills, r.laps, r.backstop_fires) for r in billing.backstop(df, consume).collect()}
        want = {k: v for part in by.values() for k, v in loop_backstop(part, consume).items()}
        assert got == want and sum(v[2] for v in want.values()) > 30


def test_fold_jumps_equal_a_loop(spark):
    rng = random.Random(2)
    lengths = {s: np.cumsum([rng.choice([5, 10, 10, 20, -30, 400, 900]) if rng.random() < 0.3 else 10 for _ in range(rng.choice(SIZES))]).tolist() for s in range(15)}
    df = spark.createDataFrame([(s, 0, i, int(v)) for s, vs in lengths.items() for i, v in enumerate(vs)], "session_id long, segment long, ord long, l long").repartition(3)
    for n, confirm in ((8, 3), (2, 1), (4, 5)):
        want = {}
        for s, vs in lengths.items():
            up = [b - a for a, b in zip(vs, vs[1:]) if b > a]
            k, base = float(np.median(up)) if up else 0.0, 0
            for i in range(1, len(vs)):
                ahead = [vs[j] - (vs[base] + k * (j - base)) for j in range(i, i + confirm) if j < len(vs)]
                if k > 0 and len(ahead) == confirm and all(x > n * k for x in ahead):
                    want[s, i], base = (ahead[0], k), i
        got = {(r.session_id, r.ord): (r.size, r.k_stable) for r in corpus.fold_jumps(df, n, confirm).collect()}
        assert got == want and len(want) > 5


def test_growth_over_many_chunks_equals_the_recurrence(spark):
    rng = random.Random(3)
    rows = [(s, 0, i, None if i == 0 and s != 2 or rng.random() < 0.005 else rng.choice([0.0, 1e6 * rng.random(), rng.random()])) for s in range(4) for i in range((1, 50, 900, 3000)[s])]
    df = spark.createDataFrame(rows, "session_id long, segment long, ord long, residual double").repartition(3)
    want, g = {}, 100.0
    for s, _, i, r in rows:
        g = 100.0 if i == 0 and r is not None else g
        g = 100.0 if r is None else 0.12 * r + 0.88 * g
        want[s, i] = g
    out = calls.growth_ema(df)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    for chunk in (256, 7):
        for r in calls.growth_ema(df, chunk=256 if chunk == 256 else 128).collect():
            assert abs(r.g_ema - want[r.session_id, r.ord]) <= 1e-9 * max(1.0, want[r.session_id, r.ord])


def test_ancestors_by_lifting_and_on_cycles(spark):
    rng = random.Random(4)
    parent = {f"n{i}": (f"n{rng.randrange(max(0, i - 3), i)}" if i % 50 else None) for i in range(400)} | {"a": "b", "b": "c", "c": "a", "d": "a"}
    edges = tree.tree_edges(spark.createDataFrame([(1, i, u, p, False) for i, (u, p) in enumerate(parent.items())], "session_id long, ord long, uuid string, parent_uuid string, is_sidechain boolean"))

    def up(u):
        seen, at = [], parent.get(u)
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at)
        return set(seen) - {u}

    pairs = [(1, rng.choice([*up(u)] or ["n0"]) if rng.random() < 0.6 else rng.choice(list(parent)), u) for u in rng.sample(list(parent)[:400], 150)] + [(1, x, y) for x in "abcd" for y in "abcd"] + [(1, "n0", "none"), (1, "none", "n5")]
    df = spark.createDataFrame(pairs, "session_id long, ancestor string, uuid string")
    got = {(r.ancestor, r.uuid): r.is_ancestor for r in tree.is_ancestor(edges, df).collect()}
    assert got == {(a, u): a in up(u) for _, a, u in pairs} and sum(got.values()) > 50
