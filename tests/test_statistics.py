"""Jumps, plateaus, permutations, bootstrap and tool writes against plain Python over every row."""

import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockline.operators import billing, corpus
from stockline.plans import tree_queries


def segments(seed):
    """Lengths of a few segments that grow by about 100, with leaps and falls."""
    draw, rows = random.Random(seed), []
    for session in range(6):
        length = 1000
        for i in range(draw.choice([0, 1, 3, 30, 60])):
            step = draw.choice([100, 100, 90, 110, 0, -50, 100, 3000 if draw.random() < 0.4 else 100])
            rows.append((session, session % 2, i * 3, length, None if i == 0 else step))
            length += step
    return rows


def plain_jumps(lengths, n=8, confirm=3):
    up = [b - a for a, b in zip(lengths, lengths[1:]) if b > a]
    if not up:
        return {}
    k, base, found = statistics.median(up), 0, {}
    for i in range(1, len(lengths) - confirm + 1):
        above = [lengths[j] - lengths[base] - k * (j - base) for j in range(i, i + confirm)]
        if min(above) > n * k:
            found[i], base = above[0], i
    return found


def r2(y):
    x = np.arange(1, len(y) + 1)
    return float(np.corrcoef(x, y)[0, 1] ** 2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jumps_plateaus_and_permutations(spark, seed):
    rows = segments(seed)
    df = spark.createDataFrame(rows, "session_id long, segment long, ord long, l long, delta_l long")
    by_session = {}
    for s, _, o, length, _ in rows:
        by_session.setdefault(s, []).append((o, length))
    jumps = {s: plain_jumps([x for _, x in v]) for s, v in by_session.items()}
    made = corpus.fold_jumps(df)
    got = {}
    for r in made.collect():
        got.setdefault(r.session_id, {})[r.ord // 3] = r["size"]
    assert got == {s: j for s, j in jumps.items() if j}
    want = {}
    for s, v in by_session.items():
        marks = [0, *sorted(jumps[s]), len(v)]
        for i, (a, b) in enumerate(zip(marks, marks[1:])):
            if b - a >= 5:
                y = np.array([x for _, x in v[a:b]], float)
                want[s, i] = (b - a, float(np.polyfit(np.arange(a, b), y, 1)[0]), r2(y))
    found = {(r.session_id, r.plateau): (r.n, r.slope, r.r2) for r in corpus.plateaus(df, made, 5).collect()}
    assert found.keys() == want.keys()
    for k, w in want.items():
        assert found[k][0] == w[0] and found[k][1:] == pytest.approx(w[1:], rel=1e-6, abs=1e-6)
    dice = F.xxhash64(F.lit(7), "session_id", "segment", "ord")
    shuffled = {}
    for r in sorted(df.where("delta_l IS NOT NULL").select("session_id", "delta_l", "ord", dice.alias("d")).collect(), key=lambda r: (r.d, r.ord)):
        shuffled.setdefault(r.session_id, []).append(r.delta_l)
    expected = {s: (len(d), r2(np.cumsum(d))) for s, d in shuffled.items() if len(d) >= 15}
    drawn = {r.session_id: (r.n, r.r2) for r in corpus.permutation_r2(df, 7).collect()}
    assert drawn.keys() == expected.keys()
    assert all(drawn[s] == pytest.approx(expected[s], rel=1e-6) for s in expected)


def test_bootstrap_is_near_numpy(spark):
    ratios = [0.80 + 0.013 * i for i in range(20)]
    rows = [(i, r, r * (i + 1), float(i + 1)) for i, r in enumerate(ratios)]
    got = corpus.bootstrap_recovery(spark.createDataFrame(rows, "day long, usd_ratio double, usd_recon double, usd_bill double"), 10_000).first()
    pick = np.random.default_rng(5).integers(0, 20, (10_000, 20))
    x, weight = np.array(ratios), np.arange(1, 21)
    medians, whole = np.median(x[pick], axis=1), (x[pick] * weight[pick]).sum(axis=1) / weight[pick].sum(axis=1)
    assert got.n == 10_000
    assert [got.median_low, got.median_high] == pytest.approx(np.quantile(medians, [0.025, 0.975]), abs=0.01)
    assert [got.aggregate_low, got.aggregate_high] == pytest.approx(np.quantile(whole, [0.025, 0.975]), abs=0.01)


def tokens(text):
    wide = sum("　" <= c <= "鿿" or "가" <= c <= "힯" or "豈" <= c <= "﫿" for c in text)
    units = len(text.encode("utf-16-le")) // 2
    return (units - wide) / 2.45 + wide / 0.59


def test_tool_writes_match_a_sequential_ledger(spark, sf_dir):
    lines = sorted((r.session_id, r.ord, json.loads(r.line)) for r in tree_queries._lines(spark, sf_dir).distinct().collect())
    uses, done, ledger = {}, set(), {}
    for session, _, entry in lines:
        content = entry["message"]["content"]
        for block in content if isinstance(content, list) else ():
            if block["type"] == "tool_use":
                uses[session, block["id"]] = block
                continue
            use = uses.get((session, block["tool_use_id"]))
            if use is None or (session, use["id"]) in done:
                continue
            done.add((session, use["id"]))
            given, key = use["input"], (session, "/repo/" + use["input"]["file_path"])
            if use["name"] == "Write":
                numbered = [f"{i}\t{x}" for i, x in enumerate(given.get("content", "").split("\n"), 1)]
                ledger[key] = 90 + sum(map(tokens, numbered))  # what a write costs beside its lines
            else:
                old, new = given.get("old_string", ""), given.get("new_string", "")
                ledger[key] = max(0.0, ledger.get(key, 0.0) + tokens(new) - tokens(old) + (new.count("\n") - old.count("\n")) * 4 / 2.45)
    got = {(r.session_id, r.path): r.path_tokens for r in tree_queries.tool_writes(spark, sf_dir).collect()}
    assert got and got.keys() == ledger.keys()
    assert all(got[k] == pytest.approx(ledger[k], abs=1e-3) for k in got)


def test_turn_gate_against_its_rule(spark):
    """A turn notifies if it ends a run of ``DWELL`` turns at amber and, since the last notice, some turn was below amber by the hysteresis."""
    draw, rows, want = random.Random(4), [], {}
    for session in range(20):
        turn, seen = 0, []
        for o in range(60):
            turn += draw.choice([0, 1, 1, 1])
            br = draw.choice([None, 0.01, 0.05, 0.099, 0.1, 0.15, 0.15, 0.2, 0.3, 0.3])
            rows.append((session, 0, o, turn, br))
            want[session, o] = False
            if turn > (seen[-1][0] if seen else 0):
                seen.append((turn, br, False))
                run = [b is not None and b >= 0.10 for _, b, _ in seen[-billing.DWELL :]]
                last = max((i for i, x in enumerate(seen) if x[2]), default=None)
                low = last is None or any(b is not None and b < 0.10 - billing.HYSTERESIS for _, b, _ in seen[last + 1 :])
                want[session, o] = len(run) == billing.DWELL and all(run) and low
                seen[-1] = (turn, br, want[session, o])
    df = spark.createDataFrame(rows, "session_id long, segment long, ord long, turn_seq long, br double")
    assert {(r.session_id, r.ord): r.notify for r in billing.turn_gate(df).collect()} == want
    assert sum(want.values()) > 20
