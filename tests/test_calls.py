"""Window forms against row-at-a-time folds written from the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stockline.functions import economics as E
from stockline.operators import billing, calls, ledger
from stockline.streaming import fold


def usage_rows(seed, sessions=6, n=60):
    rng, rows = random.Random(seed), []
    for s in range(sessions):
        stock = 20000
        for i in range(n):
            step = rng.randint(0, 3000)
            stock = 20000 if rng.random() < 0.05 else stock + step
            miss = rng.random() < 0.2
            cr, cc = (rng.choice([0, stock // 2]), stock) if miss else (max(0, stock - step), step)
            rows.append((s, i, f"2024-01-01 00:{i:02d}:00", f"m{s}-{i}", rng.choice(["claude-x", "deepseek-pro", "other"]), cr, cc, rng.randint(0, 40), rng.randint(0, 900), rng.random() < 0.3))
    return rows


SCHEMA = "session_id long, ord long, ts string, message_id string, model string, cr long, cc long, inp long, outp long, human_turn boolean"


def sequential(rows):
    """ord-wise (miss, l, segment, turn, g) for each session."""
    out, state = {}, {}
    for s, i, _, _, _, cr, cc, inp, _, human in rows:
        p = state.get(s, {"l": 0, "t": 0, "seg": 0, "turn": 0, "g": 100.0, "ceil": None, "new": True})
        t = cr + cc + inp
        if p["t"] > 0 and t < p["t"] - 100:
            p = {"l": 0, "t": 0, "seg": p["seg"] + 1, "turn": p["turn"], "g": 100.0, "ceil": None, "new": True}
        miss = p["l"] > 0 and cr < 0.95 * p["l"] and t >= p["t"] - 100
        length = cr + cc if miss else cr
        turn = p["turn"] + bool(human or s not in state)
        ceiling = p["ceil"] if p["ceil"] is not None else (t if max(cr, cc, inp) > 0 else None)
        g = p["g"]
        if not p["new"]:
            d = length - p["l"]
            if ceiling is not None and p["l"] < ceiling and d > 0:
                d = max(0, length - ceiling)
            g = 0.12 * max(d, 0) + 0.88 * g
        state[s] = {"l": length, "t": t, "seg": p["seg"], "turn": turn, "g": g, "ceil": ceiling, "new": False}
        out[s, i] = (miss, length, p["seg"], turn, g)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_calls_match_a_sequential_fold(spark, seed):
    rows = usage_rows(seed)
    want = sequential(rows)
    usage = spark.createDataFrame(rows, SCHEMA)
    for r in calls.analyse(usage).collect():
        miss, length, segment, turn, g = want[r.session_id, r.ord]
        assert (r.miss, r.l, r.segment, r.turn_seq) == (miss, length, segment, turn), r
        assert math.isclose(r.g_ema, g, rel_tol=1e-9)


def test_stream_gives_what_batch_gives(spark, tmp_path):
    rows = usage_rows(3, 4, 50)
    usage = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts"))
    batch = billing.alert_gate(billing.bill_meter(billing.position(calls.analyse(usage))))
    want = {(r.session_id, r.ord): r for r in batch.collect()}
    for part in range(3):
        usage.where(f"ord div 17 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    query = fold.snapshot_sink(fold.stream_fold(stream, timeout=False), lambda df, _: got.extend(df.collect()), None, str(tmp_path / "state"))
    assert query.awaitTermination(120)
    made = {(r.session_id, r.ord): r for r in got if r.kind == "call"}
    assert made.keys() == want.keys()
    for k, r in made.items():
        w = want[k]
        assert (r.l, r.miss, r.segment, r.turn_seq, r.folded_seq, r.deep_water, r.gate_fires) == (w.l, w.miss, w.segment, w.turn_seq, w.folded_seq, w.deep_water, w.gate_fires)
        assert math.isclose(r.g, w.g, rel_tol=1e-9) and abs(r.cycles + r.progress - w.cycles - w.progress) < 1e-4
    assert sum(r.kind == "closed" for r in got) == sum(1 for r in want.values() if r.boundary)


def test_stream_revisions():
    from types import SimpleNamespace

    state = fold.fresh()
    row = lambda o, out: SimpleNamespace(ord=o, message_id="a", model="claude", cr=10, cc=20, inp=1, outp=out, human_turn=False)
    kinds = [x["kind"] for o, out in ((1, 5), (2, 3), (3, 9)) for x in fold.step(1, state, row(o, out))]
    assert kinds == ["call", "revision"]


def test_meter_gate_and_backstop(spark):
    rates = [0.4, 0.6, 0.8, 5.0, 5.0, None, 0.2, 0.4]
    rows = [(1, 0, i, r, r is not None and r >= 0.6, 0.3) for i, r in enumerate(rates)]
    df = spark.createDataFrame(rows, "session_id long, segment long, ord long, burn double, deep_water boolean, mf double")
    got = billing.backstop(billing.alert_gate(billing.bill_meter(df))).orderBy("ord").collect()
    assert [(r.cycles, round(r.progress, 6)) for r in got[:5]] == [(0, 0.0), (0, 0.5), (1, 0.2), (4, 0.1), (9, 0.1)]
    assert got[6].cycles == 9 and round(got[7].progress, 6) == 0.4
    assert [r.gate_fires for r in got].count(True) == 1 and got[3].gate_fires
    interval = got[4].mf and spark.range(1).select(E.backstop_interval(F.lit(0.3)).alias("x")).first().x
    assert got[4].backstop_fires == (5 >= interval)


def test_turn_gate(spark):
    br = [0.2, 0.2, 0.2, 0.2, 0.05, 0.2, 0.2, 0.2, None, 0.2]
    df = spark.createDataFrame([(1, 0, i, i + 1, b) for i, b in enumerate(br)], "session_id long, segment long, ord long, turn_seq long, br double")
    got = [r.notify for r in billing.turn_gate(df).orderBy("ord").collect()]
    assert got == [False, False, True, False, False, False, False, True, False, False]


def test_settlement_matches_a_sequential_ledger(spark):
    rng, rows, want = random.Random(4), [], {}
    for s in range(5):
        bank = {"a": 0.0, "b": 0.0}
        for i in range(80):
            da, db_ = rng.choice([0, 0, 50, 300, -40]), rng.choice([0, 20, 100])
            dl = rng.choice([0, 10, 120, 400, -30])
            delta_b, up = da + db_, max(0, dl)
            pos = max(da, 0) + max(db_, 0)
            banked = min(max(delta_b - up, 0), pos)
            total = sum(bank.values())
            retired = min(total, max(up - delta_b, 0))
            for p, d in (("a", da), ("b", db_)):
                bank[p] = bank[p] * (1 - retired / total if total else 1) + (banked * max(d, 0) / pos if pos else 0)
            want[s, i] = (max(up - delta_b, 0) - retired, sum(bank.values()))
            rows += [(s, 0, i, p, float(d), float(delta_b), float(dl), float(pos)) for p, d in (("a", da), ("b", db_))]
        want[s] = dict(bank)
    df = spark.createDataFrame(rows, "session_id long, segment long, ord long, path string, delta double, db double, dl double, pos_total double")
    deltas = df.select("session_id", "segment", "ord", "db", "dl", "pos_total").distinct()
    for r in ledger.settle_deferred(deltas).collect():
        assert r.residual == pytest.approx(want[r.session_id, r.ord][0], abs=1e-6) and r.deferred == pytest.approx(want[r.session_id, r.ord][1], abs=1e-6)
    for r in ledger.settle_by_path(deltas, df).collect():
        assert r.deferred == pytest.approx(want[r.session_id][r.path], abs=1e-6)


def test_identities(spark):
    grid = spark.range(1, 60).select((1 + F.col("id") / 10).alias("x"), F.lit(12.5).alias("r"), (F.col("id") * 1000).cast("double").alias("b"), F.lit(700.0).alias("g"))
    d, mf = E.dhat(F.col("r"), F.col("g"), F.col("b")), E.movable_frac(F.col("r"), F.col("b"), F.col("g"))
    rows = grid.select("*", d.alias("d"), mf.alias("mf"), E.bill_regret(F.col("x"), d, mf).alias("br"), E.burn_rate(F.col("x") * F.col("b"), F.col("b"), F.col("r")).alias("burn"), E.h_break(F.col("r"), F.col("b"), F.col("x") * F.col("b")).alias("h"), E.x_at_regret(0.1, d, mf).alias("xr"), E.x_at_regret(0.1, d, mf, "left").alias("xl")).collect()
    for r in rows:
        assert r.mf <= math.sqrt(2) - 1 + 1e-12 and r.br >= 0
        assert r.burn == pytest.approx(1 / r.h) == pytest.approx((r.x - 1) / r.r)
        for x in (r.xr, r.xl):
            u = (x - 1) / r.d
            assert r.mf * (u - 1) ** 2 / (2 * u) == pytest.approx(0.1)
    one = spark.range(1).select(E.movable_frac(10, 80000, 684).alias("a"), E.bill_regret(1 + 0.3, 0.3, 0.2).alias("zero"), E.dhat(0, 1, 1).alias("none")).first()
    assert one.a == pytest.approx(0.28, abs=0.01) and one.zero == pytest.approx(0) and one.none == 0
