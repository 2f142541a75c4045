"""Profiles of closed segments and the backstop: a stream in micro-batches gives what the batch operators give."""

import math

from pyspark.sql import functions as F

from stockline.operators import billing, calls, profiles
from stockline.sources import tables
from stockline.streaming import fold


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


def test_stream_gives_batch_profiles_and_backstop(spark, sf_dir, tmp_path):
    tables.usage_view(tables.read(spark, sf_dir, "events")).write.parquet(str(tmp_path / "usage"))
    usage = spark.read.parquet(str(tmp_path / "usage"))
    placed = billing.position(calls.analyse(usage))
    last = placed.groupBy("session_id").agg(F.max("segment").alias("last"))
    want = {(r.session_id, r.segment): r for r in profiles.segment_profiles(placed).join(last, "session_id").where("segment < last").collect()}
    stops = {(r.session_id, r.ord): r for r in billing.backstop(billing.alert_gate(billing.bill_meter(placed))).collect()}
    middle = usage.agg(F.median("ord").cast("long")).first()[0]
    for part in (f"ord < {middle}", f"ord >= {middle}"):
        usage.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows, closed = [], []

    def keep(df, _):
        df.persist()
        rows.extend(df.where("kind = 'call'").collect())
        closed.extend(fold.closed_profiles(df).collect())
        df.unpersist()

    assert fold.snapshot_sink(fold.stream_fold(stream, timeout=False), keep, None, str(tmp_path / "state")).awaitTermination(120)
    assert want and {(r.session_id, r.segment) for r in closed} == want.keys()
    for r in closed:
        w = want[r.session_id, r.segment]
        assert all(close(r[c], w[c]) for c in fold.PROFILE), (r, w)
    assert {(r.session_id, r.ord) for r in rows} == stops.keys()
    for r in rows:
        w = stops[r.session_id, r.ord]
        assert (r.dw_bills, r.laps, r.backstop_fires) == (w.dw_bills, w.laps, w.backstop_fires), (r, w)


def test_backstop_of_the_stream_fires_and_starts_anew(spark):
    from types import SimpleNamespace

    state, got = fold.fresh(), []
    for i in range(400):
        row = SimpleNamespace(ord=i, message_id=None, model="claude", cr=1000 + 4000 * i, cc=4000, inp=0, outp=1, human_turn=False)
        got += fold.step(1, state, row)
    fires = [x for x in got if x["backstop_fires"]]
    assert len(fires) > 2 and [x["laps"] for x in fires] == list(range(1, len(fires) + 1)) and all(x["dw_bills"] == 0 for x in fires)
