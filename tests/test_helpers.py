"""Operators that other jobs call: skills, load tokens, late results, anchors, retention, files, ledger rows."""

import datetime

from pyspark.sql import functions as F

from stockline.operators import billing, corpus, handoff, profiles, tools
from stockline.sources import transcripts as T
from stockline.streaming import fold


def test_tool_event_helpers(spark):
    events = spark.createDataFrame([(1, "t1", 5, "mcp__x__load_handoff", '{"load_token":"abc"}'), (1, "t2", 6, "Read", "x")], "session_id long, id string, folded_seq long, name string, result_text string")
    entries = spark.createDataFrame([(1, 3, True, "t2", '[{"type":"text","text":"skill body"}]'), (1, 4, True, "t2", "later")], "session_id long, ord long, is_meta boolean, source_tool_use_id string, content string")
    assert {r.id: r.skill_text for r in tools.attach_skill_content(events, entries).collect()} == {"t1": None, "t2": "skill body"}
    steps = spark.createDataFrame([(1, 5, None), (1, 6, "own")], "session_id long, folded_seq long, load_token string")
    assert {r.folded_seq: r.load_token for r in tools.backfill_load_tokens(steps, events).collect()} == {5: "abc", 6: "own"}
    uses = spark.createDataFrame([(1, "a", 1), (1, "b", 4), (1, "c", 5)], "session_id long, id string, turn_seq long")
    now = spark.createDataFrame([(1, 5)], "session_id long, turn_seq long")
    assert [r.id for r in tools.drop_unanswered(uses, uses.where("id = 'c'"), now).collect()] == ["b"]
    results = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "session_id long, id string, segment long")
    assert [r.id for r in fold.discard_stale(results, results.withColumn("segment", F.lit(1).cast("long"))).collect()] == ["b"]


def test_anchors_and_sweep(spark):
    samples = spark.createDataFrame([(1, 1, "k", 1), (1, 2, "k", 2), (1, 3, "m", 3), (1, 4, "m", 1), (1, 5, "m", 2)], "session_id long, ord long, state_key string, seq long")
    assert [r.anchor for r in fold.reanchor(samples).orderBy("ord").collect()] == [True, False, True, True, False]
    usage = spark.createDataFrame([(s, i, datetime.datetime(2024, 1, 1), "claude", 1000 * i, 100, 1, 1, i == 1) for s in (1, 2) for i in (1, 2, 3)], "session_id long, ord long, ts timestamp, model string, cr long, cc long, inp long, outp long, human_turn boolean")
    got = fold.sweep(usage, spark.createDataFrame([(2,)], "session_id long")).collect()
    assert {r.session_id for r in got} == {2} and [r.folded_seq for r in sorted(got, key=lambda r: r.ord)] == [1, 2, 3]


def test_profiles_and_handoffs(spark):
    rows = spark.createDataFrame([(2, 0), (1, 1), (1, 0)], "session_id long, segment long")
    assert [tuple(r) for r in profiles.list_profiles(rows).collect()] == [(1, 0), (1, 1), (2, 0)]
    made = spark.createDataFrame([(1, datetime.datetime(2020, 1, 1), 7), (2, datetime.datetime(2024, 5, 1), 8)], "handoff_id long, created_at timestamp, project_id long")
    assert [r.handoff_id for r in profiles.expired_handoffs(made, "2024-05-02").collect()] == [1]
    hits = spark.createDataFrame([(0, 1, 1, 0.5), (0, 2, 2, 0.4)], "query_id long, handoff_id long, rank int, score double")
    assert [r.handoff_id for r in handoff.search_join(hits, made, 8).collect()] == [2] and handoff.search_join(hits, made).count() == 2


def test_ledger_rows_and_linearity(spark):
    row = "bill_progress double, bill_cycles long, dw_bills long, laps long, last_seq long, paused_reason string, recent_events array<string>"
    rows = spark.createDataFrame([(0.5, 0, 0, 0, 1, None, []), (1.0, -1, 0, None, 1, "nonsense", ["x"] * 33)], row).select(billing.ledger_errors().alias("e")).collect()
    assert rows[0].e == [] and set(rows[1].e) == {"bill_progress", "bill_cycles", "laps", "paused_reason", "recent_events"}
    fits = spark.createDataFrame([(0.5, 10), (0.9, 30)], "r2 double, n long")
    got = corpus.linearity_summary(fits).first()
    assert (got.n_segments, round(got.weighted_r2, 6), got.median) == (2, 0.8, 0.7)


def test_files(spark, tmp_path):
    usage = f"{tmp_path}/usage"
    rows = [("2024-01-01T00:00:00Z", "s", 1, "deepseek-v4-pro", "pro", 1, 2, 3, 4)]
    columns = "ts string, session string, seq long, model string, tier string, cache_read long, cache_creation long, input long, output long"
    spark.createDataFrame(rows, columns).write.csv(usage, header=True)
    assert [tuple(r) for r in T.read_usage(spark, usage).collect()] == rows
    days = spark.createDataFrame([("2024-01-01", 0.5)], "day string, hit_ratio double")
    T.write_daily(days, f"{tmp_path}/daily")
    assert spark.read.csv(f"{tmp_path}/daily", header=True).first().hit_ratio == "0.5"
    T.write_usage(days, f"{tmp_path}/washed")
    assert spark.read.parquet(f"{tmp_path}/washed").count() == 1
    files = spark.createDataFrame([("/p/a.jsonl", 1), ("/p/b.jsonl", 3), ("/p/a.jsonl", 2)], "path string, mtime long")
    assert T.latest_transcript(files).first().path == "/p/b.jsonl"


def test_streams_of_entries(spark, tmp_path):
    lines = f"{tmp_path}/lines"
    text = ['{"type":"user","uuid":"a","parentUuid":null,"message":{"content":"x"}}', '{"type":"user","uuid":"b","parentUuid":"a","message":{"content":"x"}}', '{"type":"user","uuid":"c","parentUuid":"a","message":{"content":"x"}}']
    spark.createDataFrame([(1, i, x) for i, x in enumerate(text)] + [(2, i, x) for i, x in enumerate(text[:2])], "session_id long, ord long, line string").coalesce(1).write.parquet(lines)
    source = spark.readStream.schema("session_id long, ord long, line string").parquet(lines)
    out = f"{tmp_path}/queue"
    query = fold.replay_queue(fold.stream_entries(source)).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(1, 1)]


def test_stream_of_daily_snapshots(spark, tmp_path):
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    rows = [(1, "m", 1, at(1, 1), "pro", 1, 1, 1, 1), (1, "m", 2, at(1, 2), "pro", 5, 1, 1, 9), (1, "n", 3, at(2, 1), "pro", 7, 1, 1, 1)]
    spark.createDataFrame(rows, "session_id long, message_id string, ord long, ts timestamp, model string, cr long, cc long, inp long, outp long").coalesce(1).write.parquet(f"{tmp_path}/u")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/u").schema).parquet(f"{tmp_path}/u")
    out = f"{tmp_path}/d"
    query = fold.stream_fold_daily(source).writeStream.outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((str(r.day), r.message_id, r.cr, r.outp) for r in spark.read.parquet(out).collect()) == [("2024-01-01", "m", 5, 9), ("2024-01-02", "n", 7, 1)]
