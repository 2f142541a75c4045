"""Upserts, telemetry, hand-overs, prices, ignore rules, file hashes and CSV sources on small rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stockline.functions import economics as E
from stockline.operators import billing, corpus, handoff, ledger, profiles
from stockline.sources import transcripts


def test_telemetry_upserts(spark):
    steps = "session_id long, segment long, folded_seq long, v long"
    old = spark.createDataFrame([(1, 0, 1, 10), (1, 1, 1, 11)], steps)
    new = spark.createDataFrame([(1, 0, 1, 20), (1, 1, 1, 21), (1, 1, 1, 22), (2, 0, 1, 30)], steps)
    complete = spark.createDataFrame([(1, 0)], "session_id long, segment long")
    rows, repeated = profiles.write_telemetry(old, new, complete)
    assert sorted(r.v for r in rows.collect()) == [10, 21, 22, 30]
    assert [tuple(r) for r in repeated.collect()] == [(1, 1, 1)]
    paths = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "session_id long, segment long, path string")
    fresh = spark.createDataFrame([(1, 1, "c"), (2, 0, "d")], "session_id long, segment long, path string")
    won = spark.createDataFrame([(1, 1)], "session_id long, segment long")
    assert sorted(r.path for r in profiles.replace_profile_paths(paths, fresh, won).collect()) == ["a", "c"]


def test_handoffs(spark):
    long = "x" * 10001
    rows = spark.createDataFrame([("ok", "t", ["a"]), (" ", "t", ["a"]), (long, "t", []), ("s", "n" * 2001, []), ("s", None, ["p"] * 51)], "summary string, next_task string, paths array<string>")
    assert [r.error for r in handoff.validate_handoffs(rows).collect()] == [None, "summary_missing", "summary_too_long", "next_task_too_long", "too_many_paths"]
    h = "handoff_id long, created_at string, delivered_at string, v long"
    old = spark.createDataFrame([(1, "1", "9", 1), (2, "1", None, 1)], h)
    new = spark.createDataFrame([(1, "2", None, 2), (2, "2", None, 2), (2, "3", None, 3), (3, "2", None, 2)], h)
    assert sorted((r.handoff_id, r.v) for r in handoff.upsert_handoffs(old, new).collect()) == [(1, 1), (2, 3), (3, 2)]
    loads = "handoff_id long, session_id long, loaded_at string"
    a, b = spark.createDataFrame([(1, 1, "x")], loads), spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 2, "x")], loads)
    assert handoff.append_loads(a, b).count() == 2
    kept = spark.createDataFrame([(1, 1, "./a.js", "/p"), (1, 2, "a.js", "/p"), (1, 3, "../b", "/p"), (1, 4, "gone.js", "/p")], "session_id long, ord long, path string, project_dir string")
    candidates = spark.createDataFrame([(1, "src/a.js", 5, 1)], "session_id long, path string, tokens long, last_ord long")
    assert {r.path: r.part for r in handoff.partition_kept(handoff.dedupe_kept(kept), candidates).collect()} == {"a.js": "resolved", "../b": "invalid", "gone.js": "unknown"}


def test_prices_and_ignore_rules(spark):
    price = "model string, read_price double, write_price double"
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    saved = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 1.0)], price)
    session = spark.createDataFrame([("b", 1.0, 2.0)], price)
    presets = spark.createDataFrame([("a", 1.0, 3.0), ("c", 1.0, 5.0)], price)
    got = {r.model: (r.ratio, r.source, r.drifted) for r in handoff.effective_price(models, saved, session, presets).collect()}
    assert got == {"a": (3.0, "saved", False), "b": (2.0, "session", True), "c": (5.0, "preset", False)}
    paths = spark.createDataFrame([("a.log",), ("keep.log",), ("x.js",)], "path string")
    rules = spark.createDataFrame([(1, r"\.log$", False), (2, "^keep", True)], "priority int, pattern string, negated boolean")
    assert {r.path: r.ignored for r in handoff.apply_ignore_rules(paths, rules).collect()} == {"a.log": True, "keep.log": False, "x.js": False}


def test_search_needs_all_terms(spark):
    docs = spark.createDataFrame([(1, "parser of tables", "x"), (2, "parser parser", "y"), (3, "日本語 tables parser", "z")], "handoff_id long, summary string, next_task string")
    got = handoff.search(docs, "parser tables").collect()
    assert {r.handoff_id for r in got} == {1, 3}
    assert [r.handoff_id for r in handoff.search(docs, "日本語").collect()] == [3]


def test_reasoning(spark):
    blocks = [(1, 1, 0, "tool", "a", 0), (1, 1, 1, "text", None, 10), (1, 1, 2, "tool", "a", 0), (1, 1, 3, "thinking", None, 5), (1, 1, 4, "tool", None, 0), (1, 1, 5, "text", None, 7), (1, 1, 6, "tool", "a", 0)]
    df = spark.createDataFrame(blocks, "session_id long, entry_ord long, block_pos int, kind string, path string, n_chars long")
    assert [(r.path, r.n_chars) for r in ledger.reasoning_spend(df).collect()] == [("a", 10)]
    spend = spark.createDataFrame([(1, 1, 5.0, 10), (1, 2, 8.0, 10), (1, 3, 0.0, 100)], "session_id long, ord long, spent double, l long")
    assert [r.dropped for r in ledger.reasoning_breaker(spend).orderBy("ord").collect()] == [False, True, True]


def test_search_spend_is_dealt_by_tokens(spark):
    rows = [(1, 1, "a", "lineUpdate", 30, 7, 50.0), (1, 1, "b", "lineUpdate", 10, 7, 50.0), (1, 2, "a", "editDelta", -4, None, None)]
    df = spark.createDataFrame(rows, "session_id long, ord long, path string, op string, tokens long, event_id long, event_spent double")
    assert {r.path: r.spent for r in ledger.touch_spend(df).collect()} == {"a": 41.5, "b": 12.5}


def test_sources(spark, tmp_path):
    (tmp_path / "bill.csv").write_text("﻿date,model,type,price,amount\n2026-06-09,deepseek-v4-pro,output_tokens,6e-6,100\n2026-06-09,deepseek-v4-pro,request_count,,3\n", encoding="utf-8")
    bill = transcripts.read_bill(spark, str(tmp_path / "bill.csv"))
    wide = billing.bill_wide(bill, "pro").first()
    assert (wide.bill_out, wide.bill_hit, wide.price_out) == (100, 0, 6e-6)
    (tmp_path / "f").mkdir()
    for name, content in {"a.txt": b"one\ntwo", "b.txt": b"", "c.txt": b"x\n"}.items():
        (tmp_path / "f" / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in transcripts.hash_files(spark, str(tmp_path / "f")).collect()}
    assert {k: r.n_lines for k, r in got.items()} == {"a.txt": 2, "c.txt": 1}  # the file source lists no empty files
    assert got["a.txt"].sha256 == hashlib.sha256(b"one\ntwo").hexdigest()
    files = spark.createDataFrame([("/r/s1.jsonl", 1), ("/q/s1.jsonl", 3), ("/r/s1/subagents/x.jsonl", 2)], "path string, mtime long")
    assert {(r.session_id, r.is_sub_agent): r.path for r in transcripts.discover_sessions(files).collect()} == {("s1", False): "/q/s1.jsonl", ("s1", True): "/r/s1/subagents/x.jsonl"}


def test_corpus_columns(spark):
    r = spark.range(1).select(
        E.effective_ratio(12.5, 0.2, 0.1).alias("r"), E.effective_order_quantity(10, 12.5, 0.5).alias("n"), E.revealed_value(1.5, 2.0, 100).alias("v"), E.stop_kind(F.lit(1.2), F.lit(True), F.lit(True)).alias("s"),
        *[c.alias(k) for k, c in E.cost_curve(20, 10, 1000, 50).items()], E.curve_points(1.1, 3, 4).alias("points"), E.next_threshold(F.lit(5), F.lit(3), F.lit(9), F.lit(20)).alias("t"),
        E.landmarks_ok(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("ok"), *[c.alias(k) for k, c in E.rent_meter(2, F.lit(0.3), 0.5, 12.5, F.lit(3)).items()],
    ).first()
    assert r.r == pytest.approx(12.5 / (1 + 0.2 * 0.9 * 11.5)) and r.v == 100 and r.s == "wall" and r.ok and r.depth_hot
    assert r.regret == pytest.approx(0) and r.n_star == pytest.approx(20) and r.t.kind == "amber"
    assert r.points[0] == pytest.approx(1.1) and r.points[-1] == pytest.approx(3) and 0 < r.depth_progress <= 1
    values = spark.createDataFrame([(float(i),) for i in (4, 1, 3, 2)], "v double")
    q = values.agg(*[c.alias(k) for k, c in corpus.order_statistics(F.col("v")).items()]).first()
    assert (q.p25, q.median, q.p75) == (2, 3, 4)
