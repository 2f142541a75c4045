"""Steps whose cost must grow no faster than the rows of a session."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from stockline.operators import latch, ledger

#: A frame that begins at the row and ends at the last row is computed anew for each row.
QUADRATIC = re.compile(r"specifiedwindowframe\(RowFrame, (?!unboundedpreceding)[^,]+, unboundedfollowing", re.I)


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_no_frame_runs_to_the_last_row(spark, monkeypatch):
    deltas = spark.createDataFrame([(1, 1, 5.0, 0.0, 5.0), (1, 2, 0.0, 2.0, 0.0)], "session_id long, ord long, db double, dl double, pos_total double")
    paths = spark.createDataFrame([(1, 1, "a", 5.0)], "session_id long, ord long, path string, delta double")
    settled = ledger.settle_by_path(deltas, paths)
    assert not QUADRATIC.search(_plan(settled))
    assert [(r.path, round(r.deferred, 9)) for r in settled.collect()] == [("a", 3.0)]
    events = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 4, "c"), (1, 9, "d")], "session_id long, ord long, name string")
    calls = spark.createDataFrame([(1, 2, 1), (1, 4, 2)], "session_id long, ord long, folded_seq int")
    for side, want in (("next", {"a": 1, "b": 2, "c": 2, "d": None}), ("previous", {"a": None, "b": 1, "c": 2, "d": 2})):
        got = ledger.assign_to_calls(events, calls, side)
        assert not QUADRATIC.search(_plan(got))
        assert {r.name: r.folded_seq for r in got.collect()} == want
    blocks = spark.createDataFrame([(1, 1, 1, "tool", "a", 0), (1, 1, 2, "text", None, 7), (1, 1, 3, "tool", "a", 0)], "session_id long, entry_ord long, block_pos long, kind string, path string, n_chars long")
    assert not QUADRATIC.search(_plan(ledger.reasoning_spend(blocks)))
    plans, cut = [], latch.cut_lineage
    monkeypatch.setattr(latch, "cut_lineage", lambda df: plans.append(_plan(df)) or cut(df))
    rows = spark.range(1, 40).select(F.lit(1).alias("session_id"), F.col("id").alias("ord"), F.col("id").cast("double").alias("need"), (F.col("id") - 5.0).alias("reach"))
    fired = latch.fires(rows, ("session_id",), spark.createDataFrame([(1, 0.0)], "session_id int, need double"))
    assert sorted(r.ord for r in fired.collect()) == [5, 10, 15, 20, 25, 30, 35]
    assert plans and not any(QUADRATIC.search(p) for p in plans)


def test_touches_are_dealt_by_more_than_the_session(spark, sf_dir, monkeypatch):
    """All rows of one session, and rows without a key, in more than one chunk: numbered as by one window, and in tasks of few rows."""
    from pyspark.sql import Window

    from stockline.sources import tables

    monkeypatch.setattr(tables, "TOUCH_ROWS", 500)
    one = tables.read(spark, sf_dir, "lineitem").withColumn("l_orderkey", F.when(F.col("l_orderkey") % 50 != 7, F.col("l_orderkey") * 200))
    got = tables.touch_view(one)
    rows = got.count()
    assert got.rdd.getNumPartitions() == -(-rows // 500)
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < rows / 3
    order = Window.partitionBy(F.col("l_orderkey") % 200).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    want = one.select((F.col("l_orderkey") % 200).alias("session_id"), F.row_number().over(order).cast("long").alias("ord"), F.col("l_quantity").cast("long").alias("line_no"), F.floor(F.col("l_extendedprice") / 100).cast("long").alias("tokens"))
    assert want.exceptAll(got.select(want.columns)).isEmpty() and want.count() == rows
    assert got.where("session_id IS NULL").agg(F.min("ord") == 1, F.max("ord") == F.count("*")).first() == (True, True)


def test_touches_without_an_order_meet_no_counts(spark, sf_dir, monkeypatch):
    """A join with the counts of chunks would deal all rows by spark.sql.shuffle.partitions, whatever the rows of a task should be."""
    from stockline.plans import table_queries
    from stockline.sources import tables

    monkeypatch.setattr(tables, "TOUCH_ROWS", 500)
    lineitem = tables.read(spark, sf_dir, "lineitem")
    touches = tables.touch_view(lineitem)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Join" in _plan(touches)
        assert "Join" not in _plan(touches.select("session_id", "path", "line_no").distinct())
        assert "Join" not in _plan(table_queries._kept(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    keys = ["session_id", "path"]
    # rows without a key or a flag have their paths, too
    odd = lineitem.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 50 != 7, F.col("l_orderkey"))).withColumn("l_returnflag", F.when(F.col("l_partkey") % 9 != 2, F.col("l_returnflag")))
    got, want = tables.path_view(odd), tables.touch_view(odd).where("ord > 0").select(keys).distinct()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.where("session_id IS NULL").count() > 1 and got.where("path IS NULL").count() > 1


def test_usage_is_dealt_in_tasks_of_few_rows(spark, sf_dir, monkeypatch):
    from stockline.sources import tables

    monkeypatch.setattr(tables, "USAGE_ROWS", 100)
    events = tables.read(spark, sf_dir, "events")
    assert tables.usage_view(events).rdd.getNumPartitions() == max(4, -(-events.count() // 100))


def test_backstop_starts_from_a_checkpoint(spark, sf_dir):
    from stockline.operators import billing
    from stockline.plans import base

    plan = _plan(billing.backstop(base.metered(spark, sf_dir)))
    assert "ExistingRDD" in plan and "parquet" not in plan.lower()
