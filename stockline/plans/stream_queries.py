"""Streams over the driver's tables, run to the end of their input, and the batch replay's profiles and status beside them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockline.operators import billing, profiles, replay
from stockline.sources import transcripts
from stockline.sources.shared import shared_folder
from stockline.streaming import fold, live, sinks

from .base import BACKSTOP_SQL, r6, usage, with_meter, with_positions
from .table_queries import PROFILE_COLUMNS, PROFILE_ROUNDED, PROFILES_SQL
from .tree_queries import _lines


def _rates():
    return F.lit(2.45), F.lit(0.59)


def _folder(spark) -> str:
    return os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")


#: Rows of a micro-batch: each batch loads and commits every store of the state, so their number must not grow with small files.
BATCH_ROWS = 4_000_000


def _streamed(spark, rows, folder: str):
    """A table as a stream of its files, about BATCH_ROWS rows in a micro-batch and 8 files at least."""
    rows.write.parquet(f"{folder}/in")
    written = spark.read.parquet(f"{folder}/in")
    each = written.count() / max(1, len(written.inputFiles()))
    return spark.readStream.schema(written.schema).option("maxFilesPerTrigger", max(8, int(BATCH_ROWS / max(1, each)))).parquet(f"{folder}/in")


def _run(stream, write, folder: str) -> None:
    query = fold.snapshot_sink(stream, write, None, f"{folder}/state")
    query.awaitTermination()


def stream_calls(spark, sf):
    """Calls of a stream of usage with segment, growth, meter, gate and backstop: what the batch windows give."""
    folder = _folder(spark)
    source = _streamed(spark, usage(spark, sf).repartition("session_id"), folder)
    _run(fold.stream_fold(source, timeout=False), lambda df, i: sinks.write_batch(df.where("kind = 'call'"), i, f"{folder}/calls"), folder)
    got = spark.read.parquet(f"{folder}/calls")
    return r6(got.select("session_id", "ord", "folded_seq", "turn_seq", "segment", "miss", "l", "g", "cycles", "progress", "deep_water", "gate_fires", "dw_bills", "laps", "backstop_fires"), "g", "progress")


def _ordered_lines(spark, sf):
    """Lines with places from 0 without gaps, as the live replay needs them."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ord", "line")) - 1
    return _lines(spark, sf).withColumn("ord", place.cast("long"))


LIVE = ("b", "deferred", "residual", "g", "burn", "progress")


def live_calls(spark, sf):
    """Each call of a stream of transcript lines: tree, folding, segments, tool events, B, settlement, growth, meter, alerts; as the batch replay gives it."""
    folder = _folder(spark)
    stream = live.live_replay(_streamed(spark, _ordered_lines(spark, sf), folder), *_rates(), timeout=False)
    _run(stream, lambda df, i: sinks.write_batch(df.where("kind IN ('call', 'rewind')"), i, f"{folder}/calls"), folder)
    rows = spark.read.parquet(f"{folder}/calls")
    # a rewind makes a session's earlier rows void
    last = F.max("rewinds").over(Window.partitionBy("session_id"))
    kept = rows.withColumn("_last", last).where("kind = 'call' AND rewinds = _last")
    return r6(kept.select("session_id", "folded_seq", "ord", "segment", "turn_seq", "miss", "l", "dead", *LIVE, "cycles", "deep_water", "gate_fires", "dw_bills", "laps", "backstop_fires"), *LIVE)


def _usage_lines(spark, sf):
    """Usage as transcript lines without a tree: a human's line before each call that follows a human turn."""
    rows = usage(spark, sf)
    said = rows.where("human_turn").select("session_id", "ord", F.lit(0).alias("part"), F.lit('{"type":"user","message":{"content":"hello"}}').alias("line"))
    counters = F.struct(F.col("cr").alias("cache_read_input_tokens"), F.col("cc").alias("cache_creation_input_tokens"), F.col("inp").alias("input_tokens"), F.col("outp").alias("output_tokens"))
    message = F.struct(F.col("message_id").alias("id"), "model", counters.alias("usage"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    calls = rows.select("session_id", "ord", F.lit(1).alias("part"), F.to_json(F.struct(F.lit("assistant").alias("type"), stamp.alias("timestamp"), message.alias("message"))).alias("line"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ord", "part")) - 1
    return said.unionByName(calls).select("session_id", place.cast("long").alias("ord"), "line")


def live_profiles(spark, sf):
    """Profiles of closed segments, from the tables that a stream of transcript lines fills batch by batch; as the batch profiles give them."""
    folder = _folder(spark)
    stream = live.live_packs(_streamed(spark, _usage_lines(spark, sf), folder), *_rates(), timeout=False)
    tables = sinks.LiveTables(spark, f"{folder}/tables", fold.unpacked(stream, live.CALL.format("long")).schema)
    _run(stream, tables.write, folder)
    return r6(tables.profiles().drop("batch", "at", "rewinds", "archive_source", "archive_priority"), *PROFILE_ROUNDED)


def _metered_replay(spark, sf):
    calls = replay.replay(transcripts.parse_entries(_ordered_lines(spark, sf)), *_rates())
    return billing.alert_gate(billing.bill_meter(calls))


def replay_profiles(spark, sf):
    """Segment profiles over replayed calls: B is B(t), not the floor."""
    found = profiles.segment_profiles(_metered_replay(spark, sf))
    return r6(found, *[f.name for f in found.schema if f.dataType.simpleString() == "double"])


def replay_status(spark, sf):
    """The last call of each session of the replay: position against B(t), meter, gate and backstop."""
    rows = billing.backstop(_metered_replay(spark, sf))
    last = rows.withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ord")))).where("_k = 1")
    cols = ("b", "g", "x", "dhat", "x_sweet", "burn", "mf", "br", "progress")
    return r6(last.select("session_id", "segment", "folded_seq", "turn_seq", "l", "dead", *cols, "deep_water", "cycles", "gate_open", "dw_bills", "laps"), *cols)


QUERIES = {
    "stream_calls": (stream_calls, with_meter(BACKSTOP_SQL + " SELECT session_id, ord, folded_seq, CAST(turn_seq AS BIGINT) AS turn_seq, CAST(segment AS BIGINT) AS segment, miss, l, round(g, 6) AS g, cycles, round(progress, 6) AS progress, deep_water, gate_fires, dw_bills, laps, backstop_fires FROM stop_v")),
    "live_calls": (live_calls, None),
    "live_profiles": (live_profiles, with_positions(f", {PROFILES_SQL} SELECT {PROFILE_COLUMNS.replace('b_total,', 'CAST(b_total AS DOUBLE) AS b_total,')} FROM profile_v WHERE segment < (SELECT max(segment) FROM calls_v c WHERE c.session_id = profile_v.session_id)")),
    "replay_profiles": (replay_profiles, None),
    "replay_status": (replay_status, None),
}
