"""Segment profiles, telemetry tables, their upserts, and what to keep or replay.

Upserts are a union and one window: the winning row of each key. Tables are written by partition, so a
rewrite touches only partitions of keys that won.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = {"snapshot": 1, "replay": 2, "live": 3}
RETENTION_DAYS, HANDOFF_DAYS, MAX_REPLAY_BYTES = 7, 90, 50_000_000
SEGMENT = ["session_id", "segment"]


def segment_profiles(calls: DataFrame) -> DataFrame:
    """One row for each segment of positioned calls (session_id, segment, ord, ts, model, l, dead, g, r, mf, br, pp, x, ...)."""
    last = F.struct("model", "l", "g", "r", "mf", "br", "pp", "x", "dead", F.col("b" if "b" in calls.columns else "dead").alias("b"))
    rows = calls.groupBy(*SEGMENT).agg(
        F.max_by(last, "ord").alias("z"), F.countDistinct("turn_seq").alias("turns"), F.count("*").alias("n_calls"), (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("duration_ms"),
        F.sum(F.col("cr") + F.col("cc") + F.col("inp")).alias("total_tokens_read"), F.sum("outp").alias("total_output"), F.max("l").alias("l_peak"), F.max("br").alias("br_peak"), F.max("pp").alias("pp_peak"), F.min("g").alias("g_min"),
        F.min("turn_seq").alias("_t0"), F.min(F.when(F.col("br") >= 0.10, F.col("turn_seq"))).alias("_ta"),
    )
    z = lambda c: F.col(f"z.{c}")
    o_avg = F.col("total_output") / F.col("n_calls")
    return rows.select(
        *SEGMENT, z("model").alias("model"), z("dead").alias("l_floor"), z("b").alias("b_total"), "l_peak", z("g").alias("g_final"), o_avg.alias("o_avg"), z("r").alias("c_ratio"), "turns", "n_calls",
        "duration_ms", "total_tokens_read", z("mf").alias("mf"), z("pp").alias("pp_exit"), z("br").alias("br_exit"), "br_peak", "pp_peak", "g_min",
        (z("dead") / (z("r") * z("g"))).alias("p0"), (2 * o_avg / z("g")).alias("b_axis"), (F.col("l_peak") / z("dead")).alias("x_axis"), (F.col("_ta") - F.col("_t0")).alias("turn_at_br_amber"),
    )


def terminal_snapshot(profiles: DataFrame) -> DataFrame:
    """The last segment of each session."""
    return profiles.withColumn("_k", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("segment")))).where("_k = 1").drop("_k")


def list_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy("session_id", "segment")


def step_payload(calls: DataFrame) -> DataFrame:
    """One row for each folded_seq: the row with the most tokens, the later on a tie, and the first load token of any."""
    total = F.col("cr") + F.col("cc") + F.col("inp") + F.col("outp")
    row = F.struct("ts", "cr", "cc", "inp", "outp", "tool_calls")
    return calls.groupBy(*SEGMENT, "folded_seq").agg(F.max_by(row, F.struct(total, F.col("ord"))).alias("x"), F.max_by("load_token", F.when(F.col("load_token").isNotNull(), F.struct(total, F.col("ord")))).alias("load_token")).select(*SEGMENT, "folded_seq", "x.*", "load_token")


def upsert_profiles(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The row of the highest archive_priority for each segment; of equal ones the later write (write_ord)."""
    best = Window.partitionBy(*SEGMENT).orderBy(F.desc("archive_priority"), F.desc("write_ord"))
    return existing.unionByName(new, allowMissingColumns=True).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


merge_captures = upsert_profiles


def replace_profile_paths(existing: DataFrame, new: DataFrame, winners: DataFrame) -> DataFrame:
    """Paths of segments whose profile was written are replaced as a whole."""
    won = winners.select(*SEGMENT).distinct()
    return existing.join(won, SEGMENT, "left_anti").unionByName(new.join(won, SEGMENT, "left_semi"), allowMissingColumns=True)


def write_telemetry(existing: DataFrame, new: DataFrame, complete: DataFrame, key: tuple[str, ...] = ("session_id", "segment", "folded_seq")) -> tuple[DataFrame, DataFrame]:
    """Rows after the write, and the keys of new that repeat. Segments that are complete stay, all others of new are replaced."""
    taken = new.join(complete.select(*SEGMENT).distinct(), SEGMENT, "left_anti")
    repeated = taken.groupBy(*key).count().where("count > 1").drop("count")
    return existing.join(taken.select(*SEGMENT).distinct(), SEGMENT, "left_anti").unionByName(taken), repeated


def telemetry_status(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """complete, complete_empty, pending or failed_retryable for each segment (with ``ended`` and ``failed``)."""
    counts = steps.groupBy(*SEGMENT).agg(F.count("*").alias("n_steps"))
    rows = segments.join(counts, SEGMENT, "left").withColumn("n_steps", F.coalesce("n_steps", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("failed"), "failed_retryable").when(~F.col("ended"), "pending").when(F.col("n_steps") == 0, "complete_empty").otherwise("complete"))


def touch_sessions(rows: DataFrame) -> DataFrame:
    """Sessions from sightings (session_id, at, model, project_id): first and last time, the latest model and project that are known."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return rows.groupBy("session_id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"), known("model"), known("project_id"))


def migrate_profiles(old: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Profiles of an earlier table: segment 0, snapshot priority, and nulls for columns that are new."""
    rows = old
    for name, value in (("segment", F.lit(0).cast("long")), ("archive_source", F.lit("snapshot")), ("archive_priority", F.lit(PRIORITY["snapshot"]))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})


def sessions_needing_replay(profiles: DataFrame, live: DataFrame, limit: int = 200) -> DataFrame:
    """The oldest sessions with a segment whose telemetry isn't complete, without live ones."""
    waiting = profiles.where(F.col("status").isNull() | F.col("status").isin("pending", "failed_retryable")).groupBy("session_id").agg(F.max("updated_at").alias("updated_at"))
    return waiting.join(live.select("session_id").distinct(), "session_id", "left_anti").orderBy("updated_at", "session_id").limit(limit)


def retention_plan(sessions: DataFrame, live: DataFrame, now, days: int = RETENTION_DAYS, limit: int = 3) -> DataFrame:
    """The oldest idle sessions to archive and drop; files that are too large are archived from their snapshot."""
    idle = sessions.where(F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")).join(live.select("session_id").distinct(), "session_id", "left_anti")
    return idle.withColumn("source", F.when(F.col("n_bytes") > MAX_REPLAY_BYTES, "snapshot").otherwise("replay")).orderBy("updated_at", "session_id").limit(limit)


def expired_handoffs(handoffs: DataFrame, now, days: int = HANDOFF_DAYS) -> DataFrame:
    return handoffs.where(F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def median0(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Interpolated median, 0 without values."""
    return df.groupBy(*by).agg(F.coalesce(F.median(column), F.lit(0.0)).alias("median"))


def last_n(df: DataFrame, n: int, by: tuple[str, ...] = ("session_id",), order: str = "ord") -> DataFrame:
    """A ring of the last n rows of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_k") <= n).drop("_k")
