"""A session from its transcript to its position: branches, calls, segments, tool events, B(t), settlement, growth.

The parts are those of ``tree``, ``calls``, ``tools``, ``ledger`` and ``billing``; here they are joined as a replay joins them:

1. entries in replay order (``tree.replay_plan``): the branch of each root, or the active branch; ``ord`` becomes the place in that order;
2. calls folded by id; the first call of a later root starts a segment and is never a miss;
3. tool results, matched with their use inside one segment, write lines of paths; each belongs to the next call of its segment;
4. B of a call is the floor and all paths that its segment has written before; its growth is settled against the growth of L,
   and what is left is the residual that growth is smoothed over.

A session is one window partition throughout, so each step is a shuffle by session at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.sources import transcripts
from stockline.sources.shared import cut_lineage

from . import billing, calls, ledger, tools, tree

SEGMENT = ["session_id", "segment"]


def in_replay_order(entries: DataFrame) -> DataFrame:
    """Entries that are replayed, with root_ord, ``line`` (their place in the file) and ``ord`` (their place in the replay)."""
    order = Window.partitionBy("session_id").orderBy("root_ord", "ord")
    return tree.replay_plan(entries).withColumn("_k", F.row_number().over(order).cast("long")).withColumn("line", F.col("ord")).withColumn("ord", F.col("_k")).drop("_k")


def segmented_calls(replayed: DataFrame) -> DataFrame:
    """Folded calls of the main chain with number, turn, miss, L, segment, floor and warm delta."""
    usage = calls.main_only(transcripts.extract_usage(replayed)).withColumn("message_id", transcripts.fold_key())
    folded = calls.fold_calls(usage).drop("cr", "cc", "inp").withColumnsRenamed({"first_cr": "cr", "first_cc": "cc", "first_inp": "inp"})
    places = replayed.select("session_id", "ord", "line", "root_ord", F.max(F.col("uuid").isNotNull()).over(Window.partitionBy("session_id")).alias("has_tree"))
    placed = folded.join(places, ["session_id", "ord"])
    later = F.coalesce(F.col("root_ord") > F.lag("root_ord").over(calls.by_session()), F.lit(False))
    numbered = calls.number_turns(calls.number_calls(placed.withColumn("root_start", later)))
    return calls.warm_delta_l(calls.segment_floor(calls.with_previous(calls.segment_calls(calls.effective_l(calls.classify_miss(numbered)), has_tree=F.col("has_tree")))))


def segment_of_entries(replayed: DataFrame, found: DataFrame) -> DataFrame:
    """session_id, ord, segment of each entry: that of the call before it in its root, or else of the next one there."""
    rows = replayed.select("session_id", "ord", "root_ord").join(found.select("session_id", "ord", "segment"), ["session_id", "ord"], "left")
    root = Window.partitionBy("session_id", "root_ord").orderBy("ord")
    before = F.last("segment", ignorenulls=True).over(root.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("session_id", "root_ord").orderBy(F.desc("ord"))
    after = F.last("segment", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("session_id", "ord", F.coalesce(before, after).alias("segment")).where("segment IS NOT NULL")


def tool_touches(replayed: DataFrame, found: DataFrame, ascii_ctp: Column, cjk_ctp: Column) -> DataFrame:
    """Lines that tool results write, with the segment: a result counts only in the segment of its use."""
    blocks = transcripts.blocks(replayed.where(~F.col("is_sidechain"))).join(segment_of_entries(replayed, found), ["session_id", "ord"])
    writes = tools.line_writes(tools.match_tool_results(blocks), ascii_ctp, cjk_ctp)
    return writes.withColumn("line_no", F.coalesce("line_no", F.lit(0)))


def credited(found: DataFrame, touches: DataFrame) -> DataFrame:
    """Calls with ``paths`` (what the segment's paths hold), ``db`` (their growth since the call before) and ``pos_total`` (that of the paths that grew)."""
    changes = ledger.path_ledger(touches).select(*SEGMENT, "ord", "path", "delta")
    met = ledger.assign_to_calls(changes, found.select("session_id", "ord", "folded_seq"), "next").where("folded_seq IS NOT NULL")
    by_path = met.groupBy(*SEGMENT, "folded_seq", "path").agg(F.sum("delta").alias("delta"))
    grown = by_path.groupBy(*SEGMENT, "folded_seq").agg(F.sum("delta").alias("_db"), F.sum(F.greatest(F.col("delta"), F.lit(0.0))).alias("_pos"))
    # an event before the first call of the next segment stays in its own segment, where no call sees it any more
    rows = found.join(grown, [*SEGMENT, "folded_seq"], "left").withColumn("_db", F.coalesce("_db", F.lit(0.0)))
    rows = rows.withColumn("paths", F.sum("_db").over(calls.so_far(calls.by_segment())))
    later = F.col("prev_l").isNotNull()
    return rows.withColumn("db", F.when(later, F.col("_db")).otherwise(0.0)).withColumn("pos_total", F.when(later, F.coalesce("_pos", F.lit(0.0))).otherwise(0.0)).drop("_db", "_pos")


def replay(entries: DataFrame, ascii_ctp: Column, cjk_ctp: Column) -> DataFrame:
    """One row for each call of each session: segment, L, miss, floor, B, deferred, residual, g and position against B."""
    replayed = cut_lineage(in_replay_order(entries))
    found = cut_lineage(segmented_calls(replayed))
    rows = credited(found, tool_touches(replayed, found, ascii_ctp, cjk_ctp))
    rows = rows.withColumn("b", F.coalesce("dead", F.lit(0)) + F.col("paths")).withColumn("dl", F.coalesce("delta_l", F.lit(0)))
    rows = ledger.settle_deferred(rows)
    rows = rows.withColumn("residual", F.when(F.col("prev_l").isNotNull(), F.col("residual")))
    return billing.position(calls.growth_ema(rows), "b")
