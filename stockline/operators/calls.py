"""From usage snapshots to API calls: folding, numbering, cache misses, segments, growth.

Tables have session_id, ord (a total order within the session), ts, model, cr (cache read), cc (cache creation), inp, outp
and human_turn. Every window is partitioned by session, so one shuffle by session serves all of them. The rules that
depend on the row before them are written as prefix operations: no row-at-a-time state, no collected session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISS_DROP, STOCK_EPSILON = 0.95, 100
EMA_ALPHA, EMA_SEED, EMA_FLOOR = 0.12, 100.0, 100.0


def by_session():
    return Window.partitionBy("session_id").orderBy("ord")


def by_segment():
    return Window.partitionBy("session_id", "segment").orderBy("ord")


def so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def total_stock() -> Column:
    return F.col("cr") + F.col("cc") + F.col("inp")


def keep_usage(usage: DataFrame) -> DataFrame:
    """Without synthetic models and rows whose four counters are all zero."""
    return usage.where((F.coalesce("model", F.lit("")) != "<synthetic>") & (F.col("cr") + F.col("cc") + F.col("inp") + F.col("outp") > 0))


def main_only(usage: DataFrame) -> DataFrame:
    """Without rows of side chains."""
    return usage.where(~F.coalesce("is_sidechain", F.lit(False)))


def since(usage: DataFrame, ts) -> DataFrame:
    return usage.where(F.col("ts") >= F.lit(ts))


def fold_calls(usage: DataFrame, rule: str = "max_total", key: str = "message_id", scope: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One row for each call id; rows without an id are calls of their own.

    max_total: the accepted revision has the most tokens, the latest on a tie; place, cr, cc and inp for L are those of the first.
    last: the last snapshot. ``first_*`` are the first snapshot's counters.
    """
    own = F.coalesce(F.col(key), F.concat(F.lit("row:"), F.col("ord").cast("string")))
    row = F.struct("ts", "model", "cr", "cc", "inp", "outp")
    size = F.col("cr") + F.col("cc") + F.col("inp") + F.col("outp")
    by = F.struct(size, F.col("ord")) if rule == "max_total" else F.col("ord")
    turn = [F.max("human_turn").alias("human_turn")] if "human_turn" in usage.columns else []
    folded = usage.withColumn("call_id", own).groupBy(*scope, "call_id").agg(
        F.min("ord").alias("ord"), F.max_by(row, by).alias("x"), F.min_by(row, "ord").alias("y"), F.count("*").alias("n_snapshots"), *turn
    )
    return folded.select(*scope, "call_id", "ord", "x.*", F.col("y.cr").alias("first_cr"), F.col("y.cc").alias("first_cc"), F.col("y.inp").alias("first_inp"), "n_snapshots", *(["human_turn"] if turn else []))


def number_calls(calls: DataFrame) -> DataFrame:
    return calls.withColumn("folded_seq", F.row_number().over(by_session()))


def number_turns(calls: DataFrame) -> DataFrame:
    """turn_seq grows at the first call and at each call that follows a human turn."""
    bump = F.when((F.row_number().over(by_session()) == 1) | F.coalesce("human_turn", F.lit(False)), 1).otherwise(0)
    return calls.withColumn("bump", bump).withColumn("turn_seq", F.sum("bump").over(so_far(by_session()))).drop("bump")


def classify_miss(calls: DataFrame, drop: float = MISS_DROP, eps: int = STOCK_EPSILON) -> DataFrame:
    """Adds ``miss``: the cache read fell below ``drop`` of the previous L although the stock did not fall.

    The previous L depends on whether the previous call missed. For each row both outcomes are computed: where they agree the row
    decides, where they differ the row repeats the one before, so the answer is the last row that decides.
    ``root_start`` (optional) marks calls that start another conversation root: they never miss.
    """
    before = lambda c: F.coalesce(F.lag(c).over(by_session()), F.lit(0))
    stays = total_stock() >= before(total_stock()) - eps
    if "root_start" in calls.columns:
        stays = stays & ~F.coalesce("root_start", F.lit(False))
    fell = lambda length: (length > 0) & (F.col("cr") < drop * length) & stays
    rows = calls.withColumn("_hit", fell(before("cr"))).withColumn("_miss", fell(before(F.col("cr") + F.col("cc"))))
    decided = F.when(F.col("_hit") == F.col("_miss"), F.col("_hit"))
    return rows.withColumn("miss", F.coalesce(F.last(decided, ignorenulls=True).over(so_far(by_session())), F.lit(False))).drop("_hit", "_miss")


def effective_l(calls: DataFrame) -> DataFrame:
    return calls.withColumn("l", F.when(F.col("miss"), F.col("cr") + F.col("cc")).otherwise(F.col("cr")))


def segment_calls(calls: DataFrame, eps: int = STOCK_EPSILON, drop: float = MISS_DROP, has_tree: bool | Column = False) -> DataFrame:
    """Adds ``boundary`` and ``segment``: a new context starts where the stock falls by more than eps, or at a later root.

    In sessions with a tree (``has_tree``, for all rows or by row) a fall that looks like an evicted cache is no boundary.
    """
    before = lambda c: F.coalesce(F.lag(c).over(by_session()), F.lit(0))
    fell = (before(total_stock()) > 0) & (total_stock() < before(total_stock()) - eps)
    if has_tree is not False:
        fell = fell & ~(F.lit(has_tree) & (before("l") > 0) & (F.col("cr") < drop * before("l")))
    if "root_start" in calls.columns:
        fell = fell | F.coalesce("root_start", F.lit(False))
    rows = calls.withColumn("boundary", fell)
    return rows.withColumn("segment", F.sum(F.col("boundary").cast("long")).over(so_far(by_session())))


def with_previous(calls: DataFrame) -> DataFrame:
    """Previous L and stock within the segment."""
    return calls.withColumn("prev_l", F.lag("l").over(by_segment())).withColumn("prev_stock", F.lag(total_stock()).over(by_segment()))


def segment_floor(calls: DataFrame) -> DataFrame:
    """Adds ``dead`` (largest counter of the segment's first call that has one) and ``ceiling`` (its stock)."""
    value = F.greatest("cr", "cc", "inp")
    whole = by_segment().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(F.when(value > 0, c), ignorenulls=True).over(whole)
    return calls.withColumn("dead", first(value)).withColumn("ceiling", first(total_stock()))


def warm_delta_l(calls: DataFrame) -> DataFrame:
    """Adds ``delta_l``; while L is below the warm-up ceiling only growth above it counts. Null at a segment's first call."""
    delta = F.col("l") - F.col("prev_l")
    return calls.withColumn("delta_l", F.when((F.col("prev_l") < F.col("ceiling")) & (delta > 0), F.greatest(F.lit(0), F.col("l") - F.col("ceiling"))).otherwise(delta))


def growth_ema(calls: DataFrame, residual: str = "residual", alpha: float = EMA_ALPHA, seed: float = EMA_SEED, floor: float = EMA_FLOOR, chunk: int = 256) -> DataFrame:
    """Adds ``g_ema`` and ``g``: exponential smoothing as a prefix sum. A row without a residual (a segment's first call) holds the seed.

    Inside a chunk of rows g = q^j * (sum of alpha * r * q^-i for i <= j) with q = 1 - alpha; from chunk to chunk it is carried on with
    q^j, where what lies two chunks back weighs less than 1e-28.
    """
    q, r = 1 - alpha, F.col(residual).cast("double")
    rows = calls.withColumn("_reset", F.sum(r.isNull().cast("long")).over(so_far(by_segment())))
    run = Window.partitionBy("session_id", "segment", "_reset").orderBy("ord")
    rows = rows.withColumn("_k", F.row_number().over(run) - 1).withColumn("_j", F.col("_k") % chunk).withColumn("_chunk", F.floor(F.col("_k") / chunk))
    term = F.when(r.isNull(), F.lit(float(seed))).when(F.col("_k") == 0, alpha * r + q * seed).otherwise(alpha * r) * F.pow(F.lit(q), -F.col("_j"))
    own = F.sum(term).over(so_far(Window.partitionBy("session_id", "segment", "_reset", "_chunk").orderBy("ord"))) * F.pow(F.lit(q), F.col("_j"))
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    at_end = lambda c: F.coalesce(F.last(F.when(F.col("_j") == chunk - 1, F.col(c)), ignorenulls=True).over(earlier), F.lit(0.0))
    rows = rows.withColumn("_own", own).withColumn("_whole", F.col("_own") + F.lit(q**chunk) * at_end("_own"))
    rows = rows.withColumn("g_ema", F.col("_own") + F.pow(F.lit(q), F.col("_j") + 1) * at_end("_whole"))
    return rows.drop("_reset", "_k", "_j", "_chunk", "_own", "_whole").withColumn("g", F.greatest("g_ema", F.lit(floor)))


def analyse(usage: DataFrame) -> DataFrame:
    """Calls with number, turn, miss, L, segment, floor, warm delta. B is the floor and the residual is the growth of L."""
    calls = number_turns(number_calls(usage))
    calls = segment_calls(effective_l(classify_miss(calls)))
    calls = warm_delta_l(segment_floor(with_previous(calls)))
    calls = calls.withColumn("residual", F.when(F.col("delta_l").isNotNull(), F.greatest(F.col("delta_l"), F.lit(0)).cast("double")))
    return growth_ema(calls)


def history(calls: DataFrame) -> DataFrame:
    """ts, segment, L, B, x = L / B (1 without B), g, miss, counters, turn and number of each call."""
    b = F.coalesce(F.least("b", total_stock()), F.lit(0)) if "b" in calls.columns else F.coalesce("dead", F.lit(0))
    return calls.select("session_id", "folded_seq", "ts", "segment", "l", b.alias("b"), F.when(b > 0, F.col("l") / b).otherwise(1.0).alias("x"), F.coalesce("g", F.lit(0.0)).alias("g"), "miss", "cr", "cc", "turn_seq")


def series_peak(calls: DataFrame) -> DataFrame:
    """Largest L of each session, 1 at least."""
    return calls.groupBy("session_id").agg(F.greatest(F.max("l"), F.lit(1)).alias("peak"), F.count_if("miss").alias("n_misses"))


def project_growth(status: DataFrame, horizon, ceiling) -> DataFrame:
    """End point (x, l) of a straight line from each session's last call; a line that meets the ceiling ends there."""
    far = F.when(F.lit(horizon) - F.col("folded_seq") < 5, F.col("folded_seq") + 20).otherwise(F.lit(horizon))
    reach = F.col("l") + F.col("g") * (far - F.col("folded_seq"))
    capped = F.least(reach, F.lit(ceiling).cast("double"))
    end = F.when(capped < reach, F.col("folded_seq") + (capped - F.col("l")) / F.col("g")).otherwise(far.cast("double"))
    return status.where("g > 0").select("session_id", F.col("folded_seq").alias("x0"), F.col("l").alias("l0"), end.alias("x1"), capped.alias("l1"))


def segment_peaks(calls: DataFrame) -> DataFrame:
    """Running peaks of each segment, and the first relative turn with a regret of 0.10 or more."""
    w = so_far(by_segment())
    turn = F.col("turn_seq") - F.min("turn_seq").over(w)
    return (
        calls.withColumn("turn_rel", turn)
        .withColumn("l_peak", F.max("l").over(w)).withColumn("br_peak", F.max("br").over(w)).withColumn("pp_peak", F.max("pp").over(w))
        .withColumn("g_min", F.min("g").over(w)).withColumn("turn_at_br_amber", F.min(F.when(F.col("br") >= 0.10, F.col("turn_rel"))).over(w))
    )


def fold_effect(usage: DataFrame, key: str = "message_id") -> DataFrame:
    """Rows over calls, and the over-estimate of the stock without folding."""
    calls = fold_calls(usage, key=key)
    raw = usage.agg(F.count("*").alias("n_rows"), F.sum(total_stock()).alias("stock_rows"))
    folded = calls.agg(F.count("*").alias("n_calls"), F.sum(total_stock()).alias("stock_calls"))
    return raw.join(folded).select("n_rows", "n_calls", (F.col("n_rows") / F.col("n_calls")).alias("row_factor"), (F.col("stock_rows") / F.col("stock_calls")).alias("stock_factor"))
