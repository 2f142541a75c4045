"""Path ledger: what each file, tool and skill holds of the context, and what was spent on it.

``touches``: session_id, segment, ord, path, op (fullSet, write, lineUpdate, editDelta), line_no, tokens (and optionally overhead, spent).
One row is one line that an operation wrote; rows of one operation share ord. The ledger is a long table of
changes: running sums replace a nested map, so a session's size doesn't bound a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.functions.economics import churn_tier

CLEARS, EDITS = ("fullSet", "write"), ("editDelta", "write")


def _by(df: DataFrame, *more: str) -> list[str]:
    return ["session_id", *(["segment"] if "segment" in df.columns else []), *more]


def path_ledger(touches: DataFrame) -> DataFrame:
    """Adds epoch, lines, edits and path_tokens (clamped at 0) after each touch, and delta, the change of path_tokens.

    A fullSet or write starts a path's epoch anew; a line keeps its last tokens; edits add up.
    """
    by_path = Window.partitionBy(*_by(touches, "path")).orderBy("ord", "line_no")
    so_far = by_path.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.col("op").isin(*CLEARS) & F.coalesce(F.lag("ord").over(by_path) != F.col("ord"), F.lit(True))
    rows = touches.withColumn("_starts", starts.cast("long")).withColumn("epoch", F.sum("_starts").over(so_far)).drop("_starts")
    line = Window.partitionBy(*_by(touches, "path"), "epoch", "line_no").orderBy("ord")
    is_edit = F.col("op") == "editDelta"
    written = F.when(~is_edit, F.col("tokens"))
    before = F.last(written, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_line", F.when(is_edit, 0).otherwise(F.col("tokens") - F.coalesce(before, F.lit(0))))
    epoch = Window.partitionBy(*_by(touches, "path"), "epoch").orderBy("ord", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("lines", F.sum("_line").over(epoch)).withColumn("edits", F.sum(F.when(is_edit, F.col("tokens")).otherwise(0)).over(epoch))
    overhead = F.last(F.when(~is_edit, F.col("overhead")), ignorenulls=True).over(epoch) if "overhead" in touches.columns else F.lit(0)
    rows = rows.withColumn("path_tokens", F.greatest(F.lit(0), F.col("lines") + F.col("edits") + F.coalesce(overhead, F.lit(0))))
    return rows.withColumn("delta", F.col("path_tokens") - F.coalesce(F.lag("path_tokens").over(by_path), F.lit(0))).drop("_line")


def running_b(ledger: DataFrame, dead: Column | int = 0) -> DataFrame:
    """Adds b: the floor and the sum of all paths after each touch."""
    w = Window.partitionBy(*_by(ledger)).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ledger.withColumn("b", (dead if isinstance(dead, Column) else F.lit(dead)) + F.sum("delta").over(w))


def pure_rereads(touches: DataFrame) -> DataFrame:
    """Adds ``reread``: a full read with tokens of a path that was read or written in full before and not edited since.

    A write is a full snapshot and an edit.
    """
    before = Window.partitionBy(*_by(touches, "path")).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    snapshot = F.max(F.when(F.col("op").isin(*CLEARS), F.col("ord"))).over(before)
    full_read = F.max(F.when(F.col("op") == "fullSet", F.col("ord"))).over(before)
    edit = F.max(F.when(F.col("op").isin(*EDITS), F.col("ord"))).over(before)
    clean = edit.isNull() | (full_read > edit)
    return touches.withColumn("reread", F.coalesce((F.col("op") == "fullSet") & snapshot.isNotNull() & clean & (F.col("tokens") > 0), F.lit(False)))


def touch_counts(touches: DataFrame) -> DataFrame:
    edit = F.col("op").isin(*EDITS)
    return touches.groupBy(*_by(touches, "path")).agg(F.count_if(~edit).alias("n_reads"), F.count_if(edit).alias("n_edits"), F.max("ord").alias("last_ord"))


def touch_lists(touches: DataFrame, keep: int = 64) -> DataFrame:
    """The last ``keep`` touches of each path, in order, with mode r or w."""
    last = Window.partitionBy(*_by(touches, "path")).orderBy(F.desc("ord"))
    mode = F.when(F.col("op").isin(*EDITS), "w").otherwise("r")
    return touches.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= keep).groupBy(*_by(touches, "path")).agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("seq"), mode.alias("mode")))).alias("touches"))


def touch_spend(touches: DataFrame) -> DataFrame:
    """Tokens spent on each path by all its touches; the spend of a search is dealt to its files by what they got.

    Rows may have event_id and event_spent: the cost of an operation over several paths; and event_overhead, which its files share evenly.
    """
    if "event_spent" not in touches.columns:
        return touches.groupBy(*_by(touches, "path")).agg(F.sum(F.abs("tokens")).alias("spent"))
    event = Window.partitionBy(*_by(touches), "event_id")
    share = F.col("event_spent") * F.try_divide("tokens", F.sum("tokens").over(event))
    if "event_overhead" in touches.columns:
        # the files of one operation are its own result lines, so the set stays small
        file = Window.partitionBy(*_by(touches), "event_id", "path")
        even = F.col("event_overhead") / F.size(F.collect_set("path").over(event)) / F.count("*").over(file)
        share = share + F.coalesce(even, F.lit(0.0))
    return touches.withColumn("_s", F.when(F.col("event_spent").isNull(), F.abs("tokens")).otherwise(share)).groupBy(*_by(touches, "path")).agg(F.sum("_s").alias("spent"))


def path_snapshot(touches: DataFrame) -> DataFrame:
    """Paths that hold tokens: tokens, spend, churn, efficiency, reads, edits, pure re-reads and tier."""
    keys = _by(touches, "path")
    edit = F.col("op").isin(*EDITS)
    # all windows are by path or a part of it, so one shuffle serves them and the grouping
    rows = pure_rereads(path_ledger(touches)).groupBy(*keys).agg(
        F.max_by("path_tokens", "ord").alias("tokens"), F.sum(F.abs("tokens")).alias("spent"), F.count_if(~edit).alias("n_reads"), F.count_if(edit).alias("n_edits"), F.max("ord").alias("last_ord"), F.count_if("reread").alias("pure_rereads"),
    ).where(F.col("tokens") > 0)
    if "event_spent" in touches.columns:
        rows = rows.drop("spent").join(touch_spend(touches), keys)
    spent = F.greatest(F.col("tokens").cast("double"), F.floor(F.col("spent") + 0.5).cast("double"))
    rows = rows.withColumn("spent", spent).withColumn("churn", F.col("spent") / F.col("tokens")).withColumn("efficiency", F.floor(100 * F.col("tokens") / F.col("spent") + 0.5).cast("long"))
    return rows.withColumn("tier", churn_tier(F.col("churn"), F.col("spent") - F.col("tokens"), F.col("pure_rereads")))


def settle_deferred(deltas: DataFrame) -> DataFrame:
    """Adds deferred and residual to rows (session_id, segment, ord, db, dl, pos_total): growth of B ahead of L is banked and retired later.

    The bank is a running sum reflected at zero: D = S - min(0, running min of S), so it is two windows.
    """
    w = Window.partitionBy(*_by(deltas)).orderBy("ord")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = F.greatest(F.lit(0.0), F.col("dl").cast("double"))
    ahead = F.least(F.greatest(F.lit(0.0), F.col("db") - up), F.col("pos_total").cast("double"))
    behind = F.greatest(F.lit(0.0), up - F.col("db"))
    rows = deltas.withColumn("_e", ahead - behind).withColumn("_s", F.sum("_e").over(so_far))
    rows = rows.withColumn("deferred", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(so_far)))
    return rows.withColumn("residual", F.greatest(F.lit(0.0), F.col("deferred") - F.coalesce(F.lag("deferred").over(w), F.lit(0.0)) - F.col("_e"))).drop("_e", "_s")


def settle_by_path(deltas: DataFrame, path_deltas: DataFrame) -> DataFrame:
    """Deferred tokens of each path at the end of its segment: what was banked for it and not retired since.

    Each retirement takes the same share of every path's bank, so what is left of a deposit is the product of
    the later shares that stay: a suffix sum of logarithms. A full retirement ends an epoch.
    """
    settled = settle_deferred(deltas)
    w = Window.partitionBy(*_by(deltas)).orderBy("ord")
    up = F.greatest(F.lit(0.0), F.col("dl").cast("double"))
    before = F.coalesce(F.lag("deferred").over(w), F.lit(0.0))
    retired = F.least(before, F.greatest(F.lit(0.0), up - F.col("db")))
    banked = F.least(F.greatest(F.lit(0.0), F.col("db") - up), F.col("pos_total").cast("double"))
    # a frame that ends at the last row is summed anew for each row, so the later rows come first and the frame begins at the first
    after = Window.partitionBy(*_by(deltas)).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    rows = settled.withColumn("_keep", F.when(before > 0, 1 - retired / before).otherwise(1.0)).withColumn("_banked", banked)
    drained = F.max(F.col("_keep") <= 1e-12).over(after)
    left = F.exp(F.coalesce(F.sum(F.when(F.col("_keep") > 1e-12, F.log("_keep"))).over(after), F.lit(0.0)))
    rows = rows.select(*_by(deltas, "ord"), (F.col("_banked") * F.when(F.coalesce(drained, F.lit(False)), 0.0).otherwise(left)).alias("_left"), "pos_total")
    dealt = path_deltas.where("delta > 0").select(*_by(deltas, "ord"), "path", "delta").join(rows, _by(deltas, "ord"))
    return dealt.groupBy(*_by(deltas, "path")).agg(F.sum(F.try_divide(F.col("_left") * F.col("delta"), F.col("pos_total").cast("double"))).alias("deferred"))


def residual_by_tool(calls: DataFrame, tool_events: DataFrame) -> DataFrame:
    """The residual of each call (session_id, folded_seq, residual) dealt to its tools (session_id, folded_seq, key, kind, weight) by weight, evenly without any."""
    call = Window.partitionBy("session_id", "folded_seq")
    share = F.when(F.sum("weight").over(call) > 0, F.col("weight") / F.sum("weight").over(call)).otherwise(1 / F.count("*").over(call))
    dealt = tool_events.withColumn("_share", share).join(calls.select("session_id", "folded_seq", "residual"), ["session_id", "folded_seq"])
    return dealt.groupBy("session_id", "key", "kind").agg(F.sum(F.col("residual") * F.col("_share")).alias("tokens"), F.count("*").alias("count"))


def assign_to_calls(events: DataFrame, calls: DataFrame, side: str = "next") -> DataFrame:
    """folded_seq of the next (or previous) call for each event, by one ordered union and no range join."""
    both = events.select("session_id", "ord", F.struct(*events.columns).alias("event"), F.lit(None).cast("long").alias("folded_seq")).unionByName(
        calls.select("session_id", "ord", F.lit(None).cast(events.select(F.struct(*events.columns).alias("event")).schema["event"].dataType).alias("event"), F.col("folded_seq").cast("long"))
    )
    # calls come before events of the same ord; for the next call the order is backwards, so that frames begin at the first row
    w = Window.partitionBy("session_id").orderBy(F.desc("ord") if side == "next" else F.asc("ord"), F.col("event").isNotNull())
    near = F.last("folded_seq", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("folded_seq", near).where("event is not null").select("event.*", "folded_seq")


def event_ordinals(events: DataFrame) -> DataFrame:
    return events.withColumn("event_ordinal", F.row_number().over(Window.partitionBy("session_id", "folded_seq").orderBy("ord")) - 1)


def buckets(paths: DataFrame, residual: DataFrame) -> DataFrame:
    """One table of skills, paths and tools with tokens and rank within the session."""
    files = paths.select("session_id", F.col("path").alias("key"), F.when(F.col("path").startswith("skill:"), "skill").otherwise("path").alias("kind"), F.col("tokens").cast("double"))
    rows = files.unionByName(residual.select("session_id", "key", "kind", F.col("tokens").cast("double")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("session_id", "kind").orderBy(F.desc("tokens"), "key")))


def top_buckets(rows: DataFrame, k: int) -> DataFrame:
    return rows.where(F.col("rank") <= k)


def b_default(paths: DataFrame, discard: Column, dead: Column | int = 0) -> DataFrame:
    """Rebuild baseline of what is kept by default: the floor, skills, and paths that aren't discarded."""
    kept = F.col("path").startswith("skill:") | ~F.coalesce(discard, F.lit(False))
    return paths.groupBy("session_id").agg((F.sum(F.when(kept, F.col("tokens")).otherwise(0)) + (dead if isinstance(dead, Column) else F.lit(dead))).alias("b_default"), F.sum("tokens").alias("b_total"))


def others(rows: DataFrame, length: Column, raw: Column, tools: Column) -> DataFrame:
    """What no tool explains; ``drift_warning`` below -2 % of L."""
    left = raw - tools
    return rows.withColumn("others", F.greatest(F.lit(0.0), left)).withColumn("drift_warning", left < -0.02 * length)


TIERS = ("mint", "amber", "coral")


def directory_rollup(paths: DataFrame, depth: int = 3) -> DataFrame:
    """Tokens, paths and highest tier of each directory down to ``depth`` levels below the session's common root; chains of single children are one row.

    Every path is exploded into its directories, so the roll-up is one grouping.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    level = lambda i: F.concat(F.lit("/"), F.array_join(F.slice(dirs, 1, i), "/"))
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    keys = _by(paths)
    rows = paths.withColumn("_rank", rank).withColumn("_n", F.size(dirs)).withColumn("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(dirs)), lambda i: F.struct(i.alias("level"), level(i).alias("name")))))
    sums = rows.groupBy(*keys, F.col("dir.name").alias("dir"), F.col("dir.level").alias("level")).agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("n_paths"), F.max("_rank").alias("_rank"), F.count_if(F.col("_n") == F.col("dir.level")).alias("n_own")
    )
    whole = Window.partitionBy(*keys)
    sums = sums.withColumn("_root", F.max(F.when(F.col("n_paths") == F.max("n_paths").over(whole), F.col("level"))).over(whole))
    parent = F.regexp_replace("dir", "/[^/]*$", "")
    n_children = sums.where("level > 0").select(*keys, F.when(parent == "", "/").otherwise(parent).alias("dir")).groupBy(*keys, "dir").agg(F.count("*").alias("n_children"))
    shown = sums.where((F.col("level") >= F.col("_root")) & (F.col("level") <= F.col("_root") + depth)).join(n_children, [*keys, "dir"], "left")
    return shown.where((F.col("n_own") > 0) | (F.coalesce("n_children", F.lit(0)) != 1)).select(*keys, "dir", "level", "tokens", "n_paths", F.element_at(F.array(*map(F.lit, TIERS)), F.col("_rank").cast("int")).alias("tier"))


def selection_totals(rows: DataFrame, overrides: DataFrame, floor: int = 1000) -> DataFrame:
    """Tokens selected and discarded in each session, whether the choice differs from the default, and the baseline it would have.

    rows: session_id, path, tokens, fixed, by_default; overrides: session_id, path, selected.
    """
    chosen = rows.join(overrides, ["session_id", "path"], "left").withColumn("on", F.coalesce("selected", "by_default"))
    own = lambda c: F.sum(F.when(c, F.col("tokens")).otherwise(0))
    sums = chosen.groupBy("session_id").agg(own(F.col("fixed")).alias("fixed"), own(~F.col("fixed") & F.col("on")).alias("selected"), own(~F.col("fixed") & ~F.col("on")).alias("discarded"), own(F.col("fixed") | F.col("by_default")).alias("b_default"), F.max(F.col("on") != F.col("by_default")).alias("dirty"))
    whole = F.col("fixed") + F.col("selected") + F.col("discarded")
    return sums.withColumn("selected_share", F.try_divide("selected", whole)).withColumn("b_preview", F.greatest(F.lit(floor), F.col("fixed") + F.col("selected")))


def directory_state(selection: DataFrame) -> DataFrame:
    """checked, unchecked or half for each directory, from paths (session_id, path, selectable, on)."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    sums = selection.where("selectable").withColumn("dir", F.explode(dirs)).groupBy("session_id", "dir").agg(F.count("*").alias("n"), F.count_if("on").alias("k"))
    return sums.select("session_id", "dir", F.when(F.col("k") == 0, "unchecked").when(F.col("k") == F.col("n"), "checked").otherwise("half").alias("state"))


def reasoning_spend(blocks: DataFrame) -> DataFrame:
    """Text and thinking between two tool uses of an entry on one path, charged to that path.

    blocks: session_id, entry_ord, block_pos, kind (text, thinking, tool), path (null for tools without a file), n_chars.
    """
    w = Window.partitionBy("session_id", "entry_ord").orderBy("block_pos")
    tool = F.col("kind") == "tool"
    key = F.coalesce("path", F.lit(""))
    before = F.last(F.when(tool, key), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("session_id", "entry_ord").orderBy(F.desc("block_pos"))
    after = F.last(F.when(tool, key), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("_b", before).withColumn("_a", after).where(~tool & (F.col("_a") == F.col("_b")) & (F.col("_a") != "")).groupBy("session_id", "entry_ord", F.col("_a").alias("path")).agg(F.sum("n_chars").alias("n_chars"))


def reasoning_breaker(spend: DataFrame) -> DataFrame:
    """Rows (session_id, segment, ord, spent, l) with ``dropped``: from the first call whose running spend is above L, the segment's spend no longer counts."""
    w = Window.partitionBy(*_by(spend)).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = spend.withColumn("_sum", F.sum("spent").over(w))
    return rows.withColumn("dropped", F.max(F.col("_sum") > F.col("l")).over(w)).drop("_sum")
