"""Carry-over: kept paths, hand-over tables, claims and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.functions import text as X

MAX_PATHS, MAX_SUMMARY, MAX_NEXT_TASK, TTL_DAYS = 50, 10_000, 2_000, 7


def validate_handoffs(handoffs: DataFrame) -> DataFrame:
    """Adds ``error`` to rows (summary, next_task, paths); null: valid."""
    return handoffs.withColumn(
        "error",
        F.when(F.size("paths") > MAX_PATHS, "too_many_paths").when(F.length(F.trim(F.coalesce("summary", F.lit("")))) == 0, "summary_missing")
        .when(F.length("summary") > MAX_SUMMARY, "summary_too_long").when(F.length("next_task") > MAX_NEXT_TASK, "next_task_too_long"),
    )


def upsert_handoffs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New rows by handoff_id; a row that was delivered stays as it is."""
    fixed = existing.where("delivered_at IS NOT NULL").select("handoff_id")
    taken = new.join(fixed, "handoff_id", "left_anti")
    last = Window.partitionBy("handoff_id").orderBy(F.desc("created_at"))
    taken = taken.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    return existing.join(taken.select("handoff_id"), "handoff_id", "left_anti").unionByName(taken, allowMissingColumns=True)


def append_loads(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Load attempts; one that is there already is left out."""
    key = ["handoff_id", "session_id", "loaded_at"]
    return existing.unionByName(new.dropDuplicates(key).join(existing.select(*key), key, "left_anti"))


def dedupe_kept(kept: DataFrame) -> DataFrame:
    """Kept entries (session_id, ord, path) with their normalised path, once each, in the first one's place."""
    named = kept.withColumn("kept", X.keep_path("path", F.col("project_dir")) if "project_dir" in kept.columns else X.keep_path("path", F.lit(None).cast("string")))
    return named.groupBy("session_id", F.col("kept.path").alias("path")).agg(F.min("ord").alias("ord"), F.max("kept.invalid").alias("invalid"), F.max("kept.external").alias("external"))


def match_kept_paths(kept: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every kept path with its candidates: exact before suffix. status: exact, suffix, ambiguous or unmatched.

    A candidate is exploded into its path suffixes, so a suffix match is an equi-join.
    """
    parts = F.split(F.regexp_replace("path", "^/+", ""), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    named = candidates.select("session_id", F.col("path").alias("candidate"), "tokens", "last_ord", F.explode(F.array_distinct(F.concat(suffixes, F.array("path")))).alias("path"))
    met = kept.select("session_id", "path").join(named, ["session_id", "path"], "left").withColumn("rank", F.when(F.col("candidate") == F.col("path"), 1).when(F.col("candidate").isNotNull(), 2))
    best = Window.partitionBy("session_id", "path")
    met = met.withColumn("_best", F.min("rank").over(best)).where((F.col("rank") == F.col("_best")) | F.col("rank").isNull())
    n = F.count("candidate").over(best)
    status = F.when(n == 0, "unmatched").when(n > 1, "ambiguous").when(F.col("rank") == 1, "exact").otherwise("suffix")
    return met.withColumn("status", status).select("session_id", "path", "candidate", "tokens", "last_ord", "status")


def resolve_kept_tokens(kept: DataFrame, candidates: DataFrame) -> DataFrame:
    """One candidate for each kept path: the one that was active last."""
    last = Window.partitionBy("session_id", "path").orderBy(F.desc_nulls_last("last_ord"), "candidate")
    return match_kept_paths(kept, candidates).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def partition_kept(kept: DataFrame, candidates: DataFrame) -> DataFrame:
    """invalid, unknown or resolved for each kept path."""
    found = resolve_kept_tokens(kept, candidates).select("session_id", "path", "status")
    return dedupe_kept(kept).join(found, ["session_id", "path"], "left").select("session_id", "path", F.when(F.col("invalid"), "invalid").when(F.coalesce("status", F.lit("unmatched")) == "unmatched", "unknown").otherwise("resolved").alias("part"))


def path_totals(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """Tokens of each path by its lines, 0 without any."""
    sums = lines.groupBy("session_id", "path").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_lines"))
    return paths.select("session_id", "path").distinct().join(sums, ["session_id", "path"], "left").select("session_id", "path", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def line_ranges(lines: DataFrame) -> DataFrame:
    """Runs of neighbouring line numbers of each path, with their number of lines."""
    once = lines.select("session_id", "path", "line_no").distinct()
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("session_id", "path").orderBy("line_no"))
    return once.withColumn("_i", island).groupBy("session_id", "path", "_i").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last")).select("session_id", "path", "first", "last", (F.col("last") - F.col("first") + 1).alias("n_lines"))


def carry_economics(kept: DataFrame, status: DataFrame) -> DataFrame:
    """What a carry-over keeps and drops: kept (session_id, tokens), status (session_id, b, floor, l)."""
    sums = kept.groupBy("session_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("kept"))
    rows = status.join(sums, "session_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return rows.select("session_id", "kept", (F.col("b") - F.col("floor") - F.col("kept")).alias("discarded"), F.try_divide(100 * F.col("kept"), F.col("b") - F.col("floor")).alias("carry_pct"), (F.col("kept") + F.col("floor")).alias("basis"), F.try_divide("l", F.col("kept") + F.col("floor")).alias("x_after"))


def carry_linkage(steps: DataFrame, handoffs: DataFrame, loads: DataFrame) -> DataFrame:
    """Producer segment to consumer: steps (session_id, segment, load_token) to hand-over to producer."""
    joined = steps.where("load_token IS NOT NULL").join(handoffs.select("handoff_id", "load_token", F.col("session_id").alias("producer"), F.col("segment").alias("producer_segment")), "load_token")
    claimed = loads.select("handoff_id", F.col("session_id"), "loaded_at")
    return joined.join(claimed, ["handoff_id", "session_id"]).select("handoff_id", "producer", "producer_segment", F.col("session_id").alias("consumer"), F.col("segment").alias("consumer_segment"), "loaded_at")


def classify_claims(handoffs: DataFrame, loads: DataFrame) -> DataFrame:
    """primary for the first consumer's attempts, duplicate for others' (with the primary consumer), legacy_unattributed for a delivery without attempt."""
    order = Window.partitionBy("handoff_id").orderBy("loaded_at", "load_id")
    rows = handoffs.select("handoff_id", "delivered_at").join(loads, "handoff_id", "left").withColumn("primary", F.first("session_id").over(order))
    state = F.when(F.col("session_id").isNull() & F.col("delivered_at").isNotNull(), "legacy_unattributed").when(F.col("session_id").isNull(), "undelivered").when(F.col("session_id") == F.col("primary"), "primary").otherwise("duplicate")
    return rows.select("handoff_id", "load_id", "session_id", "loaded_at", state.alias("claim"), F.when(state == "duplicate", F.col("primary")).alias("primary_session"))


def pending_handoffs(handoffs: DataFrame, now, session_id=None, days: int = TTL_DAYS, k: int = 5) -> DataFrame:
    """The newest undelivered hand-overs of each project within the time limit; ambiguous if there are several."""
    alive = handoffs.where(F.col("delivered_at").isNull() & (F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))
    if session_id is not None:
        alive = alive.where(F.col("session_id") != F.lit(session_id))
    newest = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("handoff_id"))
    rows = alive.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)
    return rows.withColumn("ambiguous", F.count("*").over(Window.partitionBy("project_id")) > 1)


def discover_handoffs(handoffs: DataFrame, now, session_id=None, shown: int = 3) -> DataFrame:
    """What a new session is shown: the newest ones with age and the task's start, and whether there are more."""
    rows = pending_handoffs(handoffs, now, session_id, k=shown + 1)
    more = F.max("rank").over(Window.partitionBy("project_id")) > shown
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("created_at")
    return rows.withColumn("more", more).where(F.col("rank") <= shown).select("project_id", "handoff_id", "rank", "more", X.age_text(age).alias("age"), F.substring("next_task", 1, 200).alias("preview"))


def latest_handoff(handoffs: DataFrame) -> DataFrame:
    return handoffs.groupBy("session_id").agg(F.max_by("handoff_id", F.struct("created_at", "handoff_id")).alias("handoff_id"), F.max("created_at").alias("created_at"))


def effective_price(models: DataFrame, saved: DataFrame, session: DataFrame, presets: DataFrame) -> DataFrame:
    """Saved override before session override before the preset; ``drifted`` if it isn't the preset's."""
    def joined(rows, other, name):
        return rows.join(other.select("model", F.col("read_price").alias(f"{name}_read"), F.col("write_price").alias(f"{name}_write")), "model", "left")

    rows = joined(joined(joined(models, valid_prices(saved), "saved"), valid_prices(session), "session"), presets, "preset")
    read, write = (F.coalesce(*[f"{n}_{k}" for n in ("saved", "session", "preset")]) for k in ("read", "write"))
    drift = F.coalesce((F.abs(read - F.col("preset_read")) > 1e-9) | (F.abs(write - F.col("preset_write")) > 1e-9), F.lit(True))
    return rows.select("model", read.alias("read_price"), write.alias("write_price"), (write / read).alias("ratio"), drift.alias("drifted"), F.when(F.col("saved_read").isNotNull(), "saved").when(F.col("session_read").isNotNull(), "session").when(F.col("preset_read").isNotNull(), "preset").alias("source"))


def valid_prices(prices: DataFrame) -> DataFrame:
    """Positive finite prices with write at or above read."""
    inf = float("inf")
    return prices.where((F.col("read_price") > 0) & (F.col("write_price") >= F.col("read_price")) & (F.col("write_price") < inf))


#: Rules without a literal folder that may meet every path.
MOST_FREE_RULES = 1000


def rule_folder(pattern: Column) -> Column:
    """The folder that every match of a pattern begins with; null if the pattern doesn't say one."""
    found = F.regexp_extract(pattern, r"^\^([A-Za-z0-9_/-]*/)(?![*+?{])", 1)
    return F.when((found != "") & ~pattern.contains("|"), found)


def apply_ignore_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``ignored`` by the last rule (priority, pattern as regular expression, negated) that matches.

    Rules that begin with a folder meet the paths below that folder by a hash join. The others meet all paths, so there may be
    ``MOST_FREE_RULES`` of them at most.
    """
    distinct = paths.select("path").distinct()  # each path meets the rules once
    keyed = rules.select("pattern", "priority", "negated", rule_folder(F.col("pattern")).alias("folder"))
    free = keyed.where("folder IS NULL").drop("folder")
    if free.count() > MOST_FREE_RULES:
        raise ValueError(f"more than {MOST_FREE_RULES} rules without a folder")
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    below = distinct.where(F.size(parts) > 1).select("path", F.explode(folders).alias("folder")).join(keyed.where("folder IS NOT NULL"), "folder")
    columns = ("path", "pattern", "priority", "negated")
    met = below.where(F.expr("path RLIKE pattern")).select(*columns).unionByName(distinct.join(F.broadcast(free), F.expr("path RLIKE pattern")).select(*columns))
    last = met.groupBy("path").agg(F.max_by(~F.col("negated"), "priority").alias("ignored"))
    return distinct.join(last, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def frequent_words(texts: DataFrame, text: str, share: float = 0.2) -> DataFrame:
    """Words of at least four letters in at least ``share`` of the texts: few, since a text has few words."""
    n = texts.select(F.count("*").alias("_n"))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_-]{3,}"), F.lit(0)))).alias("word")).groupBy("word").count()
    return words.join(F.broadcast(n)).where(F.col("count") >= share * F.col("_n")).select("word", "count")  # n is one row


def document_terms(docs: DataFrame, columns: tuple[str, ...], key: str) -> DataFrame:
    """key, terms (with repetitions) and n_terms of each document."""
    text = F.lower(F.concat_ws(" ", *columns))
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    rows = docs.select(key, F.concat(words, X.cjk_bigrams(text)).alias("terms"))
    return rows.withColumn("n_terms", F.size("terms"))


def search(docs: DataFrame, query, k: int = 3, columns: tuple[str, ...] = ("summary", "next_task"), key: str = "handoff_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents with all terms of the query, by BM25, the best k. query: a string, or a frame (query_id, query).

    Terms are counted within their document and kept only if a query has them, so that what is shuffled grows with the hits.
    """
    spark = docs.sparkSession
    asked = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("query")) if isinstance(query, str) else query
    wanted = asked.select("query_id", F.explode(F.array_distinct(X.query_terms("query"))).alias("term"))
    need = wanted.groupBy("query_id").agg(F.count("*").alias("n_wanted"))
    listed = document_terms(docs, columns, key)
    shape = listed.agg(F.count("*").alias("n_docs"), F.try_divide(F.sum("n_terms"), F.count_if(F.col("n_terms") > 0)).alias("mean_terms"))
    terms = listed.select(key, "n_terms", F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy(key, "n_terms", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    hits = terms.join(wanted, "term").join(df, "term").join(F.broadcast(shape))  # shape is one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("mean_terms")))
    found = hits.groupBy("query_id", key).agg(F.sum(score).alias("score"), F.count("*").alias("n")).join(need, "query_id").where("n = n_wanted")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", key, "rank", "score")


def search_join(hits: DataFrame, handoffs: DataFrame, project_id=None) -> DataFrame:
    rows = hits.join(handoffs, "handoff_id")
    return rows if project_id is None else rows.where(F.col("project_id") == F.lit(project_id))
