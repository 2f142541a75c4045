"""Transcripts, usage, bills and files as tables.

A transcript is one JSON object a line. Lines are parsed once, with a narrow schema; what has several
shapes (content, cache_creation, tool inputs) stays JSON text and is taken apart where it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockline.functions import text as X
from stockline.functions.models import tier_model

ENTRY = (
    "type string, uuid string, parentUuid string, isSidechain boolean, isMeta boolean, sourceToolUseID string, timestamp string, cwd string, requestId string, request_id string, "
    "message struct<id:string,model:string,usage:string,content:string>"
)
USAGE_FIELDS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
HASH_MAX_BYTES = 8 << 20


def discover_sessions(files: DataFrame) -> DataFrame:
    """session_id, path and mtime of the newest file of each session, from rows (path, mtime)."""
    named = files.withColumn("s", X.session_of("path"))
    return named.groupBy(F.col("s.session_id").alias("session_id"), F.col("s.is_sub_agent").alias("is_sub_agent")).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime"))


def latest_transcript(files: DataFrame) -> DataFrame:
    return discover_sessions(files).orderBy(F.desc("mtime"), "path").limit(1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime, ord, line of all *.jsonl files below a folder, in file order.

    A large file is read in splits by many tasks. A line's place is its place in its split and the lines of the splits before, so only
    numbers of lines meet, one for each split.
    """
    files = spark.read.text(path, lineSep="\n", recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    rows = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", r"\r\z", "").alias("line"),
    )
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "split").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    splits = splits.select("path", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(splits, ["path", "split"]).where("line <> ''").select("path", "mtime", (F.col("row") + F.col("shift")).alias("ord"), "line")


def parse_entries(lines: DataFrame, keep: bool = False) -> DataFrame:
    """Entries of lines (path or session_id, ord, line). Lines that hold no entry are dropped before parsing, malformed ones after; with ``keep`` they are entries of nulls."""
    parsed, good = F.from_json("line", ENTRY, {"mode": "PERMISSIVE"}), F.try_parse_json("line").isNotNull()
    if keep:
        rows = lines.withColumn("e", F.when(X.precheck("line") & good, parsed))
    else:
        rows = lines.where(X.precheck("line")).withColumn("e", parsed).where(good & F.col("e").isNotNull())
    if "session_id" not in rows.columns:
        rows = rows.withColumn("_s", X.session_of("path")).withColumn("session_id", F.col("_s.session_id")).withColumn("is_sub_agent", F.col("_s.is_sub_agent"))
    sub = [F.col("is_sub_agent")] if "is_sub_agent" in rows.columns else [F.lit(False).alias("is_sub_agent")]
    e = lambda c: F.col(f"e.{c}")
    return rows.select(
        "session_id", "ord", *sub, e("type").alias("type"), e("uuid").alias("uuid"), e("parentUuid").alias("parent_uuid"), F.coalesce(e("isSidechain"), F.lit(False)).alias("is_sidechain"), F.coalesce(e("isMeta"), F.lit(False)).alias("is_meta"),
        e("sourceToolUseID").alias("source_tool_use_id"), F.try_to_timestamp(e("timestamp")).alias("ts"), e("cwd").alias("cwd"), F.coalesce(e("requestId"), e("request_id")).alias("request_id"),
        e("message.id").alias("message_id"), F.coalesce(e("message.model"), F.lit("")).alias("model"), e("message.usage").alias("usage"), e("message.content").alias("content"),
    )


def malformed(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON."""
    return lines.where((F.col("line") != "") & F.try_parse_json("line").isNull())


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_entries(read_lines(spark, path))


def _is_text(content: Column) -> Column:
    return F.coalesce(~F.ltrim(content).rlike(r"^[\[{]"), F.lit(False))


def blocks(entries: DataFrame) -> DataFrame:
    """One row for each content block: session_id, ord, block_pos, kind, text, id, name, input, tool_use_id, result, is_error."""
    kind = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
    rows = entries.where(F.ltrim("content").startswith("[")).select("session_id", "ord", "ts", "cwd", "is_sidechain", F.posexplode(F.from_json("content", kind)).alias("block_pos", "b"))
    b = lambda c: F.col(f"b.{c}")
    return rows.select("session_id", "ord", "ts", "cwd", "is_sidechain", "block_pos", b("type").alias("kind"), F.coalesce(b("text"), b("thinking")).alias("text"), b("id").alias("id"), b("name").alias("name"), b("input").alias("input"), b("tool_use_id").alias("tool_use_id"), b("content").alias("result"), F.coalesce(b("is_error"), F.lit(False)).alias("is_error"))


def is_turn_boundary() -> Column:
    """A human's entry: user, main chain, not meta, no task notification and no tool result."""
    results = F.coalesce(F.exists(F.from_json("content", "array<struct<type:string>>"), lambda b: b["type"] == "tool_result"), F.lit(False))
    content = F.col("content")
    text = _is_text(content) & ~F.ltrim(content).startswith("<task-notification>")
    return F.coalesce((F.col("type") == "user") & ~F.col("is_sidechain") & ~F.col("is_meta") & content.isNotNull() & (text | (F.ltrim(content).startswith("[") & ~results)), F.lit(False))


def counters() -> dict[str, Column]:
    """cr, cc, inp and outp of an entry."""
    u = F.col("usage")
    number = lambda name: F.coalesce(F.get_json_object(u, f"$.{name}").cast("long"), F.lit(0))
    parts = F.get_json_object(u, "$.cache_creation")
    creation = F.when(F.ltrim(parts).startswith("{"), number("cache_creation.ephemeral_5m_input_tokens") + number("cache_creation.ephemeral_1h_input_tokens")).otherwise(number("cache_creation_input_tokens"))
    return {"cr": number("cache_read_input_tokens"), "cc": creation, "inp": number("input_tokens"), "outp": number("output_tokens")}


def is_used(counters: dict[str, Column]) -> Column:
    """A usage row that counts, with these counters."""
    u = F.col("usage")
    null_field = F.lit(False)
    for name in USAGE_FIELDS:
        null_field = null_field | u.rlike(rf'"{name}"\s*:\s*null')
    own = (F.col("type") == "assistant") & u.isNotNull() & F.ltrim(u).startswith("{") & ~null_field
    return F.coalesce(own, F.lit(False)) & (F.col("model") != "<synthetic>") & (counters["cr"] + counters["cc"] + counters["inp"] + counters["outp"] > 0)


def usage_fields() -> dict[str, Column]:
    """cr, cc, inp, outp of an entry, ``_used`` if it is a usage row that counts and ``_turn`` if it is a human's."""
    return counters() | {"_used": is_used(counters()), "_turn": is_turn_boundary()}


def extract_usage(entries: DataFrame) -> DataFrame:
    """Usage rows of assistant entries, with ``human_turn`` if a human's entry came since the session's usage row before.

    Rows with an explicit null in a known field, of a synthetic model or with four zero counters are left out.
    """
    rows = entries.select("session_id", "ord", "ts", "uuid", "message_id", "request_id", "model", "is_sidechain", "is_sub_agent", *(c.alias(n) for n, c in usage_fields().items()))
    # a sub-agent's file has an order of its own
    before = Window.partitionBy("session_id", "is_sub_agent").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce(F.max(F.when(F.col("_used") & ~F.col("is_sidechain"), F.col("ord"))).over(before), F.lit(-1).cast("long"))
    turn = F.coalesce(F.max(F.when(F.col("_turn"), F.col("ord"))).over(before) > since, F.lit(False))
    return rows.withColumn("human_turn", turn).where("_used").drop("_turn", "_used")


def fold_key() -> Column:
    """Message id, else request id; null for rows without either."""
    return F.coalesce("message_id", "request_id")


def wash(usage: DataFrame, salt: str) -> DataFrame:
    """Folded usage without identity: salted session hash, day, number in the session, counters and tier."""
    from stockline.operators.calls import fold_calls

    calls = fold_calls(usage, "last")
    session = F.substring(F.sha1(F.concat(F.lit(salt), F.lit("|"), F.col("session_id").cast("string"))), 1, 10)
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    return calls.select(F.to_date("ts").alias("day"), session.alias("session"), seq.alias("seq"), "model", tier_model(F.col("model")).alias("tier"), "cr", "cc", "inp", "outp")


def write_usage(washed: DataFrame, path: str) -> None:
    washed.write.mode("overwrite").partitionBy("day").parquet(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Washed usage from CSV with a header."""
    return spark.read.csv(path, header=True, schema="ts string, session string, seq long, model string, tier string, cache_read long, cache_creation long, input long, output long")


def read_bill(spark: SparkSession, path: str) -> DataFrame:
    """Bill lines from CSV; a byte order mark before the header is no matter, since columns go by their place."""
    rows = spark.read.csv(path, header=True, schema="date string, model string, type string, price double, amount long", enforceSchema=True)
    return rows.select(F.to_date("date").alias("day"), "model", "type", "price", "amount")


def write_daily(days: DataFrame, path: str) -> None:
    days.coalesce(1).write.mode("overwrite").csv(path, header=True)  # one row a day


def hash_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, sha256 and number of lines of files up to 8 MiB; larger ones have neither. Empty files aren't listed by the source."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    small = F.col("length") <= HASH_MAX_BYTES
    text = F.decode("content", "ISO-8859-1")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)
    return files.select("path", "length", F.when(small, F.sha2("content", 256)).alias("sha256"), F.when(small, lines).cast("long").alias("n_lines"))
