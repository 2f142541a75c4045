"""Tool events: uses joined with their results, file operations by an ordered registry of adapters, skills, load tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.functions import text as X

FILE_TOOLS = ("Read", "Write", "Edit", "Grep", "Bash", "Skill")


def _input(field: str) -> Column:
    return F.get_json_object("input", f"$.{field}")


@dataclass(frozen=True)
class ToolAdapter:
    """One kind of tool: which uses it takes, and an array of (path, op, line, tokens, overhead, spent) for each.

    The first adapter of a registry that matches takes a use.
    """

    name: str
    match: Callable[[], Column]
    writes: Callable[[Column, Column], Column]


_WRITE = "array<struct<path:string,op:string,line:bigint,tokens:double,overhead:double,spent:double>>"


def _rows(path: Column, op: Column, lines: Column, overhead: int) -> Column:
    """One write for each line; an operation without lines has one without line."""
    spent = F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["tokens"]) + float(overhead)
    row = lambda line, tokens: F.struct(path.alias("path"), op.alias("op"), line.alias("line"), tokens.alias("tokens"), F.lit(float(overhead)).alias("overhead"), spent.alias("spent"))
    some = F.transform(lines, lambda x: row(x["line"], x["tokens"]))
    return F.when(op.isNotNull() & path.isNotNull(), F.when(F.size(lines) > 0, some).otherwise(F.array(row(F.lit(None).cast("bigint"), F.lit(0.0)))))


def _read(a, c):
    lines = X.numbered_lines("result_text", a, c)
    return _rows(X.canonical_path(_input("file_path"), "cwd"), X.read_op("result_text", _input("offset"), _input("limit"), lines), lines, X.OVERHEAD["Read"])


def _write(a, c):
    return _rows(X.canonical_path(_input("file_path"), "cwd"), F.lit("write"), X.written_lines(_input("content"), a, c), X.OVERHEAD["Write"])


def _edit(a, c):
    d = X.edit_delta(_input("old_string"), _input("new_string"), a, c)
    row = F.struct(X.canonical_path(_input("file_path"), "cwd").alias("path"), F.lit("editDelta").alias("op"), F.lit(None).cast("bigint").alias("line"), d["delta"].alias("tokens"), F.lit(0.0).alias("overhead"), d["spent"].alias("spent"))
    return F.when(_input("file_path").isNotNull(), F.array(row))


def _grep(a, c):
    lines = X.grep_lines("result_text", F.col("cwd"), a, c)
    files = F.greatest(F.size(F.array_distinct(F.transform(lines, lambda x: x["path"]))), F.lit(1))
    spent = F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["tokens"]) + float(X.OVERHEAD["Grep"])
    return F.transform(lines, lambda x: F.struct(x["path"].alias("path"), F.lit("lineUpdate").alias("op"), x["line"].alias("line"), x["tokens"].alias("tokens"), (F.lit(float(X.OVERHEAD["Grep"])) / files).alias("overhead"), spent.alias("spent")))


def _bash(a, c):
    plain = F.transform(F.split("result_text", "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line"), X.estimate_tokens(x, a, c).alias("tokens")))
    found = F.filter(F.split("result_text", "\n"), lambda x: x.rlike(r"^\d+:"))
    numbered = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\d+):", 1).cast("long").alias("line"), X.estimate_tokens(F.regexp_extract(x, r"^\d+:(.*)$", 1), a, c).alias("tokens")))

    def written(op: Column) -> Column:
        kind, path = op["kind"], X.canonical_path(op["path"], F.when(op["cwd"].isNotNull(), X.canonical_path(op["cwd"], "cwd")).otherwise(F.col("cwd")))
        lines = F.when(kind == "cat-write", X.written_lines(X.heredoc_body(_input("command")), a, c)).when(kind == "grep-n", numbered).otherwise(plain)
        how = F.when(kind == "cat", "fullSet").when(kind == "cat-write", "write").when((kind == "head") | (F.size(numbered) > 0), "lineUpdate")
        return F.struct(kind.alias("kind"), path.alias("path"), how.alias("how"), lines.alias("lines"))

    def rows(x: Column) -> Column:
        return F.when(x["kind"] == "cat-write", _rows(x["path"], x["how"], x["lines"], X.OVERHEAD["Write"])).otherwise(_rows(x["path"], x["how"], x["lines"], X.OVERHEAD["Bash"]))

    return X.let(X.let(X.shell_file_op(_input("command")), written), rows)


def _skill(a, c):
    text = F.coalesce("skill_text", "result_text")
    lines = F.array(F.struct(F.lit(1).cast("bigint").alias("line"), X.estimate_tokens(text, a, c).alias("tokens")))
    return _rows(F.concat(F.lit("skill:"), _input("skill")), F.lit("fullSet"), lines, X.OVERHEAD["Read"])


ADAPTERS = tuple(ToolAdapter(n, (lambda n=n: F.col("name") == n), f) for n, f in (("Read", _read), ("Write", _write), ("Edit", _edit), ("Grep", _grep), ("Bash", _bash), ("Skill", _skill)))


def match_tool_results(blocks: DataFrame) -> DataFrame:
    """Tool uses with their first later result, from content blocks (with segment if it is known). Failed file tools have none."""
    keys = ["session_id", "segment"] if "segment" in blocks.columns else ["session_id"]
    uses = blocks.where("kind = 'tool_use' AND id IS NOT NULL").select(*keys, F.col("ord").alias("use_ord"), "block_pos", "cwd", "id", "name", "input")
    results = blocks.where("kind = 'tool_result'").select(*keys, F.col("tool_use_id").alias("id"), F.col("ord").alias("result_ord"), X.result_text("result").alias("result_text"), "is_error")
    met = uses.join(results, [*keys, "id"]).where((F.col("result_ord") >= F.col("use_ord")) & ~(F.col("is_error") & F.col("name").isin(*FILE_TOOLS)))
    first = Window.partitionBy(*keys, "id").orderBy("use_ord", "result_ord")
    return met.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def attach_skill_content(events: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds skill_text: the text of the meta entry that a skill use brought in."""
    texts = entries.where("is_meta AND source_tool_use_id IS NOT NULL").groupBy("session_id", F.col("source_tool_use_id").alias("id")).agg(F.min_by(X.result_text("content"), "ord").alias("skill_text"))
    return events.join(texts, ["session_id", "id"], "left")


def backfill_load_tokens(steps: DataFrame, events: DataFrame) -> DataFrame:
    """Steps with the load token of a hand-over tool's result where they have none. events: session_id, folded_seq, name, result_text."""
    found = events.where(F.col("name").endswith("load_handoff")).groupBy("session_id", "folded_seq").agg(F.first(F.get_json_object("result_text", "$.load_token"), ignorenulls=True).alias("_found"))
    return steps.join(found, ["session_id", "folded_seq"], "left").withColumn("load_token", F.coalesce("load_token", "_found")).drop("_found")


def drop_unanswered(uses: DataFrame, answered: DataFrame, turns: DataFrame, max_distance: int = 2) -> DataFrame:
    """Uses (session_id, id, turn_seq) that wait for a result and aren't too many turns old. turns: session_id, turn_seq (now)."""
    waiting = uses.join(answered.select("session_id", "id"), ["session_id", "id"], "left_anti")
    return waiting.join(turns.select("session_id", F.col("turn_seq").alias("_now")), "session_id").where(F.col("_now") - F.col("turn_seq") <= max_distance).drop("_now")


def writes_of(ascii_ctp: Column, cjk_ctp: Column, adapters: tuple[ToolAdapter, ...] = ADAPTERS) -> Column:
    """The writes of a tool event (name, input, result_text, cwd, skill_text) as an array; null if no adapter takes it."""
    writes = None
    for adapter in adapters:
        found = adapter.writes(ascii_ctp, cjk_ctp).cast(_WRITE)
        writes = F.when(adapter.match(), found) if writes is None else writes.when(adapter.match(), found)
    return writes


def line_writes(events: DataFrame, ascii_ctp: Column, cjk_ctp: Column, adapters: tuple[ToolAdapter, ...] = ADAPTERS) -> DataFrame:
    """Path, op, line and tokens of each line that a tool event writes into the context."""
    rows = events if "skill_text" in events.columns else events.withColumn("skill_text", F.lit(None).cast("string"))
    keys = [c for c in ("session_id", "segment", "result_ord", "block_pos", "id", "name") if c in events.columns]
    return rows.select(*keys, F.inline(writes_of(ascii_ctp, cjk_ctp, adapters))).withColumnRenamed("result_ord", "ord").withColumnRenamed("line", "line_no")


def residual_tools(events: DataFrame) -> DataFrame:
    """key, kind and weight of the uses that a call's residual is dealt to: shell commands, MCP tools and agents."""
    name = F.col("name")
    kind = F.when(name == "Bash", "bash").when(name.startswith("mcp__"), "mcp").when(name.isin("Task", "Agent"), "agent")
    label = X.let(X.shell_label(_input("command")), lambda x: F.concat_ws(" ", x["name"], F.nullif(x["detail"], F.lit(""))))
    key = F.when(kind == "bash", label).when(kind == "mcp", X.mcp_label("name")).otherwise(F.coalesce(_input("description"), name))
    weight = F.when(kind == "agent", F.length("result_text")).otherwise(F.length("input") + F.length("result_text"))
    return events.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("session_id", "id", "use_ord", "result_ord", key.alias("key"), "kind", weight.alias("weight"))
