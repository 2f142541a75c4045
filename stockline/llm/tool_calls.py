r"""Operator 5: chat formatting with tool-call linking. DataFrame functions only.

Inputs: ``calls`` (conv_id, call_id, turn, name, arguments as JSON text, needs: call_ids whose results a call uses), ``results``
(conv_id, call_id, turn, content) and ``schemas`` (name, argument, type, required).

1. *Linking*: calls and results are hash-joined by (conv_id, call_id), results pre-aggregated to the earliest one of an identifier.
2. *Order*: a call comes after the calls that it needs. Where all needs of a conversation point to earlier turns, the turn is
   such an order (level 0). Only calls that need later ones, and what hangs on them, get levels: in each round calls
   whose needs are all placed get the next level; the rounds are as many as the longest chain of such calls.
   Calls on a cycle, or that need one, have a null level. ``missing_needs`` counts needs that name no call.
   The order of a conversation is (level nulls last, turn, call_id); no window gathers a conversation.
3. *Validation*: arguments must be a JSON object with all required arguments, no unknown ones, and values of the
   schema's types (string, integer, number, boolean, array, object, null). Schemas are gathered by tool name.
4. *Canonical JSON*: one object for each call with keys in order, no white space, and nested keys in order (a variant keeps fields
   sorted). Unparsable arguments become null.

Defined results: calls with a null conv_id or call_id are kept, never linked and ordered by turn; results without a call aren't
returned here (``orphans``); a repeated call is a row of its own; ties have equal order keys; an
empty table gives an empty result; unknown tools are invalid. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

KEY = ["conv_id", "call_id"]
CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, needs array<string>"


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level for the calls that a later call's result holds up; all others are level 0."""
    place = calls.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min("turn").alias("turn"))
    edges = calls.select(*KEY, "turn", F.explode(F.array_distinct("needs")).alias("need")).where("need is not null").distinct()
    target = place.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"))
    edges = edges.join(target, ["conv_id", "need"])
    late = edges.where("need_turn >= turn").select("conv_id").distinct()
    edges = cut_lineage(edges.join(late, "conv_id", "left_semi").select(*KEY, "need").distinct())
    open_ = cut_lineage(place.join(late, "conv_id", "left_semi").select(*KEY))
    placed, level = open_.where("false").withColumn("level", F.lit(0)), 0
    while not open_.isEmpty():
        blocked = edges.join(open_.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]).select(*KEY).distinct()
        ready = cut_lineage(open_.join(blocked, KEY, "left_anti"))
        if ready.isEmpty():
            break
        placed = cut_lineage(placed.union(ready.withColumn("level", F.lit(level))))
        open_ = cut_lineage(open_.join(ready, KEY, "left_anti"))
        level += 1
    return placed.union(open_.withColumn("level", F.lit(None).cast("int"))).withColumn("held_up", F.lit(True))


def _mistakes(arguments, schema):
    """Names of arguments that are missing, unknown or of another type, in the schema's order and then the object's."""
    kind = lambda v: F.when(F.is_variant_null(v), "null").otherwise(F.lower(F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)))
    fits = lambda t, k: (
        (t == k) | ((t == "integer") & (k == "bigint")) | ((t == "number") & k.isin("bigint", "double", "float", "decimal"))
    )
    wrong = F.transform(
        F.filter(schema, lambda s: F.when(F.map_contains_key(arguments, s["argument"]), ~fits(s["type"], kind(arguments[s["argument"]]))).otherwise(s["required"])),
        lambda s: s["argument"],
    )
    known = F.transform(schema, lambda s: s["argument"])
    return F.concat(wrong, F.array_sort(F.array_except(F.map_keys(arguments), known)))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, turn, name, level, linked, result_turn, missing_needs, valid, mistakes, json."""
    answers = results.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min(F.struct("turn", "content")).alias("answer"))
    contract = schemas.groupBy("name").agg(F.sort_array(F.collect_set(F.struct("argument", "type", "required"))).alias("schema"))
    known = calls.where("call_id is not null").select("conv_id", F.col("call_id").alias("need")).distinct()
    needs = calls.where("call_id is not null").select(*KEY, F.explode(F.array_distinct("needs")).alias("need")).distinct()
    missing = needs.join(known, ["conv_id", "need"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("missing_needs"))
    parsed = F.try_parse_json("arguments")
    object_ = F.from_json("arguments", "map<string,variant>")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    mistakes = (
        F.when(F.col("schema").isNull(), F.array(F.lit("unknown tool")))
        .when(~F.col("is_object"), F.array(F.lit("not an object")))
        .otherwise(_mistakes(F.col("object"), F.col("schema")))
    )
    whole = (
        calls.select("conv_id", "call_id", "turn", "name", "arguments")
        .join(answers, KEY, "left").join(levels(calls), KEY, "left").join(missing, KEY, "left").join(contract, "name", "left")
        .withColumn("parsed", parsed).withColumn("object", object_).withColumn("is_object", is_object)
        .withColumn("mistakes", mistakes)
    )
    canonical = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), F.lit("null")), F.lit(',"call_id":'), _text("call_id"),
        F.lit(',"name":'), _text("name"), F.lit(',"result":'), _text("answer.content"), F.lit("}"),
    )
    return whole.select(
        "conv_id", "call_id", "turn", "name", F.when(F.col("held_up"), F.col("level")).otherwise(F.lit(0)).alias("level"),
        F.col("answer").isNotNull().alias("linked"), F.col("answer.turn").alias("result_turn"), F.coalesce("missing_needs", F.lit(0)).alias("missing_needs"),
        (F.size("mistakes") == 0).alias("valid"), "mistakes", canonical.alias("json"),
    )


def _text(column: str):
    """A string as JSON, null as null."""
    value = F.to_json(F.struct(F.col(column).alias("x")))  # {"x":...}
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(value.substr(F.lit(6), F.length(value) - 6))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call has."""
    return results.join(calls.select(*KEY).distinct(), KEY, "left_anti")


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas read from turns: an assistant's turn is a call, the next user turn, with its whole text, its result.

    The tool is named by the number of words; a call needs the call at half its turn, and every seventh
    turn needs a later one.
    """
    n = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0))
    call_id = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    turn = F.col("turn")
    half = F.floor(turn / 4).cast("long") * 2 + 1
    arguments = F.concat(
        F.lit('{ "words": '), F.when(n % 5 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string")),
        F.when(n % 11 == 0, F.lit("")).otherwise(F.concat(F.lit(', "digest" : "'), F.md5(F.coalesce("text", F.lit(""))), F.lit('"'))),
        F.when(n % 7 == 0, F.lit(', "extra": {"b": [1, 2], "a": true}')).otherwise(F.lit("")), F.when(n % 13 == 0, F.lit("")).otherwise(F.lit(" }")),
    )
    calls = conversations.where("role = 'assistant'").select(
        F.col("conv_id").cast("long"), call_id(turn).alias("call_id"), turn.cast("long").alias("turn"),
        F.when(n > 60, "summarise").when(n > 10, "search").otherwise("lookup").alias("name"), arguments.alias("arguments"),
        F.when(turn % 14 == 7, F.array(call_id(turn + 2))).when(turn > half, F.array(call_id(half))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = conversations.where("role = 'user' AND turn > 0").select(
        F.col("conv_id").cast("long"), call_id(turn - 1).alias("call_id"), turn.cast("long").alias("turn"), F.col("text").alias("content"),
    )
    rows = ", ".join(f"('{t}', '{a}', '{k}', {r})" for t in ("summarise", "search") for a, k, r in (("words", "integer", "true"), ("digest", "string", "true"), ("extra", "object", "false")))
    schemas = conversations.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS schemas(name, argument, type, required)")
    return calls, results, schemas
