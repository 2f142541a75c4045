"""Conversation trees, tool events and a stream, over tables shaped from the driver's."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockline.operators import ledger, replay, tools, tree
from stockline.operators.billing import stream_daily
from stockline.sources import tables as T
from stockline.sources import transcripts
from stockline.sources.shared import shared_folder

from .base import r6


def _entries(spark, sf):
    """Turns as a tree: a turn's parent is the one before, every seventh is written again beside it."""
    c = T.read(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    main = c.select("session_id", (F.col("turn") * 2).alias("ord"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("uuid"), F.when(F.col("turn") > 0, F.concat(F.lit("u"), (F.col("turn") - 1).cast("string"))).alias("parent_uuid"))
    fork = c.where("turn % 7 = 3").select("session_id", (F.col("turn") * 2 + 1).alias("ord"), F.concat(F.lit("f"), F.col("turn").cast("string")).alias("uuid"), F.concat(F.lit("u"), (F.col("turn") - 1).cast("string")).alias("parent_uuid"))
    return main.unionByName(fork).withColumn("is_sidechain", F.lit(False)).dropDuplicates(["session_id", "uuid"])


TREE_SQL = """WITH RECURSIVE c AS (SELECT DISTINCT conv_id AS session_id, turn FROM conversations),
e0 AS (SELECT session_id, turn*2 AS ord, 'u'||turn AS uuid, CASE WHEN turn > 0 THEN 'u'||(turn-1) END AS parent FROM c UNION ALL SELECT session_id, turn*2+1, 'f'||turn, 'u'||(turn-1) FROM c WHERE turn % 7 = 3),
e AS (SELECT e0.session_id, e0.ord, e0.uuid, CASE WHEN p.uuid IS NOT NULL THEN e0.parent END AS parent FROM e0 LEFT JOIN e0 p ON e0.session_id = p.session_id AND e0.parent = p.uuid),
k AS (SELECT session_id, parent, arg_max(uuid, ord) AS child FROM e WHERE parent IS NOT NULL GROUP BY 1, 2),
d(session_id, uuid) AS (SELECT session_id, arg_max(uuid, ord) FROM e GROUP BY 1 UNION ALL SELECT d.session_id, k.child FROM d JOIN k ON d.session_id = k.session_id AND d.uuid = k.parent),
leaf AS (SELECT d.* FROM d LEFT JOIN k ON d.session_id = k.session_id AND d.uuid = k.parent WHERE k.child IS NULL),
up(session_id, uuid) AS (SELECT * FROM leaf UNION ALL SELECT up.session_id, e.parent FROM up JOIN e ON up.session_id = e.session_id AND up.uuid = e.uuid WHERE e.parent IS NOT NULL)"""


def active_path(spark, sf):
    return tree.active_path(tree.tree_edges(_entries(spark, sf)))


def replay_plan(spark, sf):
    return tree.replay_plan(_entries(spark, sf)).groupBy("session_id", "root_ord").agg(F.count("*").alias("n"), F.max("ord").alias("last_ord"))


def _lines(spark, sf):
    """Turns as transcript lines: an assistant's turn writes or edits a file, the next user turn holds the result."""
    c = T.read(spark, sf, "conversations").where("turn IS NOT NULL AND conv_id IS NOT NULL")
    n = F.coalesce(F.length("text"), F.lit(0))
    use_id = lambda t: F.concat(F.lit("t"), t.cast("string"))
    path = F.concat(F.lit("src/f"), (n % 5).cast("string"), F.lit(".js"))
    tool = F.when(n % 3 == 0, F.struct(F.lit("tool_use").alias("type"), use_id(F.col("turn")).alias("id"), F.lit("Write").alias("name"), F.to_json(F.struct(path.alias("file_path"), F.col("text").alias("content"))).alias("input"))).otherwise(
        F.struct(F.lit("tool_use").alias("type"), use_id(F.col("turn")).alias("id"), F.lit("Edit").alias("name"), F.to_json(F.struct(path.alias("file_path"), F.substring("text", 1, 20).alias("old_string"), F.col("text").alias("new_string"))).alias("input"))
    )
    # input is an object in a transcript, not a string
    block = F.concat(F.lit('[{"type":"tool_use","id":"'), use_id(F.col("turn")), F.lit('","name":"'), tool["name"], F.lit('","input":'), tool["input"], F.lit("}]"))
    result = F.concat(F.lit('[{"type":"tool_result","tool_use_id":"'), use_id(F.col("turn") - 1), F.lit('","content":"ok"}]'))
    usage_ = F.concat(F.lit('{"input_tokens":'), (n % 10).cast("string"), F.lit(',"output_tokens":'), n.cast("string"), F.lit(',"cache_read_input_tokens":'), (F.col("turn") * 100 + 1000).cast("string"), F.lit(',"cache_creation_input_tokens":'), (n % 300).cast("string"), F.lit("}"))
    head = F.concat(F.lit('{"uuid":"u'), F.col("turn").cast("string"), F.lit('","parentUuid":'), F.when(F.col("turn") > 0, F.concat(F.lit('"u'), (F.col("turn") - 1).cast("string"), F.lit('"'))).otherwise("null"), F.lit(',"cwd":"/repo","timestamp":"2024-01-01T00:00:00Z",'))
    assistant = F.concat(head, F.lit('"type":"assistant","message":{"id":"m'), F.col("turn").cast("string"), F.lit('","model":"claude-opus-4-8","usage":'), usage_, F.lit(',"content":'), block, F.lit("}}"))
    user = F.concat(head, F.lit('"type":"user","message":{"content":'), F.when(F.col("turn") % 4 == 2, result).otherwise('"hello"'), F.lit("}}"))
    return c.select(F.col("conv_id").cast("long").alias("session_id"), F.col("turn").cast("long").alias("ord"), F.when(F.col("role") == "assistant", assistant).otherwise(user).alias("line"))


def transcript_usage(spark, sf):
    got = transcripts.extract_usage(transcripts.parse_entries(_lines(spark, sf)))
    return got.select("session_id", "ord", "cr", "cc", "inp", "outp", "human_turn").distinct()


def tool_writes(spark, sf):
    """Tokens that tool events write to each path, and the state of its ledger."""
    blocks = transcripts.blocks(transcripts.parse_entries(_lines(spark, sf)))
    events = tools.match_tool_results(blocks)
    writes = tools.line_writes(events, F.lit(2.45), F.lit(0.59))
    state = ledger.path_ledger(writes.withColumn("line_no", F.coalesce("line_no", F.lit(0))))
    last = Window.partitionBy("session_id", "path").orderBy(F.desc("ord"), F.desc("line_no"))
    return state.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("session_id", "path", "op", F.round("path_tokens", 6).alias("path_tokens"))


def replay_calls(spark, sf):
    """Each call of the transcripts by a whole replay: tree, folding, segments, tool events, B, settlement, growth, position."""
    got = replay.replay(transcripts.parse_entries(_lines(spark, sf)), F.lit(2.45), F.lit(0.59))
    cols = ("b", "deferred", "residual", "g", "x", "br")
    return r6(got.select("session_id", "folded_seq", "line", "segment", "turn_seq", "miss", "l", "dead", *cols), *cols)


def streamed_daily(spark, sf):
    """Daily totals by a stream over the events, run to the end of its input; equal to the batch totals."""
    shared = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    events = T.read(spark, sf, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{sf}/event*.parquet")
    model = F.when(F.col("user_id") % 2 == 0, "deepseek-v4-pro").otherwise("deepseek-v4-flash")
    rows = source.select(F.col("ts").cast("timestamp").alias("ts"), model.alias("model"), F.floor(F.col("value") * 100).cast("long").alias("cr"), (F.col("event_id") % 50).alias("cc"), F.lit(1).cast("long").alias("inp"), (F.col("event_id") % 7).alias("outp"))
    days = stream_daily(rows)
    out = f"{shared}/days"
    query = days.writeStream.outputMode("complete").option("checkpointLocation", f"{shared}/checkpoint").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


QUERIES = {
    "active_path": (active_path, TREE_SQL + " SELECT DISTINCT session_id, uuid FROM up"),
    "replay_plan": (replay_plan, TREE_SQL + """, rt AS (SELECT session_id, uuid, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS root_ord FROM e WHERE parent IS NULL),
      many AS (SELECT session_id FROM rt GROUP BY 1 HAVING count(*) > 1),
      br(session_id, root_ord, uuid) AS (SELECT rt.session_id, root_ord, uuid FROM rt JOIN many ON rt.session_id = many.session_id UNION ALL SELECT br.session_id, root_ord, k.child FROM br JOIN k ON br.session_id = k.session_id AND br.uuid = k.parent),
      every AS (SELECT * FROM br UNION ALL SELECT DISTINCT session_id, 1, uuid FROM up WHERE session_id NOT IN (SELECT session_id FROM many)),
      kept AS (SELECT session_id, uuid, min(root_ord) AS root_ord FROM every GROUP BY 1, 2)
      SELECT kept.session_id, root_ord, count(*) AS n, max(ord) AS last_ord FROM kept JOIN e ON kept.session_id = e.session_id AND kept.uuid = e.uuid GROUP BY 1, 2"""),
    "transcript_usage": (transcript_usage, """WITH c AS (SELECT DISTINCT conv_id AS session_id, turn AS ord, role, coalesce(length(text), 0) AS n FROM conversations),
      p AS (SELECT *, max(CASE WHEN role = 'assistant' THEN ord END) OVER w AS pa, max(CASE WHEN role <> 'assistant' AND ord % 4 <> 2 THEN ord END) OVER w AS pu FROM c WINDOW w AS (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT DISTINCT session_id, ord, ord*100+1000 AS cr, n % 300 AS cc, n % 10 AS inp, n AS outp, coalesce(pu > coalesce(pa, -1), false) AS human_turn FROM p WHERE role = 'assistant'"""),
    "tool_writes": (tool_writes, None),
    "replay_calls": (replay_calls, None),
    "stream_daily": (streamed_daily, """SELECT CAST(ts AS DATE) AS day, CASE WHEN user_id % 2 = 0 THEN 'pro' ELSE 'flash' END AS tier, CAST(sum(CAST(floor(value*100) AS BIGINT)) AS BIGINT) AS hit, CAST(sum(event_id % 50 + 1) AS BIGINT) AS miss, CAST(sum(event_id % 7) AS BIGINT) AS out FROM events GROUP BY 1, 2"""),
}
