"""Input tables: the driver's Parquet tables, and usage, bill and touch views derived from them.

``usage``: session_id, ord, ts, message_id, pair_id, model, cr, cc, inp, outp, human_turn
``bill``: day, model, type, price, amount
``touches``: session_id, ord, path, op, line_no, tokens
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(rows: DataFrame, each: int) -> int:
    """Tasks of about ``each`` rows, one for each core at least: a task's memory doesn't grow with the table. Files tell their rows by their footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


#: Rows of a task: the windows over usage have some twenty sorts in one stage, those over touches four.
USAGE_ROWS, TOUCH_ROWS = 50_000, 250_000


def usage_view(events: DataFrame) -> DataFrame:
    """API calls of one session for each user: 'signup' starts a fresh context, 'error' is a cache miss, 'view' a human turn."""
    events = events.select("user_id", "event_id", "ts", "event_type", "value").repartition(tasks_for(events, USAGE_ROWS), "user_id")
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    fresh = Window.partitionBy("user_id", "grp").orderBy("event_id")
    e = events.select(
        "user_id", "event_id", "ts", "event_type", F.floor(F.col("value") * 100).cast("long").alias("v"),
        F.row_number().over(by_user).alias("rn"), F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).over(by_user).alias("grp"),
    ).withColumn("stock", 20000 + F.sum("v").over(fresh))
    missed = F.col("event_type") == "error"
    session, ord_ = F.col("user_id"), F.col("event_id")
    return e.select(
        session.alias("session_id"), ord_.alias("ord"), "ts",
        F.concat(F.lit("m"), session.cast("string"), F.lit("-"), ord_.cast("string")).alias("message_id"),
        F.concat(F.lit("p"), session.cast("string"), F.lit("-"), F.floor((F.col("rn") - 1) / 2).cast("string")).alias("pair_id"),
        F.when(session % 4 == 0, "claude-opus-4-8").when(session % 4 == 1, "deepseek-v4-pro").when(session % 4 == 2, "deepseek-v4-flash").otherwise("other-model").alias("model"),
        F.when(missed, 0).otherwise(F.col("stock") - F.col("v")).cast("long").alias("cr"),
        F.when(missed, F.col("stock")).otherwise(F.col("v")).cast("long").alias("cc"),
        (ord_ % 50).alias("inp"), (F.col("v") % 500).alias("outp"), (F.col("event_type") == "view").alias("human_turn"),
    )


#: An invoice that is a little larger than the logs: component, token expression, markup, price for pro and for others.
_BILL = (
    ("input_cache_hit_tokens", "hit", 1.1, 2.5e-8, 2e-8),
    ("input_cache_miss_tokens", "miss", 1.05, 3e-6, 1e-6),
    ("output_tokens", "o", 1.02, 6e-6, 2e-6),
)


def bill_view(usage: DataFrame) -> DataFrame:
    u = usage.where(F.col("model").startswith("deepseek")).groupBy(F.to_date("ts").alias("day"), "model").agg(F.sum("cr").alias("hit"), F.sum(F.col("cc") + F.col("inp")).alias("miss"), F.sum("outp").alias("o"))
    lines = F.array(*[
        F.struct(F.lit(t).alias("type"), F.when(F.col("model").contains("pro"), F.lit(pro)).otherwise(F.lit(other)).alias("price"), F.floor(F.col(c) * F.lit(m)).cast("long").alias("amount"))
        for t, c, m, pro, other in _BILL
    ])
    return u.select("day", "model", F.inline(lines))


#: Order keys of one chunk of the numbering of touches.
CHUNK_KEYS = 12_800
TOUCH_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_returnflag", "l_quantity")


def _session() -> Column:
    return F.col("l_orderkey") % 200


def _path() -> Column:
    return F.concat(F.lit("/repo/"), F.lower("l_returnflag"), F.lit("/"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/f"), (F.col("l_partkey") % 40).cast("string"), F.lit(".js"))


def path_view(lineitem: DataFrame) -> DataFrame:
    """Sessions and paths of the touches, once each: they need no order, so tasks group their rows before a shuffle."""
    return lineitem.select(_session().alias("session_id"), _path().alias("path")).distinct()


def touch_view(lineitem: DataFrame) -> DataFrame:
    """File touches for the path ledger, churn and directory roll-up.

    There are 200 sessions at any size, so rows are numbered in chunks of order keys, and only the chunks' counts meet by session.
    """
    keys, parts = ["_session", "_chunk"], tasks_for(lineitem, TOUCH_ROWS)
    # no remainder is -200: it stands for null, so that rows without a key meet their counts too
    rows = lineitem.withColumn("_session", F.coalesce(_session(), F.lit(-200))).withColumn("_chunk", F.coalesce(F.floor(F.col("l_orderkey") / CHUNK_KEYS), F.lit(0)))
    earlier = Window.partitionBy("_session").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys).count().select(*keys, F.sum("count").over(earlier).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = rows.select(*keys, *TOUCH_COLUMNS).repartition(parts, *keys)
    # all rows have counts, but a left join is left out where nobody reads ord; it would have dealt the rows by the session's number of partitions
    rows = rows.withColumn("_row", F.row_number().over(inside)).join(counts, keys, "left")
    op = F.when(F.col("l_linestatus") == "O", "lineUpdate").otherwise(F.when(F.col("l_linenumber") % 3 == 0, "fullSet").when(F.col("l_linenumber") % 3 == 1, "write").otherwise("editDelta"))
    touches = rows.select(
        _session().alias("session_id"), (F.coalesce("_before", F.lit(0)) + F.col("_row")).cast("long").alias("ord"), _path().alias("path"),
        op.alias("op"), F.col("l_quantity").cast("long").alias("line_no"), F.floor(F.col("l_extendedprice") / 100).cast("long").alias("tokens"),
    )
    return touches.repartition(parts, "session_id", "path")


#: The same views for DuckDB, as the start of a WITH clause.
USAGE_SQL = """
e AS (SELECT user_id AS session_id, event_id AS ord, ts, event_type, CAST(floor(value*100) AS BIGINT) AS v,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
  SUM(CASE WHEN event_type='signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events),
f AS (SELECT *, 20000 + SUM(v) OVER (PARTITION BY session_id, grp ORDER BY ord) AS stock FROM e),
usage_v AS (SELECT session_id, ord, ts,
  concat('m', CAST(session_id AS VARCHAR), '-', CAST(ord AS VARCHAR)) AS message_id,
  concat('p', CAST(session_id AS VARCHAR), '-', CAST(CAST(floor((rn-1)/2) AS BIGINT) AS VARCHAR)) AS pair_id,
  CASE session_id % 4 WHEN 0 THEN 'claude-opus-4-8' WHEN 1 THEN 'deepseek-v4-pro' WHEN 2 THEN 'deepseek-v4-flash' ELSE 'other-model' END AS model,
  CAST(CASE WHEN event_type='error' THEN 0 ELSE stock - v END AS BIGINT) AS cr,
  CAST(CASE WHEN event_type='error' THEN stock ELSE v END AS BIGINT) AS cc,
  ord % 50 AS inp, v % 500 AS outp, event_type='view' AS human_turn FROM f)"""

BILL_SQL = """
bu AS (SELECT CAST(ts AS DATE) AS day, model, SUM(cr) AS hit, SUM(cc+inp) AS miss, SUM(outp) AS o FROM usage_v WHERE model LIKE 'deepseek%' GROUP BY 1, 2),
bill_v AS (
  SELECT day, model, 'input_cache_hit_tokens' AS type, CASE WHEN model LIKE '%pro%' THEN 2.5e-8 ELSE 2e-8 END AS price, CAST(floor(hit*CAST(1.1 AS DOUBLE)) AS BIGINT) AS amount FROM bu
  UNION ALL SELECT day, model, 'input_cache_miss_tokens', CASE WHEN model LIKE '%pro%' THEN 3e-6 ELSE 1e-6 END, CAST(floor(miss*CAST(1.05 AS DOUBLE)) AS BIGINT) FROM bu
  UNION ALL SELECT day, model, 'output_tokens', CASE WHEN model LIKE '%pro%' THEN 6e-6 ELSE 2e-6 END, CAST(floor(o*CAST(1.02 AS DOUBLE)) AS BIGINT) FROM bu)"""

TOUCH_SQL = """
touch_v AS (SELECT l_orderkey % 200 AS session_id,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
  concat('/repo/', lower(l_returnflag), '/', CAST(l_suppkey % 7 AS VARCHAR), '/f', CAST(l_partkey % 40 AS VARCHAR), '.js') AS path,
  CASE l_linestatus WHEN 'O' THEN 'lineUpdate' ELSE CASE l_linenumber % 3 WHEN 0 THEN 'fullSet' WHEN 1 THEN 'write' ELSE 'editDelta' END END AS op,
  CAST(l_quantity AS BIGINT) AS line_no, CAST(floor(l_extendedprice/100) AS BIGINT) AS tokens FROM lineitem)"""
