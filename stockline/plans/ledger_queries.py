"""Path ledger, settlement, churn, attribution, directories and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockline.operators import ledger
from stockline.sources import tables as T

from .base import analysed, dealt, r6, round_sql, touches, with_calls, with_touches

P = "PARTITION BY session_id, path ORDER BY ord"
PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

LEDGER_SQL = f"""
l0 AS (SELECT *, sum(CASE WHEN op IN ('fullSet','write') THEN 1 ELSE 0 END) OVER ({P} ROWS UNBOUNDED PRECEDING) AS epoch FROM touch_v),
l1 AS (SELECT *, CASE WHEN op = 'editDelta' THEN 0 ELSE tokens - coalesce(last_value(CASE WHEN op <> 'editDelta' THEN tokens END IGNORE NULLS) OVER (PARTITION BY session_id, path, epoch, line_no ORDER BY ord {PREV}), 0) END AS dline FROM l0),
l2 AS (SELECT *, CAST(sum(dline) OVER w AS BIGINT) AS lines, CAST(sum(CASE WHEN op = 'editDelta' THEN tokens ELSE 0 END) OVER w AS BIGINT) AS edits FROM l1 WINDOW w AS (PARTITION BY session_id, path, epoch ORDER BY ord ROWS UNBOUNDED PRECEDING)),
l3 AS (SELECT *, greatest(0, lines+edits) AS path_tokens FROM l2),
ledger_v AS (SELECT *, path_tokens - coalesce(lag(path_tokens) OVER ({P}), 0) AS delta FROM l3)"""

REREAD_SQL = f"""
r0 AS (SELECT *, max(CASE WHEN op IN ('fullSet','write') THEN ord END) OVER w AS snap, max(CASE WHEN op = 'fullSet' THEN ord END) OVER w AS fread, max(CASE WHEN op IN ('editDelta','write') THEN ord END) OVER w AS ed FROM touch_v WINDOW w AS ({P} {PREV})),
reread_v AS (SELECT *, coalesce(op = 'fullSet' AND snap IS NOT NULL AND (ed IS NULL OR fread > ed) AND tokens > 0, false) AS reread FROM r0)"""

SNAPSHOT_SQL = f"""{LEDGER_SQL}, {REREAD_SQL},
s0 AS (SELECT session_id, path, arg_max(path_tokens, ord) AS tokens FROM ledger_v GROUP BY 1, 2),
s1 AS (SELECT session_id, path, sum(tokens) AS spent, count(*) FILTER (WHERE op NOT IN ('editDelta','write')) AS n_reads, count(*) FILTER (WHERE op IN ('editDelta','write')) AS n_edits, max(ord) AS last_ord, count(*) FILTER (WHERE reread) AS pure_rereads FROM reread_v GROUP BY 1, 2),
s2 AS (SELECT session_id, path, tokens, CAST(greatest(tokens, spent) AS DOUBLE) AS spent, n_reads, n_edits, last_ord, pure_rereads FROM s0 JOIN s1 USING (session_id, path) WHERE tokens > 0),
s3 AS (SELECT *, spent/tokens AS churn, CAST(floor(100*tokens/spent+0.5) AS BIGINT) AS efficiency FROM s2),
snap_v AS (SELECT *, CASE WHEN spent-tokens >= 2500 AND (pure_rereads >= 2 OR churn > 5) THEN 'coral' WHEN churn >= 3 THEN 'amber' ELSE 'mint' END AS tier FROM s3)"""


def _snapshot(spark, sf):
    return ledger.path_snapshot(touches(spark, sf))


def _deltas(spark, sf):
    """Growth of B by touches against a growth of L that lags behind it."""
    rows = dealt(spark, sf, ledger.path_ledger(touches(spark, sf)).select("session_id", "ord", "path", "delta"), "session_id")
    late = F.coalesce(F.lag("delta", 3).over(Window.partitionBy("session_id").orderBy("ord")), F.lit(0))
    return rows.select("session_id", "ord", "path", F.col("delta").alias("db"), F.greatest(F.lit(0), late).alias("dl"), F.greatest(F.lit(0), F.col("delta")).alias("pos_total"))


DELTAS_SQL = LEDGER_SQL + """,
d0 AS (SELECT session_id, ord, path, CAST(delta AS DOUBLE) AS db, CAST(greatest(0, coalesce(lag(delta, 3) OVER (PARTITION BY session_id ORDER BY ord), 0)) AS DOUBLE) AS dl, CAST(greatest(0, delta) AS DOUBLE) AS pos FROM ledger_v),
d1 AS (SELECT *, least(greatest(0, db-dl), pos) - greatest(0, dl-db) AS e FROM d0),
d2 AS (SELECT *, sum(e) OVER (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS sm FROM d1),
d3 AS (SELECT *, sm - least(0, min(sm) OVER (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) AS deferred FROM d2),
settle_v AS (SELECT *, greatest(0, deferred - coalesce(lag(deferred) OVER (PARTITION BY session_id ORDER BY ord), 0) - e) AS residual FROM d3)"""


def _tools(spark, sf):
    rows = analysed(spark, sf)
    calls = rows.select("session_id", "folded_seq", F.coalesce("residual", F.lit(0.0)).alias("residual"))
    kinds = F.array(F.struct(F.lit("bash").alias("kind"), (F.col("outp") % 5).alias("weight")), F.struct(F.lit("mcp").alias("kind"), (F.col("inp") % 3).alias("weight")))
    events = rows.select("session_id", "folded_seq", "model", F.inline(kinds)).select("session_id", "folded_seq", F.concat_ws(" ", "kind", "model").alias("key"), "kind", "weight")
    return ledger.residual_by_tool(calls, events)


TOOLS_SQL = """
, ev AS (SELECT session_id, folded_seq, coalesce(residual, 0) AS residual, 'bash' AS kind, 'bash '||model AS key, outp % 5 AS weight FROM calls_v UNION ALL SELECT session_id, folded_seq, coalesce(residual, 0), 'mcp', 'mcp '||model, inp % 3 FROM calls_v),
sh AS (SELECT *, CASE WHEN sum(weight) OVER w > 0 THEN weight/CAST(sum(weight) OVER w AS DOUBLE) ELSE 1/CAST(count(*) OVER w AS DOUBLE) END AS share FROM ev WINDOW w AS (PARTITION BY session_id, folded_seq)),
tool_v AS (SELECT session_id, key, kind, sum(residual*share) AS tokens, count(*) AS count FROM sh GROUP BY 1, 2, 3)"""


def _assigned(side):
    def query(spark, sf):
        rows = analysed(spark, sf)
        calls = rows.where("ord % 3 = 0").select("session_id", "ord", "folded_seq")
        events = rows.where("ord % 3 <> 0").select("session_id", "ord", "message_id")
        return ledger.assign_to_calls(events, calls, side)

    return query


def _assigned_sql(side):
    pick = "first_value" if side == "next" else "last_value"
    frame = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING" if side == "next" else "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return with_calls(f""", b AS (SELECT session_id, ord, message_id, ord % 3 <> 0 AS event, {pick}(CASE WHEN ord % 3 = 0 THEN folded_seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ord {frame}) AS folded_seq FROM calls_v)
      SELECT session_id, ord, message_id, folded_seq FROM b WHERE event""")


def _selection(spark, sf):
    rows = _snapshot(spark, sf).select("session_id", "path", "tokens", F.col("path").contains("/r/").alias("fixed"), (F.col("tokens") % 3 > 0).alias("by_default"))
    overrides = rows.where("tokens % 7 = 0").select("session_id", "path", F.lit(True).alias("selected"))
    return rows, overrides


def _directory_state(spark, sf):
    rows, overrides = _selection(spark, sf)
    chosen = rows.join(overrides, ["session_id", "path"], "left")
    return ledger.directory_state(chosen.select("session_id", "path", (~F.col("fixed")).alias("selectable"), F.coalesce("selected", "by_default").alias("on")))


def _by_path(spark, sf):
    rows = _deltas(spark, sf)
    return ledger.settle_by_path(rows.drop("path"), rows.select("session_id", "ord", "path", F.col("db").alias("delta")))


SNAP = ("session_id", "path", "tokens", "spent", "churn", "efficiency", "n_reads", "n_edits", "last_ord", "pure_rereads", "tier")

QUERIES = {
    "path_ledger": (lambda s, d: ledger.path_ledger(touches(s, d)).select("session_id", "ord", "epoch", "lines", "edits", "path_tokens", "delta"), with_touches(f", {LEDGER_SQL} SELECT session_id, ord, epoch, lines, edits, path_tokens, delta FROM ledger_v")),
    "running_b": (lambda s, d: ledger.running_b(dealt(s, d, ledger.path_ledger(touches(s, d)).select("session_id", "ord", "delta"), "session_id"), 20000).select("session_id", "ord", "b"), with_touches(f", {LEDGER_SQL} SELECT session_id, ord, CAST(20000 + sum(delta) OVER (PARTITION BY session_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM ledger_v")),
    "pure_rereads": (lambda s, d: ledger.pure_rereads(touches(s, d)).select("session_id", "ord", "reread"), with_touches(f", {REREAD_SQL} SELECT session_id, ord, reread FROM reread_v")),
    "touch_counts": (lambda s, d: ledger.touch_counts(touches(s, d)), with_touches("SELECT session_id, path, count(*) FILTER (WHERE op NOT IN ('editDelta','write')) AS n_reads, count(*) FILTER (WHERE op IN ('editDelta','write')) AS n_edits, max(ord) AS last_ord FROM touch_v GROUP BY 1, 2")),
    "touch_lists": (lambda s, d: ledger.touch_lists(touches(s, d), 4).selectExpr("session_id", "path", "array_join(transform(touches, x -> concat(x.seq, x.mode)), ',') AS touches"), with_touches("""
      , k AS (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY ord DESC) AS n FROM touch_v) SELECT session_id, path, string_agg(concat(CAST(ord AS VARCHAR), CASE WHEN op IN ('editDelta','write') THEN 'w' ELSE 'r' END), ',' ORDER BY ord) AS touches FROM k WHERE n <= 4 GROUP BY 1, 2""")),
    "path_snapshot": (lambda s, d: r6(_snapshot(s, d).select(*SNAP), "spent", "churn"), with_touches(f", {SNAPSHOT_SQL} SELECT session_id, path, tokens, {round_sql('spent', 'churn')}, efficiency, n_reads, n_edits, last_ord, pure_rereads, tier FROM snap_v")),
    "settle_deferred": (lambda s, d: r6(ledger.settle_deferred(_deltas(s, d)).select("session_id", "ord", "deferred", "residual"), "deferred", "residual"), with_touches(f", {DELTAS_SQL} SELECT session_id, ord, {round_sql('deferred', 'residual')} FROM settle_v")),
    "settle_by_path": (lambda s, d: r6(_by_path(s, d), "deferred"), with_touches(f""", {DELTAS_SQL},
      p0 AS (SELECT *, coalesce(lag(deferred) OVER (PARTITION BY session_id ORDER BY ord), 0) AS prior FROM settle_v),
      p1 AS (SELECT *, CASE WHEN prior > 0 THEN 1 - least(prior, greatest(0, dl-db))/prior ELSE 1 END AS stay, least(greatest(0, db-dl), pos) AS banked FROM p0),
      p2 AS (SELECT *, coalesce(max(CASE WHEN stay <= 1e-12 THEN 1 ELSE 0 END) OVER w, 0) AS drained, exp(coalesce(sum(CASE WHEN stay > 1e-12 THEN ln(stay) END) OVER w, 0)) AS rest FROM p1 WINDOW w AS (PARTITION BY session_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
      SELECT session_id, path, round(sum(CASE WHEN drained = 1 THEN 0 ELSE banked*rest*db/pos END), 6) AS deferred FROM p2 WHERE db > 0 GROUP BY 1, 2""")),
    "residual_by_tool": (lambda s, d: r6(_tools(s, d), "tokens"), with_calls(f"{TOOLS_SQL} SELECT session_id, key, kind, round(tokens, 6) AS tokens, count FROM tool_v")),
    "assign_next_call": (_assigned("next"), _assigned_sql("next")),
    "assign_previous_call": (_assigned("previous"), _assigned_sql("previous")),
    "event_ordinals": (lambda s, d: ledger.event_ordinals(_assigned("next")(s, d)).select("session_id", "ord", "folded_seq", "event_ordinal"), _assigned_sql("next").replace("SELECT session_id, ord, message_id, folded_seq FROM b WHERE event", "SELECT session_id, ord, folded_seq, row_number() OVER (PARTITION BY session_id, folded_seq ORDER BY ord) - 1 AS event_ordinal FROM b WHERE event")),
    "top_buckets": (lambda s, d: ledger.top_buckets(ledger.buckets(_snapshot(s, d), r6(_tools(s, d), "tokens")), 5), with_calls(f"""{TOOLS_SQL}, {T.TOUCH_SQL}, {SNAPSHOT_SQL},
      u AS (SELECT session_id, path AS key, 'path' AS kind, CAST(tokens AS DOUBLE) AS tokens FROM snap_v UNION ALL SELECT session_id, key, kind, round(tokens, 6) FROM tool_v),
      k AS (SELECT *, row_number() OVER (PARTITION BY session_id, kind ORDER BY tokens DESC, key) AS rank FROM u) SELECT * FROM k WHERE rank <= 5""")),
    "b_default": (lambda s, d: ledger.b_default(_snapshot(s, d), F.col("path").contains("/r/"), 20000), with_touches(f", {SNAPSHOT_SQL} SELECT session_id, CAST(sum(CASE WHEN contains(path, '/r/') THEN 0 ELSE tokens END) + 20000 AS BIGINT) AS b_default, CAST(sum(tokens) AS BIGINT) AS b_total FROM snap_v GROUP BY 1")),
    "directory_rollup": (lambda s, d: ledger.directory_rollup(_snapshot(s, d)), with_touches(f""", {SNAPSHOT_SQL},
      x AS (SELECT session_id, tokens, CASE tier WHEN 'mint' THEN 1 WHEN 'amber' THEN 2 ELSE 3 END AS rk, string_split(path, '/') AS p FROM snap_v),
      y AS (SELECT session_id, tokens, rk, unnest([0, 1, 2, 3]) AS level, p FROM x),
      z AS (SELECT session_id, level, CASE level WHEN 0 THEN '/' WHEN 1 THEN '/'||p[2] WHEN 2 THEN '/'||p[2]||'/'||p[3] ELSE '/'||p[2]||'/'||p[3]||'/'||p[4] END AS dir, sum(tokens) AS tokens, count(*) AS n_paths, max(rk) AS rk, count(*) FILTER (WHERE level = 3) AS n_own FROM y GROUP BY ALL),
      rt AS (SELECT *, max(CASE WHEN n_paths = mx THEN level END) OVER (PARTITION BY session_id) AS root FROM (SELECT *, max(n_paths) OVER (PARTITION BY session_id) AS mx FROM z)),
      ch AS (SELECT session_id, CASE WHEN level = 1 THEN '/' ELSE regexp_replace(dir, '/[^/]*$', '') END AS dir, count(*) AS n_children FROM z WHERE level > 0 GROUP BY 1, 2)
      SELECT rt.session_id, rt.dir, level, CAST(tokens AS BIGINT) AS tokens, n_paths, CASE rk WHEN 1 THEN 'mint' WHEN 2 THEN 'amber' ELSE 'coral' END AS tier FROM rt LEFT JOIN ch ON rt.session_id = ch.session_id AND rt.dir = ch.dir
      WHERE level >= root AND level <= root+3 AND (n_own > 0 OR coalesce(n_children, 0) <> 1)""")),
    "selection_totals": (lambda s, d: r6(ledger.selection_totals(*_selection(s, d)), "selected_share"), with_touches(f""", {SNAPSHOT_SQL},
      c AS (SELECT session_id, tokens, contains(path, '/r/') AS fixed, tokens % 3 > 0 AS bd, CASE WHEN tokens % 7 = 0 THEN true ELSE tokens % 3 > 0 END AS sel FROM snap_v),
      g AS (SELECT session_id, CAST(sum(CASE WHEN fixed THEN tokens ELSE 0 END) AS BIGINT) AS fixed, CAST(sum(CASE WHEN NOT fixed AND sel THEN tokens ELSE 0 END) AS BIGINT) AS selected, CAST(sum(CASE WHEN NOT fixed AND NOT sel THEN tokens ELSE 0 END) AS BIGINT) AS discarded,
        CAST(sum(CASE WHEN fixed OR bd THEN tokens ELSE 0 END) AS BIGINT) AS b_default, max(sel <> bd) AS dirty FROM c GROUP BY 1)
      SELECT *, round(selected/CAST(fixed+selected+discarded AS DOUBLE), 6) AS selected_share, greatest(1000, fixed+selected) AS b_preview FROM g""")),
    "directory_state": (_directory_state, with_touches(f""", {SNAPSHOT_SQL},
      c AS (SELECT session_id, string_split(path, '/') AS p, CASE WHEN tokens % 7 = 0 THEN true ELSE tokens % 3 > 0 END AS sel FROM snap_v WHERE NOT contains(path, '/r/')),
      x AS (SELECT session_id, sel, unnest(['/', '/'||p[2], '/'||p[2]||'/'||p[3], '/'||p[2]||'/'||p[3]||'/'||p[4]]) AS dir FROM c)
      SELECT session_id, dir, CASE WHEN count(*) FILTER (WHERE sel) = 0 THEN 'unchecked' WHEN count(*) FILTER (WHERE sel) = count(*) THEN 'checked' ELSE 'half' END AS state FROM x GROUP BY 1, 2""")),
}
