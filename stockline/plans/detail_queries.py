"""Prices, marks, meters, restarts, hand-over tables, ancestors and text rules that no other query shows, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockline.functions import economics as E
from stockline.functions import models as M
from stockline.functions import text as X
from stockline.operators import billing, calls, corpus, handoff, ledger, profiles, tools, tree
from stockline.sources import tables as T

from .base import analysed, dealt, metered, paths_of, positioned, r6, round_sql, touches, usage, with_calls, with_meter, with_positions, with_touches, with_usage
from .table_queries import HANDOFF_SQL, LJUNG_SQL, _handoffs, _loads
from .tree_queries import TREE_SQL, _entries

KEY = ["session_id", "ord"]
DAY = "1998-06-01 00:00:00"


def effective_price(spark, sf):
    """Parts as models: presets, saved and session overrides by their sizes; an override with a write price of 0 is not valid."""
    p = T.read(spark, sf, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model"), (F.col("p_retailprice") / 1000).alias("x"), F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    priced = lambda rows, read, write: rows.select("model", read.alias("read_price"), write.alias("write_price"))
    x, s = F.col("x"), F.col("s")
    found = handoff.effective_price(p.select("model"), priced(p.where("k % 3 = 0"), x * 0.9, x * 0.9 * (s % 3)), priced(p.where("k % 4 = 0"), x * 1.2, x * 2.4), priced(p.where("s % 7 <> 0"), x, x * (1 + s % 5)))
    return r6(found, "read_price", "write_price", "ratio")


PRICE_SQL = """WITH p AS (SELECT concat('m', p_partkey) AS model, p_retailprice/1000 AS x, p_partkey AS k, p_size AS s FROM part),
j AS (SELECT model, CASE WHEN k % 3 = 0 AND s % 3 > 0 THEN 'saved' WHEN k % 4 = 0 THEN 'session' WHEN s % 7 <> 0 THEN 'preset' END AS source, CASE WHEN s % 7 <> 0 THEN x END AS pr, CASE WHEN s % 7 <> 0 THEN x*(1 + s % 5) END AS pw, x, s FROM p),
v AS (SELECT *, CASE source WHEN 'saved' THEN x*CAST(0.9 AS DOUBLE) WHEN 'session' THEN x*CAST(1.2 AS DOUBLE) WHEN 'preset' THEN pr END AS r, CASE source WHEN 'saved' THEN x*CAST(0.9 AS DOUBLE)*(s % 3) WHEN 'session' THEN x*CAST(2.4 AS DOUBLE) WHEN 'preset' THEN pw END AS w FROM j)
SELECT model, round(r, 6) AS read_price, round(w, 6) AS write_price, round(w/r, 6) AS ratio, coalesce(abs(r-pr) > 1e-9 OR abs(w-pw) > 1e-9, true) AS drifted, source FROM v"""


def ignore_rules(spark, sf):
    """Regions ignore folders, nations ignore files or take them back; the later rule decides."""
    nation, region = T.read(spark, sf, "nation"), T.read(spark, sf, "region")
    rules = nation.select(F.concat(F.lit("/f"), F.col("n_nationkey").cast("string"), F.lit("[.]js$")).alias("pattern"), (F.col("n_nationkey") + 10).cast("long").alias("priority"), (F.col("n_nationkey") % 2 == 0).alias("negated")).unionByName(
        region.select(F.concat(F.lit("^/repo/[an]/"), F.col("r_regionkey").cast("string"), F.lit("/")).alias("pattern"), F.col("r_regionkey").cast("long").alias("priority"), F.lit(False).alias("negated"))
    )
    return handoff.apply_ignore_rules(paths_of(spark, sf), rules)


IGNORE_SQL = with_touches(""", p AS (SELECT DISTINCT path FROM touch_v),
rules AS (SELECT '/f'||n_nationkey||'[.]js$' AS pattern, n_nationkey+10 AS priority, n_nationkey % 2 = 0 AS negated FROM nation UNION ALL SELECT '^/repo/[an]/'||r_regionkey||'/', r_regionkey, false FROM region),
m AS (SELECT path, arg_max(NOT negated, priority) AS ignored FROM p JOIN rules ON regexp_matches(path, pattern) GROUP BY 1)
SELECT p.path, coalesce(ignored, false) AS ignored FROM p LEFT JOIN m ON p.path = m.path""")


def restart_values(spark, sf):
    """What expired caches do to R and n*, what restarts every 50 calls cost, and what continuity was worth, for each call."""
    p = positioned(spark, sf)
    r, length, g, b = (F.col(c) for c in ("r", "l", "g", "dead"))
    curve = E.cost_curve(F.lit(50), r, length, g)
    cols = {"r_effective": E.effective_ratio(r, F.lit(0.2), F.lit(0.5)), "n_effective": E.effective_order_quantity(curve["n_star"], r, F.lit(0.72)), **curve, "value": E.revealed_value(F.col("burn"), F.lit(3), b)}
    return r6(p.select(*KEY, *[c.alias(n) for n, c in cols.items()]), *cols)


RESTART_SQL = with_positions(f"""
, n AS (SELECT *, CASE WHEN g > 0 AND r > 0 AND l > 0 THEN sqrt(2*r*l/g) END AS n_star FROM pos_v),
v AS (SELECT *, r/(1+CAST(0.2 AS DOUBLE)*CAST(0.5 AS DOUBLE)*(r-1)) AS r_effective, n_star*sqrt((1+(r-1)*CAST(0.72 AS DOUBLE))/r) AS n_effective, r*l/50+l+g*50/2 AS cost,
  (50/n_star+1/(50/n_star)-2)/2*sqrt(2*r*l*g) AS regret, (burn-1)*3*dead AS value FROM n)
SELECT session_id, ord, {round_sql("r_effective", "n_effective", "cost", "n_star", "regret", "value")} FROM v""")


def next_marks(spark, sf):
    """The next mark of each call; every third session has no red one."""
    p = positioned(spark, sf)
    at = lambda f: F.col("dead") * (1 + f * F.col("dhat"))
    mark = E.next_threshold(F.col("l"), at(0.5), at(1.0), F.when(F.col("session_id") % 3 > 0, at(2.0)))
    return r6(p.select(*KEY, mark["kind"].alias("kind"), mark["value"].alias("value")), "value")


MARKS_SQL = with_positions("""
, m AS (SELECT *, dead*(1+CAST(0.5 AS DOUBLE)*dhat) AS entry, dead*(1+CAST(1 AS DOUBLE)*dhat) AS amber, CASE WHEN session_id % 3 > 0 THEN dead*(1+CAST(2 AS DOUBLE)*dhat) END AS red FROM pos_v),
k AS (SELECT *, CASE WHEN l < entry THEN 'entry' WHEN l < amber THEN 'amber' WHEN red IS NOT NULL THEN 'red' WHEN amber IS NOT NULL THEN 'amber' END AS kind FROM m)
SELECT session_id, ord, kind, round(CASE kind WHEN 'entry' THEN entry WHEN 'amber' THEN amber WHEN 'red' THEN red END, 6) AS value FROM k""")


def rent_meter(spark, sf):
    """Rent and depth of each call, what a stop would be about, and whether the marks grow; cycles stand for deep-water bills."""
    m = metered(spark, sf)
    d = F.col("dhat")
    rent = E.rent_meter(F.col("cycles"), F.col("mf"), d, F.col("r"), F.col("new_cycles"))
    stop = E.stop_kind(F.col("burn"), F.col("gate_fires"), F.col("new_cycles") > 0)
    return r6(m.select(*KEY, *[c.alias(n) for n, c in rent.items()], stop.alias("stop"), E.landmarks_ok(1 + 0.5 * d, 1 + d, 1 + 2 * d).alias("marks_ok")), "depth_progress", "sweet_rent_rate")


RENT_SQL = with_meter("""
, u AS (SELECT *, CASE WHEN mf > 0 THEN (2*(mf+CAST(0.1 AS DOUBLE))+sqrt(4*(mf+CAST(0.1 AS DOUBLE))*(mf+CAST(0.1 AS DOUBLE))-4*mf*mf))/(2*mf) END AS ub FROM meter_v)
SELECT session_id, ord, round(CASE WHEN ub IS NULL THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), cycles/(ub*ub)) END, 6) AS depth_progress, round(dhat/r, 6) AS sweet_rent_rate, coalesce(new_cycles >= 3, false) AS depth_hot,
  CASE WHEN coalesce(burn >= 1, false) THEN 'wall' WHEN gate_fires THEN 'gate' WHEN new_cycles > 0 THEN 'backstop' END AS stop, dhat > 0 AS marks_ok FROM u""")


def reasoning_spend(spark, sf):
    """Touches as blocks of entries: every third is a tool use in a folder, the others are text and thinking."""
    kind = F.when(F.col("ord") % 3 == 1, "tool").when(F.col("ord") % 3 == 2, "text").otherwise("thinking")
    path = F.when((F.col("ord") % 3 == 1) & (F.col("op") != "editDelta"), F.substring("path", 1, 7))
    return ledger.reasoning_spend(touches(spark, sf).select("session_id", F.floor(F.col("ord") / 12).alias("entry_ord"), F.col("ord").alias("block_pos"), kind.alias("kind"), path.alias("path"), F.col("tokens").alias("n_chars")))


REASONING_SQL = with_touches("""
, b AS (SELECT session_id, ord // 12 AS entry_ord, ord, ord % 3 = 1 AS tool, CASE WHEN ord % 3 = 1 THEN CASE WHEN op <> 'editDelta' THEN substr(path, 1, 7) ELSE '' END END AS k, tokens FROM touch_v),
w AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY session_id, entry_ord ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kb, first_value(k IGNORE NULLS) OVER (PARTITION BY session_id, entry_ord ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ka FROM b)
SELECT session_id, entry_ord, ka AS path, CAST(sum(tokens) AS BIGINT) AS n_chars FROM w WHERE NOT tool AND ka = kb AND ka <> '' GROUP BY 1, 2, 3""")


def ledger_errors(spark, sf):
    """Ledger rows from the meter, some with values out of range."""
    m, n = metered(spark, sf), F.col("ord")
    rows = m.select(
        *KEY, (F.col("progress") + (n % 13 == 0).cast("int")).alias("bill_progress"), F.col("cycles").alias("bill_cycles"), (F.col("new_cycles") - (n % 7 == 0).cast("int")).alias("dw_bills"), (F.col("cycles") - (n % 11 == 0).cast("int")).alias("laps"),
        F.when(n % 17 != 0, F.col("folded_seq")).alias("last_seq"), F.when(n % 5 == 0, "cache_unstable").when(n % 5 == 1, "tired").alias("paused_reason"), F.array_repeat(n, (n % 40).cast("int")).alias("recent_events"),
    )
    return rows.select(*KEY, F.concat_ws(",", billing.ledger_errors()).alias("errors"))


LEDGER_ERRORS_SQL = with_meter("""SELECT session_id, ord, concat_ws(',', CASE WHEN ord % 13 = 0 THEN 'bill_progress' END, CASE WHEN cycles < 0 THEN 'bill_cycles' END, CASE WHEN new_cycles - CASE WHEN ord % 7 = 0 THEN 1 ELSE 0 END < 0 THEN 'dw_bills' END,
  CASE WHEN cycles - CASE WHEN ord % 11 = 0 THEN 1 ELSE 0 END < 0 THEN 'laps' END, CASE WHEN ord % 17 = 0 THEN 'last_seq' END, CASE WHEN ord % 5 = 1 THEN 'paused_reason' END, CASE WHEN ord % 40 > 32 THEN 'recent_events' END) AS errors FROM meter_v""")


def session_names(spark, sf):
    """Session ids and transcript files from paths: names, names with folders and with two dots, files of sub-agents."""
    p = paths_of(spark, sf).select("path").distinct()
    n, name = F.length("path") % 3, F.regexp_extract("path", "[^/]+$", 0)
    id_ = F.when(n == 0, name).when(n == 1, F.col("path")).otherwise(F.concat(F.lit("s.."), name))
    file = F.when(n == 1, F.concat(F.col("path"), F.lit("/subagents/agent.jsonl"))).otherwise(F.concat(F.col("path"), F.lit(".jsonl")))
    s = X.session_of(file)
    return p.select("path", X.valid_session_id(id_).alias("valid"), s["session_id"].alias("session"), s["is_sub_agent"].alias("is_sub_agent"), M.tier_flag(F.lit(None).cast("boolean"), file).alias("tier"))


NAMES_SQL = with_touches("""SELECT DISTINCT path, length(path) % 3 = 0 AS valid, regexp_extract(path, '[^/]+$') AS session, length(path) % 3 = 1 AS is_sub_agent, CASE WHEN length(path) % 3 = 1 THEN 'sub' ELSE 'agent' END AS tier FROM touch_v""")


def main_calls(spark, sf):
    """Calls outside of side chains, per session."""
    side = F.when(F.col("outp") % 5 == 0, True).when(F.col("outp") % 5 == 1, None).otherwise(False)
    return calls.main_only(usage(spark, sf).withColumn("is_sidechain", side)).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("outp").alias("outp"))


def search_join(spark, sf):
    """Order lines as hits on the hand-overs of one project."""
    hits = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("handoff_id"), F.col("l_linenumber").cast("long").alias("rank"))
    return handoff.search_join(hits, _handoffs(spark, sf), 3).select("handoff_id", "rank", "project_id", "next_task")


def upsert_handoffs(spark, sf):
    """Two thirds of the hand-overs are there; others, and later versions of some, come in."""
    h = _handoffs(spark, sf)
    later = lambda rows, days: rows.withColumn("created_at", F.col("created_at") + F.expr(f"INTERVAL {days} DAYS"))
    new = later(h.where("handoff_id % 3 <> 1"), 1).unionByName(later(h.where("handoff_id % 5 = 0"), 2))
    return handoff.upsert_handoffs(h.where("handoff_id % 3 <> 0"), new).select("handoff_id", "created_at", F.col("delivered_at").isNotNull().alias("delivered"))


UPSERT_SQL = f"""WITH {HANDOFF_SQL}, ex AS (SELECT * FROM h WHERE handoff_id % 3 <> 0),
nw AS (SELECT handoff_id, created_at + INTERVAL 1 DAY AS created_at, delivered_at FROM h WHERE handoff_id % 3 <> 1 UNION ALL SELECT handoff_id, created_at + INTERVAL 2 DAY, delivered_at FROM h WHERE handoff_id % 5 = 0),
tk AS (SELECT handoff_id, max(created_at) AS created_at, bool_or(delivered_at IS NOT NULL) AS delivered FROM nw WHERE handoff_id NOT IN (SELECT handoff_id FROM ex WHERE delivered_at IS NOT NULL) GROUP BY 1)
SELECT handoff_id, created_at, delivered_at IS NOT NULL AS delivered FROM ex WHERE handoff_id NOT IN (SELECT handoff_id FROM tk) UNION ALL SELECT * FROM tk"""


def append_loads(spark, sf):
    """Load attempts that come in twice, some of them there already: attempts of each hand-over."""
    rows = _loads(spark, sf)
    new = rows.where("load_id % 2 = 0")
    return handoff.append_loads(rows.where("load_id % 3 <> 0").drop("load_id"), new.unionByName(new).drop("load_id")).groupBy("handoff_id").agg(F.count("*").alias("n"))


APPEND_SQL = """WITH g AS (SELECT l_orderkey AS handoff_id, l_orderkey*10+l_linenumber AS load_id, min(l_partkey % 5) AS session_id, min(l_shipdate) AS loaded_at FROM lineitem GROUP BY 1, 2),
ex AS (SELECT handoff_id, session_id, loaded_at FROM g WHERE load_id % 3 <> 0), nw AS (SELECT DISTINCT handoff_id, session_id, loaded_at FROM g WHERE load_id % 2 = 0)
SELECT handoff_id, count(*) AS n FROM (SELECT * FROM ex UNION ALL SELECT * FROM nw ANTI JOIN ex USING (handoff_id, session_id, loaded_at)) GROUP BY 1"""


def handoff_errors(spark, sf):
    """Documents as summaries and next tasks, with 0 to 59 paths."""
    d = T.read(spark, sf, "documents")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("text")).otherwise("  ").alias("summary"), F.col("text").alias("next_task"), F.array_repeat(F.lit("p"), (F.col("doc_id") % 60).cast("int")).alias("paths"))
    return handoff.validate_handoffs(rows).select("doc_id", "error")


HANDOFF_ERRORS_SQL = f"""SELECT doc_id, CASE WHEN doc_id % 60 > {handoff.MAX_PATHS} THEN 'too_many_paths' WHEN doc_id % 9 = 0 OR length(trim(coalesce(text, ''))) = 0 THEN 'summary_missing' WHEN length(text) > {handoff.MAX_SUMMARY} THEN 'summary_too_long'
  WHEN length(text) > {handoff.MAX_NEXT_TASK} THEN 'next_task_too_long' END AS error FROM documents"""


def subtree_paths(spark, sf):
    """The branch of each root down its last-added children."""
    return tree.subtree_paths(tree.tree_edges(_entries(spark, sf))).select("session_id", "root_ord", "uuid")


SUBTREE_SQL = TREE_SQL + """, rt AS (SELECT session_id, uuid, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS root_ord FROM e WHERE parent IS NULL),
br(session_id, root_ord, uuid) AS (SELECT session_id, root_ord, uuid FROM rt UNION ALL SELECT br.session_id, root_ord, k.child FROM br JOIN k ON br.session_id = k.session_id AND br.uuid = k.parent) SELECT * FROM br"""


def is_ancestor(spark, sf):
    """Is a turn's entry below the one at half its number, and is a forked entry above the turn after it?"""
    e = _entries(spark, sf)
    turn = F.substring("uuid", 2, 9).cast("long")
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    own = F.col("uuid").startswith("u")
    pairs = e.select("session_id", F.when(own, name("u", F.floor(turn / 2))).otherwise(F.col("uuid")).alias("ancestor"), F.when(own, F.col("uuid")).otherwise(name("u", turn + 1)).alias("uuid"))
    return tree.is_ancestor(tree.tree_edges(e), pairs)


ANCESTOR_SQL = TREE_SQL + """, an(session_id, uuid, ancestor) AS (SELECT session_id, uuid, parent FROM e WHERE parent IS NOT NULL UNION ALL SELECT an.session_id, an.uuid, e.parent FROM an JOIN e ON an.session_id = e.session_id AND an.ancestor = e.uuid WHERE e.parent IS NOT NULL),
pr AS (SELECT DISTINCT session_id, CASE WHEN uuid LIKE 'u%' THEN 'u'||(CAST(substr(uuid, 2) AS BIGINT) // 2) ELSE uuid END AS ancestor, CASE WHEN uuid LIKE 'u%' THEN uuid ELSE 'u'||(CAST(substr(uuid, 2) AS BIGINT)+1) END AS uuid FROM e)
SELECT pr.session_id, pr.uuid, pr.ancestor, an.uuid IS NOT NULL AS is_ancestor FROM pr LEFT JOIN (SELECT DISTINCT * FROM an) an ON pr.session_id = an.session_id AND pr.uuid = an.uuid AND pr.ancestor = an.ancestor"""


def waiting_uses(spark, sf):
    """Calls as tool uses; every third waits for its result."""
    c = analysed(spark, sf).select("session_id", F.col("ord").alias("id"), "turn_seq")
    return tools.drop_unanswered(c, c.where("id % 3 <> 0"), c.groupBy("session_id").agg(F.max("turn_seq").alias("turn_seq"))).select("session_id", "id", "turn_seq")


def load_tokens(spark, sf):
    """Steps of calls, some with a load token, others with that of a hand-over tool's result."""
    c = calls.number_calls(usage(spark, sf))
    steps = c.select("session_id", "folded_seq", F.when(F.col("ord") % 9 == 0, F.concat(F.lit("t"), F.col("ord").cast("string"))).alias("load_token"))
    name = F.when(F.col("ord") % 4 == 0, "mcp__desk__load_handoff").otherwise("Bash")
    events = c.select("session_id", "folded_seq", name.alias("name"), F.to_json(F.struct(F.concat(F.lit("r"), F.col("ord").cast("string")).alias("load_token"))).alias("result_text"))
    return tools.backfill_load_tokens(steps, events).select("session_id", "folded_seq", "load_token")


def skill_texts(spark, sf):
    """Assistant turns as skill uses, the next turn as the text that the skill brought in."""
    c = T.read(spark, sf, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumnRenamed("conv_id", "session_id")
    use = lambda t: F.concat(F.lit("t"), t.cast("string"))
    events = c.where("role = 'assistant'").select("session_id", use(F.col("turn")).alias("id"))
    entries = c.select("session_id", F.col("turn").alias("ord"), (F.col("role") != "assistant").alias("is_meta"), use(F.col("turn") - 1).alias("source_tool_use_id"), F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))).alias("content"))
    return tools.attach_skill_content(events, entries).groupBy("session_id", "id").agg(F.md5(F.max("skill_text")).alias("skill"))


SKILL_SQL = """WITH ev AS (SELECT DISTINCT conv_id AS session_id, turn FROM conversations WHERE role = 'assistant'), en AS (SELECT conv_id AS session_id, turn-1 AS turn, max(coalesce(text, '')) AS t FROM conversations WHERE role <> 'assistant' GROUP BY 1, 2)
SELECT ev.session_id, 't'||ev.turn AS id, md5(t) AS skill FROM ev LEFT JOIN en ON ev.session_id = en.session_id AND ev.turn = en.turn"""


def search_spend(spark, sf):
    """Touches in operations of four; every third operation has one cost that its files share, every sixth an overhead too."""
    event = F.floor(F.col("ord") / 4)
    rows = dealt(spark, sf, touches(spark, sf).withColumn("event_id", event), "session_id", "event_id")
    return r6(ledger.touch_spend(rows.withColumn("event_spent", F.when(event % 3 == 0, 500.0)).withColumn("event_overhead", F.when(event % 6 == 0, 40.0))), "spent")


SPEND_SQL = with_touches(""", n AS (SELECT session_id, ord // 4 AS event, count(DISTINCT path) AS n_files, sum(tokens) AS whole FROM touch_v GROUP BY 1, 2), f AS (SELECT session_id, ord // 4 AS event, path, count(*) AS n_rows FROM touch_v GROUP BY 1, 2, 3),
s AS (SELECT t.session_id, t.path, CASE WHEN n.event % 3 = 0 THEN CAST(500 AS DOUBLE)*(tokens/CAST(whole AS DOUBLE)) + CASE WHEN n.event % 6 = 0 THEN CAST(40 AS DOUBLE)/n_files/n_rows ELSE 0 END ELSE abs(tokens) END AS s
  FROM touch_v t JOIN n ON t.session_id = n.session_id AND t.ord // 4 = n.event JOIN f ON t.session_id = f.session_id AND t.ord // 4 = f.event AND t.path = f.path)
SELECT session_id, path, round(sum(s), 6) AS spent FROM s GROUP BY 1, 2""")


def unexplained(spark, sf):
    """What of each call's growth its output doesn't explain."""
    a = analysed(spark, sf).withColumn("raw", F.coalesce(F.col("delta_l"), F.lit(0)).cast("double"))
    return r6(ledger.others(a, F.col("l"), F.col("raw"), F.col("outp") * 2).select(*KEY, "others", "drift_warning"), "others")


def command_masks(spark, sf):
    """Commands' secrets out of texts; digests, since texts are long."""
    masked = X.redact_command("text")
    return T.read(spark, sf, "documents").select("doc_id", F.md5(masked).alias("masked"), F.length(masked).cast("long").alias("n"))


def tool_texts(spark, sf):
    """Results in parts, labels of MCP tools and task notices, from turns."""
    c = T.read(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    content = F.to_json(F.array(part("text", F.col("text")), part("image", F.lit("no")), part("text", F.col("role"))))
    name = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("mcp__plugin_"), "role", F.lit("_"), "role", F.lit("__do"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("mcp__"), "role", F.lit("__x__y"))).otherwise(F.col("role"))
    notice = X.agent_notice(F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" <task-notification><task-id> abcdefghij</task-id>\n<summary>\n"), "role", F.lit(" </summary>"))).otherwise(F.col("text")))
    return c.select("conv_id", "turn", F.md5(X.result_text(content)).alias("result"), X.mcp_label(name).alias("label"), notice["task_id"].alias("task"), notice["summary"].alias("summary"))


TEXTS_SQL = """SELECT conv_id, turn, md5(coalesce(text, '')||chr(10)||role) AS result, CASE turn % 3 WHEN 0 THEN role||' do' WHEN 1 THEN role||' x y' ELSE role END AS label,
  CASE WHEN turn % 2 = 0 THEN 'abcdefgh' END AS task, CASE WHEN turn % 2 = 0 THEN role END AS summary FROM conversations"""


def edit_deltas(spark, sf):
    """Each text as an edit of its first half, and as a file that is written."""
    text = F.coalesce("text", F.lit(""))
    d = T.read(spark, sf, "documents").select("doc_id", text.alias("text"), F.expr("substring(coalesce(text, ''), 1, cast(floor(length(coalesce(text, ''))/2) as int))").alias("old"))
    edit, lines = X.edit_delta("old", "text", 3.24, 0.94), X.written_lines("text", 3.24, 0.94)
    written = F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["tokens"])
    return r6(d.select("doc_id", edit["delta"].alias("delta"), edit["spent"].alias("spent"), F.size(lines).cast("long").alias("n_lines"), F.round(written, 3).alias("written")), "delta", "spent")


_CJK_SQL = X.sql_pattern(X.CJK)
EDITS_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, substr(coalesce(text, ''), 1, length(coalesce(text, '')) // 2) AS o FROM documents),
n AS (SELECT *, length(t)-length(regexp_replace(t, '{_CJK_SQL}', '', 'g')) AS tc, length(o)-length(regexp_replace(o, '{_CJK_SQL}', '', 'g')) AS oc, length(t)-length(replace(t, chr(10), '')) AS tn, length(o)-length(replace(o, chr(10), '')) AS onl FROM d),
e AS (SELECT *, (length(t)-tc)/CAST(3.24 AS DOUBLE)+tc/CAST(0.94 AS DOUBLE) AS b, (length(o)-oc)/CAST(3.24 AS DOUBLE)+oc/CAST(0.94 AS DOUBLE) AS a FROM n)
SELECT doc_id, round(b-a+(tn-onl)*4/CAST(3.24 AS DOUBLE), 6) AS delta, round(a+b+85, 6) AS spent, tn+1 AS n_lines,
  round((length(t)+1+list_sum([length(CAST(i AS VARCHAR)) for i in range(1, tn+2)])-tc)/CAST(3.24 AS DOUBLE)+tc/CAST(0.94 AS DOUBLE), 3) AS written FROM e"""


def term_bigrams(spark, sf):
    """Pairs of CJK characters of each text."""
    grams = X.cjk_bigrams(F.coalesce("text", F.lit("")))
    return T.read(spark, sf, "documents").select("doc_id", F.size(grams).cast("long").alias("n"), F.md5(F.array_join(grams, " ")).alias("bigrams"))


BIGRAMS_SQL = f"""SELECT doc_id, len(g) AS n, md5(array_to_string(g, ' ')) AS bigrams FROM (SELECT doc_id, flatten([[r[i:i+1] for i in range(1, length(r))] for r in regexp_extract_all(coalesce(text, ''), '{X.sql_pattern(X.CJK_RUN)}')]) AS g FROM documents)"""


def kept_projection(spark, sf):
    """Kept entries in both shapes, and broken ones, with fields that the answer doesn't have."""
    p = paths_of(spark, sf).select("path").distinct()
    n = F.length("path")
    entry = F.concat(F.lit('{"path":"'), "path", F.lit('","note":"x","lines":[['), n.cast("string"), F.lit(",99]]}"))
    raw = F.when(n % 3 == 0, F.concat(F.lit("["), entry, F.lit("]"))).when(n % 3 == 1, F.concat(F.lit('{"paths":['), entry, F.lit('],"skills":["s"]}'))).otherwise("[{")
    return p.select("path", X.kept_projection(raw).alias("kept"))


KEPT_SQL = with_touches("""SELECT DISTINCT path, CASE WHEN length(path) % 3 = 2 THEN '[]' ELSE '[{"path":"'||path||'","lines":[['||length(path)||',99]]}]' END AS kept FROM touch_v""")


def _adf_sql(column: str, name: str) -> str:
    return f"""{name}0 AS (SELECT session_id, segment, ord, CAST(lag({column}) OVER w AS DOUBLE) AS x, CAST({column} AS DOUBLE) - CAST(lag({column}) OVER w AS DOUBLE) AS d FROM calls_v WINDOW w AS (PARTITION BY session_id, segment ORDER BY ord)),
{name}1 AS (SELECT *, lag(d) OVER (PARTITION BY session_id, segment ORDER BY ord) AS z FROM {name}0),
{name}2 AS (SELECT session_id, segment, count(*) AS n, covar_pop(x, x)*count(*) AS xx, covar_pop(z, z)*count(*) AS zz, covar_pop(x, z)*count(*) AS xz, covar_pop(x, d)*count(*) AS xd, covar_pop(z, d)*count(*) AS zd, covar_pop(d, d)*count(*) AS dd FROM {name}1 WHERE z IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 15),
{name}3 AS (SELECT *, xx*zz-xz*xz AS det FROM {name}2), {name}4 AS (SELECT *, (xd*zz-zd*xz)/det AS b, (zd*xx-xd*xz)/det AS c FROM {name}3 WHERE det > 1e-9*xx*zz),
{name}5 AS (SELECT *, CASE WHEN dd-b*xd-c*zd > 1e-9*dd THEN sqrt((dd-b*xd-c*zd)/(n-3)*zz/det) END AS e FROM {name}4),
{name} AS (SELECT session_id, segment, n, b/e AS t, b/e < CAST(-2.86 AS DOUBLE) AS rejects FROM {name}5)"""


def _mask_sql() -> str:
    out = "text"
    for pattern, mask in X.COMMAND_MASKS:
        replacement = mask.replace("$1", "\\1")
        quoted = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted}', '{replacement}', 'g')"
    return f"SELECT doc_id, md5({out}) AS masked, CAST(length({out}) AS BIGINT) AS n FROM documents"


QUERIES = {
    "effective_price": (effective_price, PRICE_SQL),
    "ignore_rules": (ignore_rules, IGNORE_SQL),
    "restart_values": (restart_values, RESTART_SQL),
    "next_marks": (next_marks, MARKS_SQL),
    "rent_meter": (rent_meter, RENT_SQL),
    "reasoning_spend": (reasoning_spend, REASONING_SQL),
    "reasoning_breaker": (lambda s, d: ledger.reasoning_breaker(analysed(s, d).select(*KEY, "segment", (F.col("outp") * 40).alias("spent"), "l")).select(*KEY, "dropped"), with_calls("""
      , b AS (SELECT *, sum(outp*40) OVER (PARTITION BY session_id, segment ORDER BY ord ROWS UNBOUNDED PRECEDING) > l AS over FROM calls_v) SELECT session_id, ord, bool_or(over) OVER (PARTITION BY session_id, segment ORDER BY ord ROWS UNBOUNDED PRECEDING) AS dropped FROM b""")),
    "ledger_errors": (ledger_errors, LEDGER_ERRORS_SQL),
    "session_names": (session_names, NAMES_SQL),
    "main_calls": (main_calls, with_usage("SELECT session_id, count(*) AS n, CAST(sum(outp) AS BIGINT) AS outp FROM usage_v WHERE outp % 5 <> 0 GROUP BY 1")),
    "search_join": (search_join, f"WITH {HANDOFF_SQL} SELECT handoff_id, CAST(l_linenumber AS BIGINT) AS rank, project_id, next_task FROM h JOIN lineitem ON l_orderkey = handoff_id WHERE project_id = 3"),
    "upsert_handoffs": (upsert_handoffs, UPSERT_SQL),
    "append_loads": (append_loads, APPEND_SQL),
    "expired_handoffs": (lambda s, d: profiles.expired_handoffs(_handoffs(s, d), DAY).select("handoff_id"), f"WITH {HANDOFF_SQL} SELECT handoff_id FROM h WHERE created_at < TIMESTAMP '{DAY}' - INTERVAL {profiles.HANDOFF_DAYS} DAY"),
    "handoff_errors": (handoff_errors, HANDOFF_ERRORS_SQL),
    "subtree_paths": (subtree_paths, SUBTREE_SQL),
    "is_ancestor": (is_ancestor, ANCESTOR_SQL),
    "waiting_uses": (waiting_uses, with_calls("SELECT session_id, ord AS id, turn_seq FROM (SELECT *, max(turn_seq) OVER (PARTITION BY session_id) AS now FROM calls_v) WHERE ord % 3 = 0 AND now - turn_seq <= 2")),
    "load_tokens": (load_tokens, with_calls("SELECT session_id, folded_seq, CASE WHEN ord % 9 = 0 THEN 't'||ord WHEN ord % 4 = 0 THEN 'r'||ord END AS load_token FROM calls_v")),
    "skill_texts": (skill_texts, SKILL_SQL),
    "search_spend": (search_spend, SPEND_SQL),
    "unexplained": (unexplained, with_calls("SELECT session_id, ord, round(greatest(CAST(0 AS DOUBLE), coalesce(delta_l, 0)-outp*2), 6) AS others, coalesce(delta_l, 0)-outp*2 < CAST(-0.02 AS DOUBLE)*l AS drift_warning FROM calls_v")),
    "command_masks": (command_masks, _mask_sql()),
    "tool_texts": (tool_texts, TEXTS_SQL),
    "edit_deltas": (edit_deltas, EDITS_SQL),
    "term_bigrams": (term_bigrams, BIGRAMS_SQL),
    "kept_projection": (kept_projection, KEPT_SQL),
    "lagged_unit_root": (lambda s, d: corpus.lagged_unit_root(analysed(s, d)).withColumn("t", F.round("t", 4)), with_calls(f", {_adf_sql('l', 'ul')} SELECT session_id, segment, n, round(t, 4) AS t, rejects FROM ul")),
    "stationarity": (lambda s, d: r6(corpus.stationarity(analysed(s, d)), "share"), LJUNG_SQL[: LJUNG_SQL.rindex("SELECT")] + f""", {_adf_sql('l', 'ul')}, {_adf_sql('g', 'ug')},
      tests AS (SELECT 'l' AS test, rejects FROM ul UNION ALL SELECT 'g', rejects FROM ug UNION ALL SELECT 'q', qs.q > CAST({corpus.CHI2_10} AS DOUBLE) FROM ({LJUNG_SQL[LJUNG_SQL.rindex("SELECT"):]}) qs)
      SELECT k.test, count(rejects) AS n, round(avg(CAST(rejects AS DOUBLE)), 6) AS share FROM (SELECT unnest(['l', 'g', 'q']) AS test) k LEFT JOIN tests ON k.test = tests.test GROUP BY k.test"""),
}
