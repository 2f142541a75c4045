"""Profiles, telemetry, hand-overs, matching, search, text functions and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockline.functions import text as X
from stockline.operators import calls, corpus, handoff, ledger, profiles
from stockline.sources import tables as T

from .base import JUMPS_SQL, analysed, paths_of, positioned, r6, round_sql, touches, usage, with_calls, with_positions, with_touches, with_usage
from .call_queries import _recon
from .ledger_queries import SNAPSHOT_SQL

NOW = "2024-02-01 00:00:00"


def _profiles(spark, sf):
    return profiles.segment_profiles(positioned(spark, sf))


PROFILE_ROUNDED = ("g_final", "o_avg", "mf", "pp_exit", "br_exit", "br_peak", "pp_peak", "g_min", "p0", "b_axis", "x_axis")
PROFILES_SQL = """
pf0 AS (SELECT session_id, segment, arg_max(model, ord) AS model, arg_max(dead, ord) AS l_floor, arg_max(dead, ord) AS b_total, max(l) AS l_peak, arg_max(g, ord) AS g_final, sum(outp)/CAST(count(*) AS DOUBLE) AS o_avg, arg_max(r, ord) AS c_ratio,
  count(DISTINCT turn_seq) AS turns, count(*) AS n_calls, (epoch_us(max(ts))//1000)-(epoch_us(min(ts))//1000) AS duration_ms, CAST(sum(cr+cc+inp) AS BIGINT) AS total_tokens_read, arg_max(mf, ord) AS mf, last(pp ORDER BY ord) AS pp_exit, last(br ORDER BY ord) AS br_exit,
  max(br) AS br_peak, max(pp) AS pp_peak, min(g) AS g_min, min(CASE WHEN br >= CAST(0.1 AS DOUBLE) THEN turn_seq END) - min(turn_seq) AS turn_at_br_amber FROM pos_v GROUP BY 1, 2),
profile_v AS (SELECT *, l_floor/(c_ratio*g_final) AS p0, 2*o_avg/g_final AS b_axis, l_peak/CAST(l_floor AS DOUBLE) AS x_axis FROM pf0)"""
PROFILE_COLUMNS = "session_id, segment, model, l_floor, b_total, l_peak, c_ratio, turns, n_calls, duration_ms, total_tokens_read, turn_at_br_amber, " + round_sql(*PROFILE_ROUNDED)


def _captures(spark, sf):
    """Two captures of each profile, live for odd and replay for even segments, written in the order of the session."""
    p = _profiles(spark, sf).select("session_id", "segment", "l_peak", "turns")
    kind = lambda a, b: F.when(F.col("segment") % 2 == 1, a).otherwise(b)
    old = p.withColumn("archive_priority", kind(3, 1)).withColumn("write_ord", F.lit(1))
    new = p.withColumn("l_peak", F.col("l_peak") + 1).withColumn("archive_priority", kind(2, 2) + F.when(F.col("session_id") % 3 == 0, 1).otherwise(0)).withColumn("write_ord", F.lit(2))
    return old, new


def _steps(spark, sf):
    """Two snapshots of each pair as one step, every ninth with a load token."""
    u = usage(spark, sf)
    seq = F.regexp_extract("pair_id", r"-(\d+)$", 1).cast("long")
    return u.select("session_id", F.lit(0).cast("long").alias("segment"), seq.alias("folded_seq"), "ord", "ts", "cr", "cc", "inp", "outp", (F.col("outp") % 3).alias("tool_calls"), F.when(F.col("ord") % 9 == 0, F.concat(F.lit("t"), F.col("ord").cast("string"))).alias("load_token"))


def _handoffs(spark, sf):
    """Orders as hand-overs: the customer is the project, the clerk's number the session."""
    o = T.read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("handoff_id"), (F.col("o_custkey") % 500).alias("project_id"), (F.col("o_orderkey") % 97).alias("session_id"), (F.col("o_orderkey") % 4).alias("segment"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("delivered_at"), F.concat(F.lit("tok"), F.col("o_orderkey").cast("string")).alias("load_token"), F.concat(F.lit("finish "), F.lower("o_orderpriority")).alias("next_task"),
    )


HANDOFF_SQL = """h AS (SELECT o_orderkey AS handoff_id, o_custkey % 500 AS project_id, o_orderkey % 97 AS session_id, o_orderkey % 4 AS segment, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS delivered_at,
  concat('tok', CAST(o_orderkey AS VARCHAR)) AS load_token, concat('finish ', lower(o_orderpriority)) AS next_task FROM orders)"""


def _loads(spark, sf):
    li = T.read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("handoff_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("load_id"), (F.col("l_partkey") % 5).alias("session_id"), F.col("l_shipdate").cast("timestamp").alias("loaded_at")).groupBy("handoff_id", "load_id").agg(F.min("session_id").alias("session_id"), F.min("loaded_at").alias("loaded_at"))


def _kept(spark, sf):
    """All paths, some by their last part only."""
    paths = paths_of(spark, sf)
    n = F.length("path") + F.col("session_id")
    name = F.when(n % 3 == 0, F.regexp_extract("path", "[^/]+$", 0)).when(n % 3 == 1, F.regexp_extract("path", "[^/]+/[^/]+$", 0)).otherwise(F.col("path"))
    return paths.select("session_id", name.alias("path")).distinct()


KEPT_SQL = """ps AS (SELECT DISTINCT session_id, path FROM touch_v),
kept AS (SELECT DISTINCT session_id, CASE (length(path)+session_id) % 3 WHEN 0 THEN regexp_extract(path, '[^/]+$') WHEN 1 THEN regexp_extract(path, '[^/]+/[^/]+$') ELSE path END AS path FROM ps),
cand AS (SELECT session_id, path AS candidate, tokens, last_ord FROM snap_v),
mt AS (SELECT k.session_id, k.path, candidate, tokens, last_ord, CASE WHEN candidate = k.path THEN 1 WHEN candidate IS NOT NULL THEN 2 END AS rk FROM kept k LEFT JOIN cand c ON k.session_id = c.session_id AND (candidate = k.path OR ends_with(candidate, '/'||k.path))),
mb AS (SELECT *, min(rk) OVER (PARTITION BY session_id, path) AS best FROM mt), mc AS (SELECT *, count(candidate) OVER (PARTITION BY session_id, path) AS n FROM mb WHERE rk = best OR rk IS NULL),
match_v AS (SELECT session_id, path, candidate, tokens, last_ord, CASE WHEN n = 0 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN rk = 1 THEN 'exact' ELSE 'suffix' END AS status FROM mc)"""


def _candidates(spark, sf):
    return ledger.path_snapshot(touches(spark, sf)).select("session_id", "path", "tokens", "last_ord")


def _carry(spark, sf):
    kept = handoff.resolve_kept_tokens(_kept(spark, sf), _candidates(spark, sf))
    status = _candidates(spark, sf).groupBy("session_id").agg((F.sum("tokens") + 20000).alias("b"), F.lit(20000).alias("floor"), (F.sum("tokens") + 50000).alias("l"))
    return r6(handoff.carry_economics(kept, status), "carry_pct", "x_after")


def redaction(spark, sf):
    """Secrets and commands' secrets out of texts; digests, since texts are long."""
    d = T.read(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.redact_secrets("text")).alias("redacted"), F.length(X.redact_secrets("text")).cast("long").alias("n"))


def _redact_sql() -> str:
    out = "text"
    for p in X.SECRETS:
        quoted = p.replace("'", "''").replace("(?m)", "")
        out = f"regexp_replace({out}, '{quoted}', '[REDACTED]', 'g{'m' if '(?m)' in p else ''}')"
    return f"SELECT doc_id, md5({out}) AS redacted, CAST(length({out}) AS BIGINT) AS n FROM documents"


def tokens(spark, sf):
    d = T.read(spark, sf, "documents")
    return r6(d.select("doc_id", X.estimate_tokens("text", 3.24, 0.94).alias("tokens")), "tokens")


def paths(spark, sf):
    t = paths_of(spark, sf).select("path").distinct()
    raw = F.concat(F.substring("path", 2, 100), F.lit("/../x/./y.js"))
    k = X.keep_path("path", F.lit("/repo"))
    return t.select("path", X.canonical_path(raw, F.lit("/a/b")).alias("canonical"), k["path"].alias("kept"), k["invalid"].alias("invalid"), k["external"].alias("external"), X.discard_reason("path", F.lit("/repo/a"), F.col("path").endswith("5.js")).alias("discard"))


PATHS_SQL = with_touches("""SELECT DISTINCT path, '/a/b'||regexp_replace(path, '[^/]+$', '')||regexp_extract(path, '[^/]+$')||'/../x/y.js' AS c0, substr(path, 7) AS kept, false AS invalid, false AS external,
  CASE WHEN NOT starts_with(path, '/repo/a/') THEN 'outside-project' WHEN ends_with(path, '5.js') THEN 'gitignore' END AS discard FROM touch_v""")
PATHS_SQL = f"SELECT path, regexp_replace(c0, '[^/]+/\\.\\./', '') AS canonical, kept, invalid, external, discard FROM ({PATHS_SQL})"


def search_queries(spark, sf):
    """Documents searched for the first two words of each benchmark item."""
    docs = T.read(spark, sf, "documents").select(F.col("doc_id").alias("handoff_id"), F.col("text").alias("summary"))
    asked = T.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), 1, 2)).alias("query"))
    return r6(handoff.search(docs, asked, k=3, columns=("summary",)), "score")


SEARCH_SQL = r"""
WITH t AS (SELECT doc_id AS handoff_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM documents),
q AS (SELECT item_id AS query_id, lower(unnest(list_distinct(regexp_extract_all(lower(array_to_string(regexp_extract_all(text, '\p{L}+')[1:2], ' ')), '[\p{L}\p{N}_]+')))) AS term FROM benchmark),
need AS (SELECT query_id, count(*) AS n_wanted FROM q GROUP BY 1),
len AS (SELECT handoff_id, count(*) AS n_terms FROM t GROUP BY 1),
shape AS (SELECT (SELECT count(*) FROM documents) AS n_docs, avg(n_terms) AS mean_terms FROM len),
tf AS (SELECT handoff_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
h AS (SELECT query_id, tf.handoff_id, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (1 - CAST(0.75 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n_terms / mean_terms)) AS s
  FROM tf JOIN q ON tf.term = q.term JOIN df ON tf.term = df.term JOIN len ON tf.handoff_id = len.handoff_id CROSS JOIN shape),
g AS (SELECT h.query_id, handoff_id, sum(s) AS score, count(*) AS n FROM h GROUP BY 1, 2),
r AS (SELECT g.query_id, handoff_id, row_number() OVER (PARTITION BY g.query_id ORDER BY round(score, 9) DESC, handoff_id) AS rank, round(score, 6) AS score FROM g JOIN need ON g.query_id = need.query_id AND g.n = need.n_wanted)
SELECT query_id, handoff_id, rank, score FROM r WHERE rank <= 3"""

_LAGS = range(1, 11)
LJUNG_SQL = with_calls(f"""
, z AS (SELECT session_id, segment, ord, g - avg(g) OVER (PARTITION BY session_id, segment) AS z FROM calls_v),
y AS (SELECT *, {", ".join(f"lag(z, {k}) OVER (PARTITION BY session_id, segment ORDER BY ord) AS z{k}" for k in _LAGS)} FROM z),
s AS (SELECT session_id, segment, count(*) AS n, sum(z*z) AS c0, {", ".join(f"sum(z*z{k}) AS c{k}" for k in _LAGS)} FROM y GROUP BY 1, 2 HAVING count(*) > 12 AND sum(z*z) > 0)
SELECT session_id, segment, n, round(n*(n+2)*({" + ".join(f"(c{k}/c0)*(c{k}/c0)/(n-{k})" for k in _LAGS)}), 6) AS q FROM s""")


def usage_extract(spark, sf):
    return calls.keep_usage(calls.since(usage(spark, sf), "2024-01-05")).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("outp").alias("outp"))


def washed(spark, sf):
    """Usage without identity: salted session hash and day."""
    from stockline.sources.transcripts import wash

    return wash(usage(spark, sf), "salt").select("day", "session", "seq", "model", "tier", "cr", "cc", "inp", "outp")


def _summaries(spark, sf):
    return corpus.session_summaries(usage(spark, sf), F.col("session_id") % 10)


SUMMARY_SQL = """ss AS (SELECT session_id, session_id % 10 AS project, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(cr, ord) AS cr, arg_min(cc, ord) AS cc, arg_min(inp, ord) AS inp, arg_min(model, ord) AS model FROM usage_v GROUP BY 1, 2),
gaps AS (SELECT *, floor(epoch(first_ts)) - floor(epoch(lag(last_ts) OVER (PARTITION BY project ORDER BY first_ts, session_id))) AS gap_s FROM ss)"""


FIT_SQL = """gf0 AS (SELECT session_id, model, ord, cr+cc AS l, row_number() OVER (PARTITION BY session_id, model ORDER BY ord)-1 AS i, count(*) OVER (PARTITION BY session_id, model) AS n FROM usage_v),
gf1 AS (SELECT *, least(3, n // 5) AS warm FROM gf0 WHERE n >= 5), gf2 AS (SELECT * FROM gf1 WHERE i >= warm),
fit_v AS (SELECT session_id, model, max(n) AS n, min(CASE WHEN i < warm+10 THEN l END) AS floor, count(*) AS n_fit, regr_slope(l, i) AS slope, max(l) AS l_max FROM gf2 GROUP BY 1, 2 HAVING count(*) >= 3 AND regr_slope(l, i) > 0)"""
RATIO_SQL = "CASE WHEN starts_with(model, 'claude') THEN CAST(12.5 AS DOUBLE) WHEN contains(model, 'pro') THEN 120 WHEN contains(model, 'flash') THEN 50 ELSE 10 END"


def telemetry(spark, sf):
    seg = _profiles(spark, sf).select("session_id", "segment", (F.col("segment") % 5 == 4).alias("failed"), (F.col("segment") % 3 < 2).alias("ended"))
    steps = analysed(spark, sf).where("segment % 4 > 0").select("session_id", "segment", "folded_seq")
    return profiles.telemetry_status(seg, steps)


def replay_list(spark, sf):
    status = telemetry(spark, sf).join(_handoffs(spark, sf).groupBy("session_id").agg(F.max("created_at").alias("updated_at")), "session_id")
    return profiles.sessions_needing_replay(status, status.where("session_id % 7 = 0"), 20)


QUERIES = {
    "segment_profiles": (lambda s, d: r6(_profiles(s, d), *PROFILE_ROUNDED), with_positions(f", {PROFILES_SQL} SELECT {PROFILE_COLUMNS} FROM profile_v")),
    "terminal_snapshot": (lambda s, d: profiles.terminal_snapshot(_profiles(s, d)).select("session_id", "segment", "l_peak", "turns", "n_calls"), with_positions(f", {PROFILES_SQL} SELECT session_id, arg_max(segment, segment) AS segment, arg_max(l_peak, segment) AS l_peak, arg_max(turns, segment) AS turns, arg_max(n_calls, segment) AS n_calls FROM profile_v GROUP BY 1")),
    "upsert_profiles": (lambda s, d: profiles.upsert_profiles(*_captures(s, d)).select("session_id", "segment", "l_peak", "archive_priority"), with_positions(f""", {PROFILES_SQL}, c AS (SELECT session_id, segment, l_peak, CASE WHEN segment % 2 = 1 THEN 3 ELSE 1 END AS pr, 1 AS w FROM profile_v UNION ALL SELECT session_id, segment, l_peak+1, 2 + CASE WHEN session_id % 3 = 0 THEN 1 ELSE 0 END, 2 FROM profile_v)
      SELECT session_id, segment, arg_max(l_peak, pr*10+w) AS l_peak, max(pr) AS archive_priority FROM c GROUP BY 1, 2""")),
    "step_payload": (lambda s, d: profiles.step_payload(_steps(s, d)).drop("segment", "ts"), with_usage(r""", s AS (SELECT session_id, CAST(regexp_extract(pair_id, '-(\d+)$', 1) AS BIGINT) AS folded_seq, row_number() OVER (PARTITION BY session_id, pair_id ORDER BY cr+cc+inp+outp, ord) AS k, cr, cc, inp, outp, outp % 3 AS tool_calls, CASE WHEN ord % 9 = 0 THEN concat('t', CAST(ord AS VARCHAR)) END AS load_token FROM usage_v)
      SELECT session_id, folded_seq, arg_max(cr, k) AS cr, arg_max(cc, k) AS cc, arg_max(inp, k) AS inp, arg_max(outp, k) AS outp, arg_max(tool_calls, k) AS tool_calls, arg_max(load_token, k) FILTER (WHERE load_token IS NOT NULL) AS load_token FROM s GROUP BY 1, 2""")),
    "touch_sessions": (lambda s, d: profiles.touch_sessions(_handoffs(s, d).select("session_id", F.struct("created_at", "handoff_id").alias("at"), F.when(F.col("handoff_id") % 3 == 0, F.col("next_task")).alias("model"), F.col("project_id"))).select("session_id", F.col("created_at.created_at").alias("created_at"), F.col("updated_at.created_at").alias("updated_at"), "model", "project_id"), f"""WITH {HANDOFF_SQL},
      k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, handoff_id) AS n FROM h)
      SELECT session_id, min(created_at) AS created_at, max(created_at) AS updated_at, arg_max(next_task, n) FILTER (WHERE handoff_id % 3 = 0) AS model, arg_max(project_id, n) AS project_id FROM k GROUP BY 1"""),
    "telemetry_status": (telemetry, with_positions(f""", {PROFILES_SQL}, n AS (SELECT session_id, segment, count(*) AS n_steps FROM calls_v WHERE segment % 4 > 0 GROUP BY 1, 2), x AS (SELECT p.session_id, p.segment, p.segment % 5 = 4 AS failed, p.segment % 3 < 2 AS ended, coalesce(n_steps, 0) AS n_steps FROM profile_v p LEFT JOIN n ON p.session_id = n.session_id AND p.segment = n.segment)
      SELECT *, CASE WHEN failed THEN 'failed_retryable' WHEN NOT ended THEN 'pending' WHEN n_steps = 0 THEN 'complete_empty' ELSE 'complete' END AS status FROM x""")),
    "sessions_needing_replay": (replay_list, with_positions(f""", {HANDOFF_SQL}, {PROFILES_SQL}, u AS (SELECT session_id, max(created_at) AS updated_at FROM h GROUP BY 1)
      SELECT DISTINCT p.session_id, updated_at FROM profile_v p JOIN u ON p.session_id = u.session_id WHERE (p.segment % 5 = 4 OR p.segment % 3 >= 2) AND p.session_id % 7 <> 0 ORDER BY updated_at, p.session_id LIMIT 20""")),
    "retention_plan": (lambda s, d: profiles.retention_plan(_handoffs(s, d).groupBy("session_id").agg(F.min("created_at").alias("updated_at"), (F.sum("handoff_id") * 100).alias("n_bytes")), _handoffs(s, d).where("session_id % 10 = 0"), "2100-01-01", limit=12), f"""WITH {HANDOFF_SQL}, s AS (SELECT session_id, min(created_at) AS updated_at, CAST(sum(handoff_id)*100 AS BIGINT) AS n_bytes FROM h GROUP BY 1)
      SELECT *, CASE WHEN n_bytes > 50000000 THEN 'snapshot' ELSE 'replay' END AS source FROM s WHERE updated_at < TIMESTAMP '2100-01-01' - INTERVAL 7 DAYS AND session_id % 10 <> 0 ORDER BY updated_at, session_id LIMIT 12"""),
    "migrate_profiles": (lambda s, d: profiles.migrate_profiles(_profiles(s, d).where("segment = 0").select("session_id", "l_peak"), {"mf": "double"}), with_positions(f", {PROFILES_SQL} SELECT session_id, l_peak, CAST(0 AS BIGINT) AS segment, 'snapshot' AS archive_source, 1 AS archive_priority, CAST(NULL AS DOUBLE) AS mf FROM profile_v WHERE segment = 0")),
    "median0": (lambda s, d: r6(profiles.median0(analysed(s, d), "delta_l", "session_id"), "median"), with_calls("SELECT session_id, round(CAST(coalesce(median(delta_l), 0) AS DOUBLE), 6) AS median FROM calls_v GROUP BY 1")),
    "last_events": (lambda s, d: profiles.last_n(analysed(s, d), 4).select("session_id", "ord", "l"), with_calls("SELECT session_id, ord, l FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS k FROM calls_v) WHERE k <= 4")),
    "pending_handoffs": (lambda s, d: handoff.pending_handoffs(_handoffs(s, d), "1998-01-01", days=2000).select("project_id", "handoff_id", "rank", "ambiguous"), f"""WITH {HANDOFF_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, handoff_id DESC) AS rank FROM h WHERE delivered_at IS NULL AND created_at >= TIMESTAMP '1998-01-01' - INTERVAL 2000 DAYS)
      SELECT project_id, handoff_id, rank, count(*) OVER (PARTITION BY project_id) > 1 AS ambiguous FROM k WHERE rank <= 5"""),
    "discover_handoffs": (lambda s, d: _discover(s, d), f"""WITH {HANDOFF_SQL}, k2 AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, handoff_id DESC) AS rk FROM h WHERE delivered_at IS NULL AND session_id <> 3)
      SELECT project_id, handoff_id, rk AS rank, mx > 3 AS more, substr(next_task, 1, 200) AS preview FROM (SELECT *, max(rk) OVER (PARTITION BY project_id) AS mx FROM k2) WHERE rk <= 3"""),
    "latest_handoff": (lambda s, d: handoff.latest_handoff(_handoffs(s, d)), f"WITH {HANDOFF_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, handoff_id DESC) AS n FROM h) SELECT session_id, handoff_id, created_at FROM k WHERE n = 1"),
    "classify_claims": (lambda s, d: handoff.classify_claims(_handoffs(s, d), _loads(s, d)).select("handoff_id", "load_id", "claim", "primary_session"), f"""WITH {HANDOFF_SQL}, ld AS (SELECT l_orderkey AS handoff_id, l_orderkey*10+l_linenumber AS load_id, min(l_partkey % 5) AS session_id, min(l_shipdate) AS loaded_at FROM lineitem GROUP BY 1, 2),
      f AS (SELECT h.handoff_id, delivered_at, load_id, ld.session_id, first_value(ld.session_id) OVER (PARTITION BY h.handoff_id ORDER BY loaded_at, load_id) AS p FROM h LEFT JOIN ld ON h.handoff_id = ld.handoff_id)
      SELECT handoff_id, load_id, CASE WHEN session_id IS NULL AND delivered_at IS NOT NULL THEN 'legacy_unattributed' WHEN session_id IS NULL THEN 'undelivered' WHEN session_id = p THEN 'primary' ELSE 'duplicate' END AS claim, CASE WHEN session_id <> p THEN p END AS primary_session FROM f"""),
    "carry_linkage": (lambda s, d: handoff.carry_linkage(_handoffs(s, d).select((F.col("handoff_id") % 5).alias("session_id"), F.lit(1).alias("segment"), "load_token"), _handoffs(s, d), _loads(s, d)).groupBy("producer_segment", "consumer").agg(F.count("*").alias("n")), f"""WITH {HANDOFF_SQL}, ld AS (SELECT l_orderkey AS handoff_id, l_linenumber, min(l_partkey % 5) AS session_id FROM lineitem GROUP BY 1, 2)
      SELECT h.segment AS producer_segment, ld.session_id AS consumer, count(*) AS n FROM h JOIN ld ON h.handoff_id = ld.handoff_id AND ld.session_id = h.handoff_id % 5 GROUP BY 1, 2"""),
    "match_kept_paths": (lambda s, d: handoff.match_kept_paths(_kept(s, d), _candidates(s, d)), with_touches(f", {SNAPSHOT_SQL}, {KEPT_SQL} SELECT * FROM match_v")),
    "resolve_kept_tokens": (lambda s, d: handoff.resolve_kept_tokens(_kept(s, d), _candidates(s, d)), with_touches(f", {SNAPSHOT_SQL}, {KEPT_SQL} SELECT session_id, path, candidate, tokens, last_ord, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY last_ord DESC NULLS LAST, candidate) AS k FROM match_v) WHERE k = 1")),
    "carry_economics": (_carry, with_touches(f""", {SNAPSHOT_SQL}, {KEPT_SQL}, rs AS (SELECT session_id, tokens FROM (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY last_ord DESC NULLS LAST, candidate) AS k FROM match_v) WHERE k = 1), sm AS (SELECT session_id, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS kept FROM rs GROUP BY 1),
      st AS (SELECT session_id, CAST(sum(tokens) AS BIGINT) AS t FROM snap_v GROUP BY 1), z AS (SELECT st.session_id, coalesce(kept, 0) AS kept, t FROM st LEFT JOIN sm ON st.session_id = sm.session_id)
      SELECT session_id, kept, t-kept AS discarded, round(100*kept/CAST(t AS DOUBLE), 6) AS carry_pct, kept+20000 AS basis, round((t+50000)/CAST(kept+20000 AS DOUBLE), 6) AS x_after FROM z""")),
    "line_ranges": (lambda s, d: handoff.line_ranges(touches(s, d)), with_touches(", o AS (SELECT DISTINCT session_id, path, line_no FROM touch_v), i AS (SELECT *, line_no - row_number() OVER (PARTITION BY session_id, path ORDER BY line_no) AS g FROM o) SELECT session_id, path, min(line_no) AS first, max(line_no) AS last, max(line_no)-min(line_no)+1 AS n_lines FROM i GROUP BY session_id, path, g")),
    "path_totals": (lambda s, d: handoff.path_totals(touches(s, d), touches(s, d).where("op = 'lineUpdate'")), with_touches("SELECT session_id, path, CAST(coalesce(sum(tokens) FILTER (WHERE op = 'lineUpdate'), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE op = 'lineUpdate') AS n_lines FROM touch_v GROUP BY 1, 2")),
    "redaction": (redaction, _redact_sql()),
    "token_estimate": (tokens, f"SELECT doc_id, round((length(text)-n)/CAST(3.24 AS DOUBLE)+n/CAST(0.94 AS DOUBLE), 6) AS tokens FROM (SELECT *, length(text)-length(regexp_replace(text, '{X.sql_pattern(X.CJK)}', '', 'g')) AS n FROM documents)"),
    "path_functions": (paths, PATHS_SQL),
    "search": (search_queries, SEARCH_SQL),
    "usage_extract": (usage_extract, with_usage("SELECT session_id, count(*) AS n, CAST(sum(outp) AS BIGINT) AS outp FROM usage_v WHERE ts >= TIMESTAMP '2024-01-05' AND cr+cc+inp+outp > 0 GROUP BY 1")),
    "washed_usage": (washed, with_usage("SELECT CAST(ts AS DATE) AS day, substr(sha1(concat('salt|', CAST(session_id AS VARCHAR))), 1, 10) AS session, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS seq, model, CASE WHEN contains(model, 'pro') THEN 'pro' WHEN contains(model, 'flash') THEN 'flash' END AS tier, cr, cc, inp, outp FROM usage_v")),
    "growth_fit": (lambda s, d: r6(corpus.growth_fit(usage(s, d)), "slope"), with_usage(f", {FIT_SQL} SELECT session_id, model, n, floor, n_fit, round(slope, 6) AS slope, l_max FROM fit_v")),
    "order_stats": (lambda s, d: r6(corpus.order_stats(corpus.growth_fit(usage(s, d)), {"floor": 1e6, "slope": 1e6}), "p25", "median", "p75", "mean"), with_usage(f""", {FIT_SQL}, u AS (SELECT 'floor' AS measure, CAST(floor AS DOUBLE) AS v FROM fit_v UNION ALL SELECT 'slope', slope FROM fit_v), k AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY v)-1 AS i, count(*) OVER (PARTITION BY measure) AS n FROM u WHERE v < 1e6)
      SELECT measure, max(n) AS n, round(max(CASE WHEN i = n//4 THEN v END), 6) AS p25, round(max(CASE WHEN i = n*2//4 THEN v END), 6) AS median, round(max(CASE WHEN i = n*3//4 THEN v END), 6) AS p75, round(avg(v), 6) AS mean FROM k GROUP BY 1""")),
    "break_even_shares": (lambda s, d: r6(corpus.break_even_shares(corpus.growth_fit(usage(s, d))), "mean_k", "mean_h"), with_usage(f""", {FIT_SQL}, b AS (SELECT *, {RATIO_SQL} AS r FROM fit_v), c AS (SELECT *, (-(floor+slope/2)+sqrt((floor+slope/2)*(floor+slope/2)+2*slope*r*floor))/slope AS h, n/sqrt(2*r*floor/slope) AS k FROM b)
      SELECT model, count(*) AS n_sessions, count(*) FILTER (WHERE n > h) AS n_beyond, count(*) FILTER (WHERE k > 3) AS n_tail, round(avg(k), 6) AS mean_k, round(avg(h), 6) AS mean_h FROM c GROUP BY ROLLUP(model)""")),
    "linearity": (lambda s, d: r6(corpus.linearity(analysed(s, d)), "slope", "r2"), with_calls(""", t AS (SELECT *, row_number() OVER (PARTITION BY session_id, segment ORDER BY ord) AS t FROM calls_v)
      SELECT session_id, segment, count(*) AS n, count(*) FILTER (WHERE delta_l > 0) AS n_up, round(regr_slope(l, t), 6) AS slope, round(regr_r2(l, t), 6) AS r2 FROM t GROUP BY 1, 2 HAVING count(*) >= 15 AND count(*) FILTER (WHERE delta_l > 0) >= 8""")),
    "knee": (lambda s, d: r6(corpus.knee(analysed(s, d)), "usual"), with_calls(""", t AS (SELECT *, row_number() OVER (PARTITION BY session_id, segment ORDER BY ord) AS i, count(*) OVER (PARTITION BY session_id, segment) AS n FROM calls_v),
      u AS (SELECT session_id, segment, median(delta_l) AS usual FROM t WHERE i > n/2.0 GROUP BY 1, 2), a AS (SELECT *, max(delta_l) OVER w AS m, count(delta_l) OVER w AS c FROM t WINDOW w AS (PARTITION BY session_id, segment ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))
      SELECT a.session_id, a.segment, min(i) AS knee, round(CAST(max(usual) AS DOUBLE), 6) AS usual FROM a JOIN u ON a.session_id = u.session_id AND a.segment = u.segment WHERE c = 4 AND m < usual GROUP BY 1, 2""")),
    "fold_jumps": (lambda s, d: corpus.fold_jumps(analysed(s, d)), with_calls(JUMPS_SQL)),
    "plateaus": (lambda s, d: corpus.plateaus(analysed(s, d), corpus.fold_jumps(analysed(s, d)), 5), None),
    "delta_histogram": (lambda s, d: r6(corpus.delta_histogram(analysed(s, d)), "share"), with_calls(""", u AS (SELECT session_id, segment, median(delta_l) AS k FROM calls_v WHERE delta_l > 0 GROUP BY 1, 2), v AS (SELECT delta_l/k AS v FROM calls_v c JOIN u ON c.session_id = u.session_id AND c.segment = u.segment WHERE delta_l > 0),
      b AS (SELECT (v >= 0)::INT + (v >= 0.5)::INT + (v >= 1)::INT + (v >= 2)::INT + (v >= 4)::INT + (v >= 8)::INT + (v >= 15)::INT + (v >= 20)::INT AS bin FROM v) SELECT bin, count(*) AS n, round(count(*)/CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM b GROUP BY bin""")),
    "delta_quantiles": (lambda s, d: r6(corpus.delta_quantiles(analysed(s, d)), "p50", "p95", "p99", "beyond_8"), with_calls(""", u AS (SELECT session_id, segment, median(delta_l) AS k FROM calls_v WHERE delta_l > 0 GROUP BY 1, 2), v AS (SELECT delta_l/k AS v FROM calls_v c JOIN u ON c.session_id = u.session_id AND c.segment = u.segment WHERE delta_l > 0)
      SELECT count(*) AS n, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(avg(CASE WHEN v > 8 THEN 1.0 ELSE 0.0 END), 6) AS beyond_8 FROM v""")),
    "ljung_box": (lambda s, d: r6(corpus.ljung_box(analysed(s, d)), "q"), LJUNG_SQL),
    "unit_root": (lambda s, d: r6(corpus.unit_root(analysed(s, d)), "t"), with_calls("""
      , d AS (SELECT session_id, segment, CAST(prev_l AS DOUBLE) AS x, CAST(l - prev_l AS DOUBLE) AS d FROM calls_v WHERE prev_l IS NOT NULL),
      u AS (SELECT session_id, segment, count(*) AS n, regr_slope(d, x) AS b, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy FROM d GROUP BY 1, 2 HAVING count(*) >= 15 AND regr_sxx(d, x) > 0),
      v AS (SELECT *, sqrt(greatest((syy - b*b*sxx)/(n-2)/sxx, 0)) AS e FROM u)
      SELECT session_id, segment, n, round(CASE WHEN e > 0 THEN b/e END, 6) AS t, CASE WHEN e > 0 THEN b/e < -2.86 END AS rejects FROM v""")),
    "permutation_r2": (lambda s, d: corpus.permutation_r2(analysed(s, d)), None),
    "bootstrap_recovery": (lambda s, d: corpus.bootstrap_recovery(_recon(s, d)), None),
    "cold_start_gaps": (lambda s, d: corpus.cold_start_gaps(_summaries(s, d)).select("session_id", F.col("gap_s").cast("long").alias("gap_s")), with_usage(f", {SUMMARY_SQL} SELECT session_id, CAST(gap_s AS BIGINT) AS gap_s FROM gaps")),
    "cold_start_bins": (lambda s, d: r6(corpus.cold_start_bins(corpus.cold_start_gaps(_summaries(s, d))), "zero_share", "mean_hit"), with_usage(f""", {SUMMARY_SQL} SELECT CASE WHEN gap_s IS NULL THEN 'first' WHEN gap_s < 300 THEN 'under 5 min' WHEN gap_s < 3600 THEN '5 min to 1 h' WHEN gap_s < 86400 THEN '1 h to 1 d' ELSE 'over 1 d' END AS gap, count(*) AS n,
      round(avg(CASE WHEN cr = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, round(avg(CASE WHEN cr+cc+inp > 0 THEN cr/CAST(cr+cc+inp AS DOUBLE) END), 6) AS mean_hit FROM gaps GROUP BY 1""")),
    "p_cold": (lambda s, d: r6(corpus.p_cold(_summaries(s, d)), "p_cold"), with_usage(f", {SUMMARY_SQL} SELECT CASE WHEN starts_with(model, 'claude') THEN 'claude' WHEN starts_with(model, 'deepseek') THEN 'deepseek' ELSE 'unknown' END AS provider, count(*) AS n, round(avg(CASE WHEN cr = 0 THEN 1.0 ELSE 0.0 END), 6) AS p_cold FROM ss GROUP BY 1")),
    "p_ttl": (lambda s, d: r6(corpus.p_ttl(usage(s, d).select("session_id", F.col("model").alias("provider"), (F.col("outp") * 2).alias("idle_s"))), "pooled", "per_session"), with_usage("""SELECT provider, CAST(sum(n) AS BIGINT) AS n, round(sum(k)/CAST(sum(n) AS DOUBLE), 6) AS pooled, round(avg(k/CAST(n AS DOUBLE)), 6) AS per_session FROM (SELECT session_id, model AS provider, count(*) AS n, count(*) FILTER (WHERE outp*2 > 300) AS k FROM usage_v GROUP BY 1, 2) GROUP BY 1""")),
}


def _discover(spark, sf):
    """What sessions of each project would be shown, without a time limit that the fixture's dates would miss."""
    rows = handoff.discover_handoffs(_handoffs(spark, sf).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 30 YEARS")), "2020-01-01", 3)
    return rows.select("project_id", "handoff_id", "rank", "more", "preview")

