"""Folding, numbering, misses, segments, growth, position, meter and alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockline.functions import economics as E
from stockline.functions import models as M
from stockline.operators import billing, calls

from .base import BACKSTOP_SQL, GATE_SQL, analysed, bill, metered, positioned, r6, round_sql, usage, with_bill, with_calls, with_meter, with_positions, with_usage

KEY = ["session_id", "ord"]


def _fold(rule):
    return lambda s, d: calls.fold_calls(usage(s, d), rule, "pair_id").select("session_id", F.col("call_id").alias("pair_id"), "ord", "ts", "cr", "cc", "inp", "outp", "first_cr", "n_snapshots")


def _fold_sql(order: str) -> str:
    return with_usage(f"""SELECT session_id, pair_id, min(ord) AS ord, arg_max(ts, k) AS ts, arg_max(cr, k) AS cr, arg_max(cc, k) AS cc, arg_max(inp, k) AS inp, arg_max(outp, k) AS outp,
      arg_min(cr, ord) AS first_cr, count(*) AS n_snapshots
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pair_id ORDER BY {order}) AS k FROM usage_v) GROUP BY session_id, pair_id""")


def model_properties(spark, sf):
    m = F.col("model")
    return usage(spark, sf).groupBy("model").agg(F.count("*").alias("n_calls")).select(
        "model", "n_calls", M.provider_of(m).alias("provider"), M.c_ratio_for(m).alias("c_ratio"), M.ctp_for(m)["ascii"].alias("ctp_ascii"), M.ctp_for(m)["cjk"].alias("ctp_cjk"), M.l_cap(m).cast("long").alias("l_cap"), M.tier_model(m).alias("tier"),
    )


MODEL_SQL = with_usage("""SELECT model, count(*) AS n_calls,
  CASE WHEN regexp_matches(model, '(?i)claude|opus|sonnet|haiku') THEN 'claude' WHEN regexp_matches(model, '(?i)deepseek') THEN 'deepseek' ELSE 'unknown' END AS provider,
  CASE WHEN regexp_matches(model, '(?i)claude|opus|sonnet|haiku') THEN CAST(12.5 AS DOUBLE) WHEN regexp_matches(model, '(?i)deepseek.*pro') THEN 120 WHEN regexp_matches(model, '(?i)deepseek') THEN 50 ELSE 10 END AS c_ratio,
  CASE WHEN starts_with(model, 'claude') THEN CAST(2.45 AS DOUBLE) WHEN starts_with(model, 'deepseek') THEN 3.24 ELSE 3.0 END AS ctp_ascii,
  CASE WHEN starts_with(model, 'claude') THEN CAST(0.59 AS DOUBLE) WHEN starts_with(model, 'deepseek') THEN 0.94 ELSE 1.0 END AS ctp_cjk,
  CAST(960000 AS BIGINT) AS l_cap, CASE WHEN contains(model, 'pro') THEN 'pro' WHEN contains(model, 'flash') THEN 'flash' END AS tier FROM usage_v GROUP BY model""")


def economics(spark, sf):
    p = positioned(spark, sf)
    d, mf, r, g, b = (F.col(c) for c in ("dhat", "mf", "r", "g", "dead"))
    marks = E.landmarks(r, g, b, b)
    wall = E.rate_wall(b, r, M.l_cap(F.col("model")))
    return r6(p.select(
        *KEY, "dhat", "mf", "br", "pp", F.round("burn", 8).alias("burn"), "x", marks["x_entry"].alias("x_entry"), marks["x_exit"].alias("x_exit"), E.band(F.col("x"), marks).alias("band"),
        E.finite(E.h_break(r, b, F.col("l"))).alias("h_break"), E.x_at_regret(0.1, d, mf).alias("x_amber"), E.x_at_regret(0.1, d, mf, "left").alias("x_amber_left"), E.backstop_interval(mf).alias("interval"),
        wall["wall_l"].alias("wall_l"), wall["wall_reachable"].alias("wall_reachable"), E.zone(F.col("br"), F.col("x"), E.x_at_regret(0.25, d, mf), F.col("x_sweet")).alias("zone"),
        E.lamp(F.col("br"), F.col("x"), F.col("x_sweet"), E.x_at_regret(0.1, d, mf, "left")).alias("lamp"), "deep_water", E.break_even(r, F.col("l"), g).alias("break_even"), E.order_quantity(r, F.col("l"), g).alias("n_star"),
        E.finite(E.curve_cost(F.col("x"), r, F.col("x_sweet"))).alias("curve_cost"),
    ), "dhat", "mf", "br", "pp", "x", "x_entry", "x_exit", "h_break", "x_amber", "x_amber_left", "interval", "wall_l", "break_even", "n_star", "curve_cost")


ECONOMICS_SQL = with_positions(f"""
, z AS (SELECT *, 1 + 0.5*dhat AS x_entry, 1 + 2*dhat AS x_exit, 1+(1+0.1/mf+sqrt((0.1/mf)*(0.1/mf)+2*(0.1/mf)))*dhat AS x_amber, 1+(1+0.1/mf-sqrt((0.1/mf)*(0.1/mf)+2*(0.1/mf)))*dhat AS x_amber_left,
  1+(1+0.25/mf+sqrt((0.25/mf)*(0.25/mf)+2*(0.25/mf)))*dhat AS x_red, (2*(mf+0.1)+sqrt(4*(mf+0.1)*(mf+0.1)-4*mf*mf))/(2*mf) AS ub, CASE WHEN l > dead THEN r*dead/(l-dead) END AS h_break, dead+r*dead AS wall_l,
  CASE WHEN l > 0 THEN (-(l+g/2)+sqrt((l+g/2)*(l+g/2)+2*g*r*l))/g END AS break_even, CASE WHEN l > 0 THEN sqrt(2*r*l/g) END AS n_star, CASE WHEN x > 1 THEN ((x_sweet-1)*(x_sweet-1)/(2*r))/(x-1)+(x-1)/(2*r) END AS curve_cost FROM pos_v)
SELECT session_id, ord, {round_sql("dhat", "mf", "br", "pp", "x", "x_entry", "x_exit", "h_break", "x_amber", "x_amber_left", "wall_l", "break_even", "n_star", "curve_cost")}, round(burn, 8) AS burn, round(ub*ub, 6) AS interval,
  CASE WHEN x < x_entry THEN 'below_entry' WHEN x < x_sweet THEN 'entry_to_sweet' WHEN x < x_exit THEN 'sweet_to_exit' ELSE 'above_exit' END AS band, wall_l < 960000 AS wall_reachable,
  CASE WHEN br IS NULL THEN 'calibrating' WHEN x >= x_red THEN 'wall' WHEN x < x_sweet AND br >= 0.1 THEN 'warmup' WHEN x < x_sweet THEN 'green' WHEN br >= 0.25 THEN 'red' WHEN br >= 0.1 THEN 'amber' ELSE 'green' END AS zone,
  CASE WHEN br IS NULL THEN 'white' WHEN x < x_sweet AND x >= x_amber_left THEN 'green' WHEN x < x_sweet THEN 'white' WHEN br >= 0.25 THEN 'red' WHEN br >= 0.1 THEN 'yellow' ELSE 'green' END AS lamp, deep_water FROM z""").replace("0.25/mf", "CAST(0.25 AS DOUBLE)/mf").replace("0.1/mf", "CAST(0.1 AS DOUBLE)/mf").replace("mf+0.1", "mf+CAST(0.1 AS DOUBLE)")


def what_if(spark, sf):
    """Landmarks for candidate baselines of each model's mean growth, and points of its cost curve."""
    p = positioned(spark, sf).groupBy("model", "r").agg(F.avg("g").alias("g"))
    grid = p.select("model", "r", "g", F.explode(F.sequence(F.lit(1000), F.lit(81000), F.lit(20000))).alias("b"))
    d = E.dhat(F.col("r"), F.col("g"), F.col("b"))
    return r6(grid.select("model", F.col("b").cast("long").alias("b"), d.alias("dhat"), (1 + d).alias("x_sweet"), ((1 + d) * F.col("b")).alias("l_sweet"), E.movable_frac(F.col("r"), F.col("b"), F.col("g")).alias("mf")), "dhat", "x_sweet", "l_sweet", "mf")


WHAT_IF_SQL = with_positions(f"""
, w AS (SELECT model, r, avg(g) AS g FROM pos_v GROUP BY model, r), v AS (SELECT model, r, g, unnest(range(1000, 81001, 20000)) AS b FROM w),
y AS (SELECT model, b, sqrt(2*r*g/b) AS dhat, 1+sqrt(2*r*g/b) AS x_sweet, (1+sqrt(2*r*g/b))*b AS l_sweet, sqrt(2*r*b*g)/(sqrt(2*r*b*g)+b+r*g) AS mf FROM v)
SELECT model, CAST(b AS BIGINT) AS b, {round_sql("dhat", "x_sweet", "l_sweet", "mf")} FROM y""")


def session_status(spark, sf):
    m = metered(spark, sf)
    last = m.withColumn("last", F.max("ord").over(Window.partitionBy("session_id"))).where("ord = last")
    return r6(last.select("session_id", "segment", "folded_seq", "turn_seq", "l", "dead", "g", "x", "dhat", "x_sweet", "burn", "mf", "br", "deep_water", "cycles", "progress", "gate_open"), "g", "x", "dhat", "x_sweet", "burn", "mf", "br", "progress")


def peaks(spark, sf):
    cols = ("br_peak", "pp_peak", "g_min")
    return r6(calls.segment_peaks(positioned(spark, sf)).select(*KEY, "segment", "l_peak", *cols, "turn_at_br_amber"), *cols)


PEAKS_SQL = with_positions(f"""
, t AS (SELECT *, turn_seq - min(turn_seq) OVER (PARTITION BY session_id, segment ORDER BY ord ROWS UNBOUNDED PRECEDING) AS turn_rel FROM pos_v),
k AS (SELECT *, max(l) OVER w AS l_peak, max(br) OVER w AS br_peak, max(pp) OVER w AS pp_peak, min(g) OVER w AS g_min, min(CASE WHEN br >= CAST(0.1 AS DOUBLE) THEN turn_rel END) OVER w AS turn_at_br_amber
  FROM t WINDOW w AS (PARTITION BY session_id, segment ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT session_id, ord, segment, l_peak, {round_sql("br_peak", "pp_peak", "g_min")}, turn_at_br_amber FROM k""")


def continuity(spark, sf):
    """Samples with a repeated, a skipped and an unreliable number every so often."""
    p = positioned(spark, sf)
    n = F.col("folded_seq")
    samples = p.select("session_id", "ord", F.when(n % 17 == 0, n - 1).otherwise(n).cast("long").alias("seq"), "turn_seq", "l", "burn", (n % 7 != 3).alias("reliable")).where("ord % 23 <> 5")
    return billing.check_continuity(samples).select("session_id", "ord", "seq", "state")


CONTINUITY_SQL = with_positions("""
, s AS (SELECT session_id, ord, CASE WHEN folded_seq % 17 = 0 THEN folded_seq-1 ELSE folded_seq END AS seq, l, folded_seq % 7 <> 3 AS reliable FROM pos_v WHERE ord % 23 <> 5),
a AS (SELECT *, max(seq) OVER w AS seen, last_value(CASE WHEN reliable THEN l END IGNORE NULLS) OVER w AS last_l FROM s WINDOW w AS (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CASE WHEN seq = seen AND reliable AND l <> last_l THEN 'folded_call_mutated' WHEN seq <= seen THEN 'repeated' WHEN seq > seen+1 THEN 'folded_seq_gap' WHEN NOT reliable THEN 'unreliable' ELSE 'good' END AS st FROM a),
c AS (SELECT *, last_value(CASE WHEN st <> 'repeated' THEN st END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
SELECT session_id, ord, seq, CASE WHEN st <> 'good' THEN st WHEN before = 'good' THEN 'applied' ELSE 'anchor' END AS state FROM c""")


def projection(spark, sf):
    a = analysed(spark, sf)
    last = a.join(a.groupBy("session_id").agg(F.max("ord").alias("ord")), KEY)
    return r6(calls.project_growth(last, 60, 21000), "x1", "l1")


PROJECTION_SQL = with_calls("""
, t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS back FROM calls_v), u AS (SELECT *, CASE WHEN 60-folded_seq < 5 THEN folded_seq+20 ELSE 60 END AS far FROM t WHERE back = 1),
v AS (SELECT *, l+g*(far-folded_seq) AS reach FROM u)
SELECT session_id, folded_seq AS x0, l AS l0, round(CASE WHEN reach > 21000 THEN folded_seq+(21000-l)/g ELSE far END, 6) AS x1, round(least(reach, 21000), 6) AS l1 FROM v""")

HISTORY = ("x", "g")

QUERIES = {
    "fold_max_total": (_fold("max_total"), _fold_sql("cr+cc+inp+outp, ord")),
    "fold_last": (_fold("last"), _fold_sql("ord")),
    "fold_effect": (lambda s, d: r6(calls.fold_effect(usage(s, d), "pair_id"), "row_factor", "stock_factor"), with_usage("""
      , c AS (SELECT session_id, pair_id, arg_max(cr+cc+inp, k) AS stock FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pair_id ORDER BY cr+cc+inp+outp, ord) AS k FROM usage_v) GROUP BY 1, 2)
      SELECT (SELECT count(*) FROM usage_v) AS n_rows, (SELECT count(*) FROM c) AS n_calls, round((SELECT count(*) FROM usage_v)/CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS row_factor,
      round((SELECT sum(cr+cc+inp) FROM usage_v)/CAST((SELECT sum(stock) FROM c) AS DOUBLE), 6) AS stock_factor""")),
    "model_properties": (model_properties, MODEL_SQL),
    "number_calls_turns": (lambda s, d: calls.number_turns(calls.number_calls(usage(s, d))).select(*KEY, "folded_seq", "turn_seq"), with_calls("SELECT session_id, ord, folded_seq, turn_seq FROM calls_v")),
    "miss_segment": (lambda s, d: analysed(s, d).select(*KEY, "miss", "l", "boundary", "segment", "prev_l"), with_calls("SELECT session_id, ord, miss, l, boundary, segment, prev_l FROM calls_v")),
    "segment_floor_delta": (lambda s, d: analysed(s, d).select(*KEY, "dead", "ceiling", "delta_l"), with_calls("SELECT session_id, ord, dead, ceiling, delta_l FROM calls_v")),
    "growth_ema": (lambda s, d: r6(analysed(s, d).select(*KEY, "g_ema", "g"), "g_ema", "g"), with_calls(f"SELECT session_id, ord, {round_sql('g_ema', 'g')} FROM calls_v")),
    "history": (lambda s, d: r6(calls.history(analysed(s, d)).drop("ts"), *HISTORY), with_calls("SELECT session_id, folded_seq, segment, l, dead AS b, round(CASE WHEN dead > 0 THEN l/CAST(dead AS DOUBLE) ELSE 1 END, 6) AS x, round(g, 6) AS g, miss, cr, cc, turn_seq FROM calls_v")),
    "series_peak": (lambda s, d: calls.series_peak(analysed(s, d)), with_calls("SELECT session_id, greatest(max(l), 1) AS peak, count(*) FILTER (WHERE miss) AS n_misses FROM calls_v GROUP BY session_id")),
    "growth_projection": (projection, PROJECTION_SQL),
    "segment_peaks": (peaks, PEAKS_SQL),
    "economics": (economics, ECONOMICS_SQL),
    "what_if": (what_if, WHAT_IF_SQL),
    "bill_meter": (lambda s, d: r6(metered(s, d).select(*KEY, "cycles", "progress", "new_cycles"), "progress"), with_meter("SELECT session_id, ord, cycles, round(progress, 6) AS progress, new_cycles FROM meter_v")),
    "alert_gate": (lambda s, d: metered(s, d).select(*KEY, "deep_water", "gate_open", "gate_fires"), with_meter("SELECT session_id, ord, deep_water, gate_open, gate_fires FROM meter_v")),
    "session_status": (session_status, with_meter(f"""SELECT session_id, segment, folded_seq, turn_seq, l, dead, {round_sql('g', 'x', 'dhat', 'x_sweet', 'burn', 'mf', 'br', 'progress')}, deep_water, cycles, gate_open
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord DESC) AS back FROM meter_v) WHERE back = 1""")),
    "backstop": (lambda s, d: billing.backstop(metered(s, d)).select(*KEY, "dw_bills", "laps", "backstop_fires"), with_meter(BACKSTOP_SQL + " SELECT session_id, ord, dw_bills, laps, backstop_fires FROM stop_v")),
    "backstop_unconsumed": (lambda s, d: billing.backstop(metered(s, d), consume=False).select(*KEY, "dw_bills", "backstop_fires"), with_meter(BACKSTOP_SQL + """,
      kept_v AS (SELECT *, sum(CASE WHEN counts THEN CAST(new_cycles AS DOUBLE) ELSE 0 END) OVER (PARTITION BY session_id, segment ORDER BY ord) AS bills_kept FROM w0)
      SELECT session_id, ord, bills_kept AS dw_bills, coalesce(counts AND bills_kept >= bills_wanted, false) AS backstop_fires FROM kept_v""")),
    "turn_gate": (lambda s, d: billing.turn_gate(positioned(s, d)), with_meter(GATE_SQL + " SELECT session_id, segment, ord, turn_seq, z.tell AS notify FROM t1")),
    "sample_continuity": (continuity, CONTINUITY_SQL),
}

RECON = ("hit_ratio", "miss_ratio", "out_ratio", "usd_recon", "usd_bill", "usd_ratio", "usd_err", "miss_pct_of_bill")
RECON_SQL = """
, ru AS (SELECT CAST(ts AS DATE) AS day, sum(cr) AS hit, sum(cc+inp) AS miss, sum(outp) AS o FROM usage_v WHERE contains(model, 'pro') GROUP BY 1),
rb AS (SELECT day, sum(CASE WHEN type='input_cache_hit_tokens' THEN amount ELSE 0 END) AS bh, sum(CASE WHEN type='input_cache_miss_tokens' THEN amount ELSE 0 END) AS bm, sum(CASE WHEN type='output_tokens' THEN amount ELSE 0 END) AS bo FROM bill_v WHERE contains(model, 'pro') GROUP BY 1),
rj AS (SELECT rb.day, bh, bm, bo, coalesce(hit, 0) AS hit, coalesce(miss, 0) AS miss, coalesce(o, 0) AS o FROM rb LEFT JOIN ru ON rb.day = ru.day),
rd AS (SELECT day, CASE WHEN bh > 0 THEN hit/CAST(bh AS DOUBLE) ELSE 0 END AS hit_ratio, CASE WHEN bm > 0 THEN miss/CAST(bm AS DOUBLE) ELSE 0 END AS miss_ratio, CASE WHEN bo > 0 THEN o/CAST(bo AS DOUBLE) ELSE 0 END AS out_ratio,
  hit*CAST(2.5e-8 AS DOUBLE)+miss*CAST(3e-6 AS DOUBLE)+o*CAST(6e-6 AS DOUBLE) AS usd_recon, bh*CAST(2.5e-8 AS DOUBLE)+bm*CAST(3e-6 AS DOUBLE)+bo*CAST(6e-6 AS DOUBLE) AS usd_bill, bm, hit, miss, o FROM rj),
days AS (SELECT *, usd_recon/usd_bill AS usd_ratio, usd_recon-usd_bill AS usd_err, 100*bm*CAST(3e-6 AS DOUBLE)/usd_bill AS miss_pct_of_bill FROM rd)"""


def _recon(spark, sf):
    return billing.reconcile(usage(spark, sf), bill(spark, sf), "pro")


def _summary(spark, sf):
    rows = billing.recovery_summary(_recon(spark, sf))
    return r6(rows, *[c for c in rows.columns if c != "n_days"])


QUERIES |= {
    "daily_usage": (lambda s, d: billing.daily_usage(usage(s, d), "flash"), with_usage("SELECT CAST(ts AS DATE) AS day, CAST(sum(cr) AS BIGINT) AS hit, CAST(sum(cc+inp) AS BIGINT) AS miss, CAST(sum(outp) AS BIGINT) AS out FROM usage_v WHERE contains(model, 'flash') GROUP BY 1")),
    "bill_wide": (lambda s, d: billing.bill_wide(bill(s, d), "flash"), with_bill("""SELECT day, CAST(sum(CASE WHEN type='input_cache_hit_tokens' THEN amount END) AS BIGINT) AS bill_hit, CAST(sum(CASE WHEN type='input_cache_miss_tokens' THEN amount END) AS BIGINT) AS bill_miss,
      CAST(sum(CASE WHEN type='output_tokens' THEN amount END) AS BIGINT) AS bill_out, CAST(2e-8 AS DOUBLE) AS price_hit, CAST(1e-6 AS DOUBLE) AS price_miss, CAST(2e-6 AS DOUBLE) AS price_out FROM bill_v WHERE contains(model, 'flash') GROUP BY day""")),
    "bill_reconciliation": (lambda s, d: r6(_recon(s, d), *RECON), with_bill(f"{RECON_SQL} SELECT day, {round_sql(*RECON)} FROM days")),
    "recovery_summary": (_summary, with_bill(RECON_SQL + " SELECT count(*) AS n_days, " + ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for f, n in (("median", "median"), ("avg", "mean")) for c in ("hit_ratio", "miss_ratio", "out_ratio", "usd_ratio")) + ", round(sum(usd_recon)/sum(usd_bill), 6) AS aggregate FROM days")),
    "recovery_holdout": (lambda s, d: r6(billing.holdout(_recon(s, d), "2024-01-20"), "median", "aggregate", "low", "high"), with_bill(RECON_SQL + " SELECT CASE WHEN day < DATE '2024-01-20' THEN 'first' ELSE 'last' END AS part, count(*) AS n_days, round(median(usd_ratio), 6) AS median, round(sum(usd_recon)/sum(usd_bill), 6) AS aggregate, round(min(usd_ratio), 6) AS low, round(max(usd_ratio), 6) AS high FROM days GROUP BY 1")),
    "naive_baselines": (lambda s, d: r6(billing.naive_baselines(usage(s, d), bill(s, d), "pro"), "no_cache", "all_read"), with_bill(RECON_SQL + " SELECT round(sum((hit+miss)*CAST(3e-6 AS DOUBLE)+o*CAST(6e-6 AS DOUBLE))/sum(usd_bill), 6) AS no_cache, round(sum((hit+miss)*CAST(2.5e-8 AS DOUBLE)+o*CAST(6e-6 AS DOUBLE))/sum(usd_bill), 6) AS all_read FROM days")),
}
