"""Inputs of the registered queries and the matching SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline.operators import billing, calls
from stockline.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return T.usage_view(T.read(spark, sf, "events"))


def bill(spark: SparkSession, sf: str) -> DataFrame:
    return T.bill_view(usage(spark, sf))


def touches(spark: SparkSession, sf: str) -> DataFrame:
    return T.touch_view(T.read(spark, sf, "lineitem"))


def paths_of(spark: SparkSession, sf: str) -> DataFrame:
    return T.path_view(T.read(spark, sf, "lineitem"))


def dealt(spark: SparkSession, sf: str, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of touches dealt by keys to as many tasks as the touches have, so that a task holds few of the 200 sessions."""
    return rows.repartition(T.tasks_for(T.read(spark, sf, "lineitem"), T.TOUCH_ROWS), *keys)


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return calls.analyse(usage(spark, sf))


def positioned(spark: SparkSession, sf: str) -> DataFrame:
    return billing.position(analysed(spark, sf))


def metered(spark: SparkSession, sf: str) -> DataFrame:
    return billing.alert_gate(billing.bill_meter(positioned(spark, sf)))


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to six places, to compare with another engine's."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


W = "PARTITION BY session_id ORDER BY ord"
S = "PARTITION BY session_id, segment ORDER BY ord"
SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

CALLS_SQL = f"""
c0 AS (SELECT *, cr+cc+inp AS stock, row_number() OVER ({W}) AS folded_seq,
    coalesce(lag(cr) OVER ({W}), 0) AS p_hit, coalesce(lag(cr+cc) OVER ({W}), 0) AS p_miss, coalesce(lag(cr+cc+inp) OVER ({W}), 0) AS p_stock FROM usage_v),
c1 AS (SELECT *, sum(CASE WHEN folded_seq = 1 OR human_turn THEN 1 ELSE 0 END) OVER ({W} {SO_FAR}) AS turn_seq,
    (p_hit > 0 AND cr < CAST(0.95 AS DOUBLE)*p_hit AND stock >= p_stock-100) AS a, (p_miss > 0 AND cr < CAST(0.95 AS DOUBLE)*p_miss AND stock >= p_stock-100) AS b FROM c0),
c2 AS (SELECT *, coalesce(last_value(CASE WHEN a = b THEN a END IGNORE NULLS) OVER ({W} {SO_FAR}), false) AS miss FROM c1),
c3 AS (SELECT *, CASE WHEN miss THEN cr+cc ELSE cr END AS l, (p_stock > 0 AND stock < p_stock-100) AS boundary FROM c2),
c4 AS (SELECT *, sum(CASE WHEN boundary THEN 1 ELSE 0 END) OVER ({W} {SO_FAR}) AS segment, greatest(cr, cc, inp) AS top FROM c3),
c5 AS (SELECT *, lag(l) OVER ({S}) AS prev_l,
    first_value(CASE WHEN top > 0 THEN top END IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dead,
    first_value(CASE WHEN top > 0 THEN stock END IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ceiling FROM c4),
c6 AS (SELECT *, CASE WHEN prev_l < ceiling AND l-prev_l > 0 THEN greatest(0, l-ceiling) ELSE l-prev_l END AS delta_l FROM c5),
c7 AS (SELECT *, CAST(greatest(delta_l, CASE WHEN delta_l IS NULL THEN NULL ELSE 0 END) AS DOUBLE) AS residual FROM c6),
c8 AS (SELECT *, list(coalesce(residual, CASE WHEN delta_l IS NULL THEN CAST(-1 AS DOUBLE) END)) OVER ({S} ROWS BETWEEN 288 PRECEDING AND CURRENT ROW) AS rs FROM c7),
c9 AS (SELECT *, list_reduce(rs, lambda g, r: CASE WHEN r < 0 THEN CAST(100 AS DOUBLE) ELSE CAST(0.12 AS DOUBLE)*r + CAST(0.88 AS DOUBLE)*g END, CAST(100 AS DOUBLE)) AS g_ema FROM c8),
calls_v AS (SELECT *, greatest(g_ema, CAST(100 AS DOUBLE)) AS g FROM c9)"""

RATIO = "CASE WHEN regexp_matches(model, '(?i)claude|opus|sonnet|haiku') THEN CAST(12.5 AS DOUBLE) WHEN regexp_matches(model, '(?i)deepseek.*pro') THEN 120 WHEN regexp_matches(model, '(?i)deepseek') THEN 50 ELSE 10 END"

POSITION_SQL = f"""
q0 AS (SELECT *, {RATIO} AS r, CASE WHEN dead > 0 THEN l/CAST(dead AS DOUBLE) END AS x FROM calls_v),
q1 AS (SELECT *, CASE WHEN g > 0 AND dead > 0 THEN sqrt(2*r*g/dead) ELSE 0 END AS dhat, CASE WHEN g > 0 AND dead > 0 THEN sqrt(2*r*dead*g)/(sqrt(2*r*dead*g)+dead+r*g) END AS mf,
    CASE WHEN dead > 0 THEN greatest(0, l-dead)/(r*dead) END AS burn FROM q0),
q2 AS (SELECT *, 1+dhat AS x_sweet, CASE WHEN dhat > 0 AND x > 1 THEN (x-1)/dhat END AS u FROM q1),
q3 AS (SELECT *, (u-1)*(u-1)/(2*u) AS pp, mf*((u-1)*(u-1)/(2*u)) AS br FROM q2),
pos_v AS (SELECT *, coalesce(x >= x_sweet AND br >= CAST(0.1 AS DOUBLE), false) AS deep_water FROM q3)"""

METER_SQL = f"""
m0 AS (SELECT *, coalesce(CAST(floor((lag(burn) OVER ({S}) + burn)/2*1000000) AS BIGINT), 0) AS t FROM pos_v),
m1 AS (SELECT *, CAST(sum(t) OVER ({S} {SO_FAR}) AS BIGINT) AS mc FROM m0),
m2 AS (SELECT *, mc // 1000000 AS cycles, (mc % 1000000)/CAST(1000000 AS DOUBLE) AS progress FROM m1),
m3 AS (SELECT *, cycles - coalesce(lag(cycles) OVER ({S}), 0) AS new_cycles, sum(CASE WHEN deep_water THEN 0 ELSE 1 END) OVER ({S} {SO_FAR}) AS run FROM m2),
m4 AS (SELECT *, sum(CASE WHEN deep_water THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, segment, run ORDER BY ord {SO_FAR}) AS n,
    sum(CASE WHEN deep_water THEN new_cycles ELSE 0 END) OVER (PARTITION BY session_id, segment, run ORDER BY ord {SO_FAR}) AS k FROM m3),
m5 AS (SELECT *, min(CASE WHEN deep_water AND n >= 3 AND k > 0 THEN ord END) OVER ({S} {SO_FAR}) AS fire FROM m4),
meter_v AS (SELECT *, fire IS NOT NULL AS gate_open, coalesce(fire = ord, false) AS gate_fires FROM m5)"""


#: The backstop, one call after the other: the accumulator has the fields of an element.
BACKSTOP_SQL = f"""
, w0 AS (SELECT *, CASE WHEN mf > 0 THEN ((mf+0.1+sqrt((mf+0.1)*(mf+0.1)-mf*mf))/mf)*((mf+0.1+sqrt((mf+0.1)*(mf+0.1)-mf*mf))/mf) END AS bills_wanted,
  gate_open AND NOT gate_fires AND deep_water AS counts FROM meter_v),
w1 AS (SELECT *, list({{'c': counts, 'n': CAST(new_cycles AS DOUBLE), 'i': CAST(bills_wanted AS DOUBLE), 'bills': CAST(0 AS DOUBLE), 'laps': CAST(0 AS BIGINT), 'fired': false}}) OVER ({S} {SO_FAR}) AS xs FROM w0),
w2 AS (SELECT *, list_reduce(xs, lambda zs, zx: CASE WHEN zx.c AND coalesce(zs.bills + zx.n >= zx.i, false) THEN {{'c': zx.c, 'n': zx.n, 'i': zx.i, 'bills': CAST(0 AS DOUBLE), 'laps': zs.laps + 1, 'fired': true}}
  WHEN zx.c THEN {{'c': zx.c, 'n': zx.n, 'i': zx.i, 'bills': zs.bills + zx.n, 'laps': zs.laps, 'fired': false}} ELSE {{'c': zx.c, 'n': zx.n, 'i': zx.i, 'bills': zs.bills, 'laps': zs.laps, 'fired': false}} END,
  {{'c': false, 'n': CAST(0 AS DOUBLE), 'i': CAST(NULL AS DOUBLE), 'bills': CAST(0 AS DOUBLE), 'laps': CAST(0 AS BIGINT), 'fired': false}}) AS z FROM w1),
stop_v AS (SELECT *, z.bills AS dw_bills, z.laps AS laps, z.fired AS backstop_fires FROM w2)"""

#: The turn gate, one turn after the other.
GATE_SQL = f"""
, t0 AS (SELECT *, list({{'turn': CAST(turn_seq AS BIGINT), 'br': br, 'last': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'fired': false, 'armed': true, 'tell': false}}) OVER ({S} {SO_FAR}) AS xs FROM meter_v),
t1 AS (SELECT *, list_reduce(xs, lambda zs, zx: CASE WHEN zx.turn <= zs.last THEN {{'turn': zx.turn, 'br': zx.br, 'last': zs.last, 'n': zs.n, 'fired': zs.fired, 'armed': zs.armed, 'tell': false}}
  WHEN zx.br IS NULL THEN {{'turn': zx.turn, 'br': zx.br, 'last': zx.turn, 'n': CAST(0 AS BIGINT), 'fired': zs.fired, 'armed': zs.armed, 'tell': false}}
  WHEN zx.br >= CAST(0.1 AS DOUBLE) AND zs.n + 1 >= 3 AND zs.armed AND NOT zs.fired THEN {{'turn': zx.turn, 'br': zx.br, 'last': zx.turn, 'n': zs.n + 1, 'fired': true, 'armed': false, 'tell': true}}
  WHEN zx.br >= CAST(0.1 AS DOUBLE) THEN {{'turn': zx.turn, 'br': zx.br, 'last': zx.turn, 'n': zs.n + 1, 'fired': zs.fired, 'armed': zs.armed, 'tell': false}}
  ELSE {{'turn': zx.turn, 'br': zx.br, 'last': zx.turn, 'n': CAST(0 AS BIGINT), 'fired': zs.fired AND zx.br >= CAST(0.08 AS DOUBLE), 'armed': zs.armed OR zx.br < CAST(0.08 AS DOUBLE), 'tell': false}} END,
  {{'turn': CAST(0 AS BIGINT), 'br': CAST(NULL AS DOUBLE), 'last': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'fired': false, 'armed': true, 'tell': false}}) AS z FROM t0)"""

#: Jumps, one call after the other: z holds the level of the base, whether the call jumped, and by how much.
JUMPS_SQL = f"""
, j0 AS (SELECT session_id, segment, ord, CAST(l AS DOUBLE) AS l, row_number() OVER ({S}) AS i, l - lag(l) OVER ({S}) AS step FROM calls_v),
j1 AS (SELECT session_id, segment, CAST(median(CAST(step AS DOUBLE)) FILTER (WHERE step > 0) AS DOUBLE) AS k_stable FROM j0 GROUP BY 1, 2),
j2 AS (SELECT j0.*, k_stable, l - k_stable*i AS level FROM j0 JOIN j1 ON j0.session_id = j1.session_id AND j0.segment = j1.segment WHERE k_stable > 0),
j3 AS (SELECT *, CASE WHEN count(*) OVER ({S} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 THEN min(level) OVER ({S} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS reach FROM j2),
j4 AS (SELECT *, list({{'v': level, 'r': reach, 'k': k_stable, 'base': CAST(NULL AS DOUBLE), 'size': CAST(NULL AS DOUBLE)}}) OVER ({S} {SO_FAR}) AS xs FROM j3),
j5 AS (SELECT *, list_reduce(xs, lambda zs, zx: CASE WHEN zs.base IS NULL THEN {{'v': zx.v, 'r': zx.r, 'k': zx.k, 'base': zx.v, 'size': CAST(NULL AS DOUBLE)}}
  WHEN zx.r > zs.base + 8*zx.k THEN {{'v': zx.v, 'r': zx.r, 'k': zx.k, 'base': zx.v, 'size': zx.v - zs.base}} ELSE {{'v': zx.v, 'r': zx.r, 'k': zx.k, 'base': zs.base, 'size': CAST(NULL AS DOUBLE)}} END,
  {{'v': CAST(0 AS DOUBLE), 'r': CAST(NULL AS DOUBLE), 'k': CAST(0 AS DOUBLE), 'base': CAST(NULL AS DOUBLE), 'size': CAST(NULL AS DOUBLE)}}) AS z FROM j4)
SELECT session_id, segment, ord, z.size AS size, k_stable FROM j5 WHERE z.size IS NOT NULL"""


def with_usage(select: str) -> str:
    return f"WITH {T.USAGE_SQL} {select}"


def with_bill(select: str) -> str:
    return f"WITH {T.USAGE_SQL}, {T.BILL_SQL} {select}"


def with_touches(select: str) -> str:
    """select may begin with a comma and further common tables."""
    return f"WITH {T.TOUCH_SQL} {select}"


def with_calls(select: str) -> str:
    return f"WITH {T.USAGE_SQL}, {CALLS_SQL} {select}"


def with_positions(select: str) -> str:
    return f"WITH {T.USAGE_SQL}, {CALLS_SQL}, {POSITION_SQL} {select}"


def with_meter(select: str) -> str:
    return f"WITH {T.USAGE_SQL}, {CALLS_SQL}, {POSITION_SQL}, {METER_SQL} {select}"


def round_sql(*columns: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in columns)
