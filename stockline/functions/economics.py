"""Inventory-theory position of a context, as Columns.

L: context length, B: rebuild baseline, R: write price over read price, g: growth per call, x = L / B.
Undefined metrics are null, never NaN, so that they sort and aggregate as missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BR_AMBER, BR_RED = 0.10, 0.25
G_FLOOR = 100.0
INFINITE = float("inf")


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def finite(x: Column) -> Column:
    """Null instead of NaN and infinity."""
    return F.when(~F.isnan(x) & (F.abs(x) != INFINITE), x)


def dhat(r, g, b) -> Column:
    """Optimal step sqrt(2 R g / B), 0 if any is not positive."""
    r, g, b = map(_d, (r, g, b))
    return F.when((r > 0) & (g > 0) & (b > 0), F.sqrt(2 * r * g / b)).otherwise(F.lit(0.0))


def movable_frac(r, b, g) -> Column:
    r, g, b = map(_d, (r, g, b))
    arm = F.sqrt(2 * r * b * g)
    return F.when((r > 0) & (g > 0) & (b > 0), arm / (arm + b + r * g))


def premium(u) -> Column:
    """(u - 1)^2 / (2 u) for u > 0."""
    u = _d(u)
    return F.when(u > 0, (u - 1) * (u - 1) / (2 * u))


def bill_regret(x, d, mf) -> Column:
    x, d, mf = map(_d, (x, d, mf))
    return F.when((x > 1) & (d > 0) & (mf >= 0), mf * premium((x - 1) / F.when(d > 0, d)))


def x_at_regret(target, d, mf, side: str = "right") -> Column:
    """Position right or left of the sweet spot at which the regret is ``target``."""
    target, d, mf = map(_d, (target, d, mf))
    p = target / F.when(mf > 0, mf)
    root = F.sqrt(p * p + 2 * p)
    u = (1 + p) + root if side == "right" else (1 + p) - root
    return F.when((target >= 0) & (d > 0), 1 + u * d)


def in_deep_water(x, x_sweet, br) -> Column:
    return F.coalesce((_d(x) >= _d(x_sweet)) & (_d(br) >= BR_AMBER), F.lit(False))


def gate_regret(x, x_sweet, br) -> Column:
    return F.when(_d(x) >= _d(x_sweet), _d(br))


def u_at_regret(mf, target: float = BR_AMBER) -> Column:
    """Right root of mf (u - 1)^2 / (2 u) = target; infinite without a movable fraction."""
    mf = _d(mf)
    if not math.isfinite(target):
        return F.lit(INFINITE)
    if target <= 0:
        return F.when(mf > 0, F.lit(1.0)).otherwise(F.lit(INFINITE))
    half = mf + target
    return F.when(mf > 0, (2 * half + F.sqrt(4 * half * half - 4 * mf * mf)) / (2 * mf)).otherwise(F.lit(INFINITE))


def backstop_interval(mf, target: float = BR_AMBER) -> Column:
    u = u_at_regret(mf, target)
    return F.when(u == INFINITE, F.lit(INFINITE)).otherwise(u * u)


def landmarks(r, g, base, rebuild) -> dict[str, Column]:
    """dhat, x_entry, x_sweet and x_exit of a rebuild that may be smaller than the base."""
    base, rebuild = _d(base), _d(rebuild)
    b = F.when((base > 0) & (rebuild > 0), rebuild / base).otherwise(F.lit(0.0))
    d = dhat(r, g, base) * F.sqrt(b)
    return {"dhat": d, "x_entry": b + 0.5 * d, "x_sweet": b + d, "x_exit": b + 2 * d}


def h_break(r, b, length) -> Column:
    """Calls after which a restart pays; infinite if nothing is avoidable."""
    r, b, length = map(_d, (r, b, length))
    return F.when(length > b, r * b / (length - b)).otherwise(F.lit(INFINITE))


def band(x, marks: dict[str, Column]) -> Column:
    x = _d(x)
    return F.when(x < marks["x_entry"], "below_entry").when(x < marks["x_sweet"], "entry_to_sweet").when(x < marks["x_exit"], "sweet_to_exit").otherwise("above_exit")


def burn_rate(length, b, r) -> Column:
    length, b, r = map(_d, (length, b, r))
    return F.when((b > 0) & (r > 0), F.greatest(F.lit(0.0), length - b) / (r * b))


def rate_wall(b, r, cap) -> dict[str, Column]:
    b, r = _d(b), _d(r)
    wall = b + r * b
    return {"wall_l": wall, "wall_x": F.when(b > 0, wall / b).otherwise(F.lit(0.0)), "wall_reachable": wall < _d(cap)}


def curve_cost(x, r, x_sweet) -> Column:
    """Average cost per call; infinite at or left of the base."""
    x, r, s = map(_d, (x, r, x_sweet))
    a = (s - 1) * (s - 1) / (2 * r)
    return F.when(x > 1, a / (x - 1) + (x - 1) / (2 * r)).otherwise(F.lit(INFINITE))


def curve_points(low, high, n: int) -> Column:
    """Array of n positions that are dense near the base."""
    a, b = F.log(F.greatest(_d(low) - 1, F.lit(0.001))), F.log(_d(high) - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 1 + F.exp(a + i / (n - 1) * (b - a)))


def zone(br, x, wall, x_sweet) -> Column:
    br, x, wall, s = map(_d, (br, x, wall, x_sweet))
    left = x < s
    return (
        F.when(br.isNull(), "calibrating").when(x >= wall, "wall")
        .when(left & (br >= BR_AMBER), "warmup").when(left, "green")
        .when(br >= BR_RED, "red").when(br >= BR_AMBER, "amber").otherwise("green")
    )


def lamp(br, x, x_sweet, x_left) -> Column:
    br, x, s, left = map(_d, (br, x, x_sweet, x_left))
    return (
        F.when(br.isNull(), "white").when((x < s) & (x >= left), "green").when(x < s, "white")
        .when(br >= BR_RED, "red").when(br >= BR_AMBER, "yellow").otherwise("green")
    )


#: Churn tiers (fixed values): waste below the floor is never coral.
CHURN_AMBER, CHURN_CORAL, CORAL_REREADS, WASTE_FLOOR = 3.0, 5.0, 2, 2500


def churn_tier(churn, waste, pure_rereads) -> Column:
    churn, waste = _d(churn), F.coalesce(_d(waste), F.lit(0.0))
    much = waste >= WASTE_FLOOR
    return F.when(much & (F.coalesce(pure_rereads, F.lit(0)) >= CORAL_REREADS), "coral").when(much & (churn > CHURN_CORAL), "coral").when(churn >= CHURN_AMBER, "amber").otherwise("mint")


def landmarks_ok(*marks: Column) -> Column:
    """Whether the marks that are there grow."""
    test = F.lit(True)
    for a, b in zip(marks, marks[1:], strict=False):
        test = test & F.coalesce(a < b, F.lit(True))
    return test


def rent_meter(dw_bills, mf, d, r, laps) -> dict[str, Column]:
    interval = backstop_interval(mf)
    return {
        "depth_progress": F.when(interval == INFINITE, F.lit(0.0)).otherwise(F.least(F.lit(1.0), _d(dw_bills) / interval)),
        "sweet_rent_rate": _d(d) / F.when(_d(r) > 0, _d(r)), "depth_hot": F.coalesce(laps >= 3, F.lit(False)),
    }


def stop_kind(burn, gate_fired, backstop_fired) -> Column:
    """What a stop message is about: wall before gate before backstop."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(_d(burn) >= 1), "wall").when(yes(gate_fired), "gate").when(yes(backstop_fired), "backstop")


def break_even(r, length, g) -> Column:
    """Calls h with (g/2) h^2 + (L + g/2) h = R L."""
    r, length, g = map(_d, (r, length, g))
    b = length + g / 2
    return F.when((r > 0) & (length > 0) & (g > 0), (-b + F.sqrt(b * b + 2 * g * r * length)) / F.when(g > 0, g))


def order_quantity(r, length, g) -> Column:
    """n* = sqrt(2 R L / g)."""
    return F.when((_d(g) > 0) & (_d(r) > 0) & (_d(length) > 0), F.sqrt(2 * _d(r) * _d(length) / F.when(_d(g) > 0, _d(g))))


def delta_residual(delta_l, delta_b) -> dict[str, Column]:
    raw = _d(delta_l) - _d(delta_b)
    return {"residual": F.greatest(F.lit(0.0), raw), "overshoot": F.greatest(F.lit(0.0), -raw)}


def next_threshold(length, entry, amber, red) -> Column:
    """The mark to show: entry, then amber, then red, which stays."""
    mark = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    return F.when(length < entry, mark("entry", entry)).when(length < amber, mark("amber", amber)).when(red.isNotNull(), mark("red", red)).when(amber.isNotNull(), mark("amber", amber))


def effective_ratio(r, p_ttl, rho) -> Column:
    """R that remains if a share of hand-overs finds the cache expired."""
    r = _d(r)
    return r / (1 + _d(p_ttl) * (1 - _d(rho)) * (r - 1))


def effective_order_quantity(n_star, r, p_cold) -> Column:
    r = _d(r)
    return _d(n_star) * F.sqrt((1 + (r - 1) * _d(p_cold)) / r)


def cost_curve(n, r, length, g) -> dict[str, Column]:
    """Cost per call of restarting every n calls in units of reads, its minimum, and the regret."""
    n, r, length, g = map(_d, (n, r, length, g))
    best = order_quantity(r, length, g)
    k = n / best
    return {"cost": r * length / n + length + g * n / 2, "n_star": best, "regret": (k + 1 / k - 2) / 2 * F.sqrt(2 * r * length * g)}


def revealed_value(bill_progress, price, b) -> Column:
    """What continuity was worth: (progress - 1) restarts."""
    return (_d(bill_progress) - 1) * _d(price) * _d(b)
