"""Bill meter and alerts for each call, and the daily reconciliation of logs with the provider's bill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.functions import economics as E
from stockline.functions.models import tier_model
from stockline.sources.shared import cut_lineage

from . import latch
from .calls import by_segment, so_far

MICRO = 1_000_000
DWELL, HYSTERESIS = 3, 0.02


def position(calls: DataFrame, b: str = "dead") -> DataFrame:
    """Adds r, x, dhat, x_sweet, mf, br, pp, burn and deep_water; B defaults to the segment's floor."""
    from stockline.functions.models import c_ratio_for

    base = F.col(b).cast("double")
    rows = calls.withColumn("r", c_ratio_for(F.col("model"))).withColumn("x", F.when(base > 0, F.col("l") / base))
    rows = rows.withColumn("dhat", E.dhat(F.col("r"), F.col("g"), base)).withColumn("mf", E.movable_frac(F.col("r"), base, F.col("g")))
    rows = rows.withColumn("x_sweet", 1 + F.col("dhat")).withColumn("br", E.bill_regret(F.col("x"), F.col("dhat"), F.col("mf")))
    rows = rows.withColumn("pp", F.when(F.col("dhat") > 0, E.premium((F.col("x") - 1) / F.col("dhat")))).withColumn("burn", E.burn_rate(F.col("l"), base, F.col("r")))
    return rows.withColumn("deep_water", E.in_deep_water(F.col("x"), F.col("x_sweet"), F.col("br")))


def bill_meter(calls: DataFrame) -> DataFrame:
    """Adds ``cycles`` (so far), ``progress`` and ``new_cycles``: the trapezoid of the burn rate as a prefix sum of millionths.

    Calls without a burn rate pause the meter; the next one with a rate only anchors it again.
    """
    trapezoid = F.floor((F.lag("burn").over(by_segment()) + F.col("burn")) / 2 * MICRO).cast("long")
    rows = calls.withColumn("_t", F.coalesce(trapezoid, F.lit(0).cast("long"))).withColumn("_c", F.sum("_t").over(so_far(by_segment())))
    whole = F.floor(F.col("_c") / MICRO).cast("long")
    rows = rows.withColumn("cycles", whole).withColumn("progress", (F.col("_c") % MICRO) / MICRO)
    return rows.withColumn("new_cycles", F.col("cycles") - F.coalesce(F.lag("cycles").over(by_segment()), F.lit(0))).drop("_t", "_c")


def alert_gate(calls: DataFrame, dwell: int = DWELL) -> DataFrame:
    """Adds ``gate_fires`` (one call of a segment at most) and ``gate_open`` (from that call on).

    The gate fires at the first call of a deep-water run that is the dwell-th or later and has seen a bill cycle in the run.
    """
    rows = calls.withColumn("_run", F.sum(F.when(F.col("deep_water"), 0).otherwise(1)).over(so_far(by_segment())))
    run = Window.partitionBy("session_id", "segment", "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = F.col("deep_water").cast("long")
    rows = rows.withColumn("_n", F.sum(deep).over(run)).withColumn("_k", F.sum(deep * F.col("new_cycles")).over(run))
    rows = rows.withColumn("_ok", F.col("deep_water") & (F.col("_n") >= dwell) & (F.col("_k") > 0))
    first = F.min(F.when(F.col("_ok"), F.col("ord"))).over(so_far(by_segment()))
    return rows.withColumn("gate_open", first.isNotNull()).withColumn("gate_fires", F.coalesce(first == F.col("ord"), F.lit(False))).drop("_run", "_n", "_k", "_ok")


def backstop(calls: DataFrame, consume: bool = True) -> DataFrame:
    """Adds ``dw_bills``, ``laps`` and ``backstop_fires``: bills in deep water after the gate, back to zero when they reach the interval of that call.

    Bills are a running sum, so the call that fires after another is the first whose sum less its interval reaches the sum there (``latch.fires``).
    With ``consume=False`` a fire is reported and nothing is reset.
    """
    interval = E.backstop_interval(F.col("mf"))
    counts = F.col("gate_open") & ~F.col("gate_fires") & F.col("deep_water")
    rows = calls.withColumn("_sum", F.sum(F.when(counts, F.col("new_cycles")).otherwise(0)).over(so_far(by_segment())).cast("double"))
    rows = rows.withColumn("_reach", F.when(counts & (interval > 0) & (interval < float("inf")), F.col("_sum") - interval))
    if not consume:
        return rows.withColumns({"dw_bills": F.col("_sum"), "laps": F.lit(0), "backstop_fires": F.coalesce(F.col("_reach") >= 0, F.lit(False))}).drop("_sum", "_reach")
    keys = ("session_id", "segment")
    rows = cut_lineage(rows)  # the latch reads them several times, and the windows below shouldn't share a task with those above
    small = rows.where("_reach IS NOT NULL").select(*keys, "ord", F.col("_sum").alias("need"), F.col("_reach").alias("reach"))
    found = latch.fires(small, keys, small.select(*keys).distinct().withColumn("need", F.lit(0.0))).withColumn("_fires", F.lit(True))
    rows = rows.join(found, [*keys, "ord"], "left").withColumn("backstop_fires", F.coalesce("_fires", F.lit(False)))
    base = F.last(F.when(F.col("backstop_fires"), F.col("_sum")), ignorenulls=True).over(so_far(by_segment()))
    rows = rows.withColumn("dw_bills", F.col("_sum") - F.coalesce(base, F.lit(0.0))).withColumn("laps", F.sum(F.col("backstop_fires").cast("int")).over(so_far(by_segment())).cast("int"))
    return rows.select(*calls.columns, "dw_bills", "laps", "backstop_fires")


def turn_gate(turns: DataFrame, dwell: int = DWELL, hyst: float = HYSTERESIS, amber: float = E.BR_AMBER) -> DataFrame:
    """Adds ``notify`` to turns (session_id, segment, turn_seq, br): fires after ``dwell`` turns at amber, re-armed below amber - hyst.

    Turns that don't go on are left out. A turn below amber - hyst arms the gate, so turns between two such ones have one notice at most: the
    first at the end of ``dwell`` turns at amber in a row.
    """
    order = Window.partitionBy("session_id", "segment").orderBy("ord", "turn_seq")
    last = F.coalesce(F.max("turn_seq").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    br = F.when(~F.isnan("br"), F.col("br"))
    rows = turns.select("session_id", "segment", "ord", "turn_seq", br.alias("br"), (F.col("turn_seq") > last).alias("_on"))
    on = rows.where("_on").withColumn("_high", F.coalesce(F.col("br") >= amber, F.lit(False)))
    epoch = F.sum(F.coalesce(F.col("br") < amber - hyst, F.lit(False)).cast("int")).over(so_far(order))
    run = F.sum((~F.col("_high")).cast("int")).over(so_far(order))
    on = on.withColumn("_epoch", epoch).withColumn("_run", run)
    inside = Window.partitionBy("session_id", "segment", "_run").orderBy("ord", "turn_seq")
    on = on.withColumn("_n", F.sum(F.col("_high").cast("int")).over(so_far(inside)))
    due = F.col("_high") & (F.col("_n") >= dwell)
    told = F.sum(due.cast("int")).over(so_far(Window.partitionBy("session_id", "segment", "_epoch").orderBy("ord", "turn_seq")))
    on = on.select("session_id", "segment", "ord", "turn_seq", (due & (told == 1)).alias("notify"))
    return on.unionByName(rows.where("NOT _on").select("session_id", "segment", "ord", "turn_seq", F.lit(False).alias("notify")))


def check_continuity(samples: DataFrame) -> DataFrame:
    """Adds ``state`` to samples (session_id, ord, seq, turn_seq, l, burn, reliable).

    repeated, folded_call_mutated, folded_seq_gap, invalid_sample, unreliable, anchor (first good one after a pause) or applied.
    """
    w = Window.partitionBy("session_id").orderBy("ord")
    valid = valid_sample()
    seen = F.max(F.when(valid, F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last_l = F.last(F.when(valid & F.col("reliable"), F.col("l")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = (
        F.when(~valid, "invalid_sample")
        .when((F.col("seq") == seen) & F.col("reliable") & (F.col("l") != last_l), "folded_call_mutated")
        .when(F.col("seq") <= seen, "repeated").when(F.col("seq") > seen + 1, "folded_seq_gap").when(~F.col("reliable"), "unreliable").otherwise("good")
    )
    rows = samples.withColumn("_s", first)
    before = F.last(F.when(F.col("_s") != "repeated", F.col("_s")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("state", F.when(F.col("_s") != "good", F.col("_s")).when(before == "good", "applied").otherwise("anchor")).drop("_s")


def valid_sample() -> Column:
    """Whole non-negative seq and turn; finite non-negative L and rate where the sample is reliable."""
    number = lambda c: F.col(c).isNotNull() & (F.col(c) >= 0) & (F.col(c) < E.INFINITE) & ~F.isnan(F.col(c).cast("double"))
    return (F.col("seq") >= 0) & (F.col("turn_seq") >= 0) & F.coalesce(F.col("reliable"), F.lit(False)).isNotNull() & (~F.coalesce("reliable", F.lit(False)) | (number("l") & number("burn")))


PAUSE_REASONS = ("insufficient_data", "invalid_sample", "folded_call_mutated", "folded_seq_gap", "invalid_baseline", "cache_unstable")


def ledger_errors() -> Column:
    """Names of the fields of a ledger row that are out of range."""
    tests = {
        "bill_progress": (F.col("bill_progress") >= 0) & (F.col("bill_progress") < 1), "bill_cycles": F.col("bill_cycles") >= 0,
        "dw_bills": F.col("dw_bills") >= 0, "laps": F.col("laps") >= 0, "last_seq": F.col("last_seq") >= 0,
        "paused_reason": F.col("paused_reason").isNull() | F.col("paused_reason").isin(*PAUSE_REASONS),
        "recent_events": F.size("recent_events") <= 32,
    }
    return F.filter(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def daily_usage(usage: DataFrame, tier: str) -> DataFrame:
    """Tokens of each day for a billing tier: hit, miss, out."""
    own = usage.where(tier_model(F.col("model")) == tier)
    return own.groupBy(F.to_date("ts").alias("day")).agg(F.sum("cr").alias("hit"), F.sum(F.col("cc") + F.col("inp")).alias("miss"), F.sum("outp").alias("out"))


COMPONENTS = {"input_cache_hit_tokens": "hit", "input_cache_miss_tokens": "miss", "output_tokens": "out"}


def bill_wide(bill: DataFrame, tier: str) -> DataFrame:
    """Tokens of each day and component on the bill; each component's price is its last one in order of the day."""
    own = bill.where((tier_model(F.col("model")) == tier) & F.col("type").isin(*COMPONENTS))
    cell = lambda t: F.sum(F.when(F.col("type") == t, F.col("amount")))
    days = own.groupBy("day").agg(*[F.coalesce(cell(t), F.lit(0)).alias(f"bill_{c}") for t, c in COMPONENTS.items()])
    prices = own.where("price is not null").agg(*[F.max_by(F.when(F.col("type") == t, F.col("price")), F.when(F.col("type") == t, F.col("day"))).alias(f"price_{c}") for t, c in COMPONENTS.items()])
    return days.join(F.broadcast(prices))  # one row


def join_bill(bill: DataFrame, recon: DataFrame) -> DataFrame:
    """Bill days with what the logs hold of them; a day without logs counts as zero."""
    joined = bill.join(recon, "day", "left")
    return joined.select(*bill.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hit", "miss", "out")])


def reconcile(usage: DataFrame, bill: DataFrame, tier: str, start=None, end=None) -> DataFrame:
    """Per day: recovered share of each component, dollars by logs and by bill, error, and the miss share of the bill."""
    days = join_bill(bill_wide(bill, tier), daily_usage(usage, tier))
    if start is not None:
        days = days.where(F.col("day") >= F.lit(start))
    if end is not None:
        days = days.where(F.col("day") <= F.lit(end))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    price = lambda c: F.coalesce(f"price_{c}", F.lit(0.0))
    dollars = lambda prefix: sum(F.col(prefix + c) * price(c) for c in ("hit", "miss", "out"))
    rows = days.withColumn("usd_recon", dollars("")).withColumn("usd_bill", dollars("bill_"))
    return rows.select(
        "day", ratio("hit", "bill_hit").alias("hit_ratio"), ratio("miss", "bill_miss").alias("miss_ratio"), ratio("out", "bill_out").alias("out_ratio"),
        "usd_recon", "usd_bill", ratio("usd_recon", "usd_bill").alias("usd_ratio"), (F.col("usd_recon") - F.col("usd_bill")).alias("usd_err"),
        F.when(F.col("usd_bill") > 0, 100 * F.col("bill_miss") * price("miss") / F.col("usd_bill")).otherwise(0.0).alias("miss_pct_of_bill"),
    )


def recovery_summary(days: DataFrame) -> DataFrame:
    """Median and mean over days, and the ratio of the sums."""
    columns = ("hit_ratio", "miss_ratio", "out_ratio", "usd_ratio")
    return days.agg(
        F.count("*").alias("n_days"), *[F.median(c).alias(f"median_{c}") for c in columns], *[F.avg(c).alias(f"mean_{c}") for c in columns],
        (F.sum("usd_recon") / F.sum("usd_bill")).alias("aggregate"),
    )


def holdout(days: DataFrame, split) -> DataFrame:
    """The same summary before and from a day on."""
    part = F.when(F.col("day") < F.lit(split), "first").otherwise("last")
    return days.groupBy(part.alias("part")).agg(F.count("*").alias("n_days"), F.median("usd_ratio").alias("median"), (F.sum("usd_recon") / F.sum("usd_bill")).alias("aggregate"), F.min("usd_ratio").alias("low"), F.max("usd_ratio").alias("high"))


def naive_baselines(usage: DataFrame, bill: DataFrame, tier: str) -> DataFrame:
    """The bill against all input at the write price, and all at the read price."""
    days = join_bill(bill_wide(bill, tier), daily_usage(usage, tier))
    tokens = F.col("hit") + F.col("miss")
    at = lambda c: F.sum(tokens * F.col(f"price_{c}") + F.col("out") * F.col("price_out"))
    billed = F.sum(sum(F.col(f"bill_{c}") * F.col(f"price_{c}") for c in ("hit", "miss", "out")))
    return days.agg((at("miss") / billed).alias("no_cache"), (at("hit") / billed).alias("all_read"))


def stream_daily(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Daily totals of a stream of folded calls as event-time windows."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), tier_model(F.col("model")).alias("tier")).agg(
        F.sum("cr").alias("hit"), F.sum(F.col("cc") + F.col("inp")).alias("miss"), F.sum("outp").alias("out")
    ).select(F.to_date("w.start").alias("day"), "tier", "hit", "miss", "out")
