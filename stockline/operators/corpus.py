"""Statistics over many sessions: growth fits, break-even shares, linearity, jumps, cold starts, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.functions import economics as E
from stockline.functions.models import c_ratio_for
from stockline.sources.shared import cut_lineage

from . import latch

SEGMENT = ["session_id", "segment"]


def by_segment():
    return Window.partitionBy(*SEGMENT).orderBy("ord")


def growth_fit(usage: DataFrame, least: int = 5) -> DataFrame:
    """Floor and slope of L = cr + cc of each session and model, after a warm-up of min(3, n div 5) calls.

    The floor is the least L of the next ten calls at most; slopes that aren't positive are left out.
    """
    own = Window.partitionBy("session_id", "model")
    rows = usage.select("session_id", "model", "ord", (F.col("cr") + F.col("cc")).alias("l")).withColumn("i", F.row_number().over(own.orderBy("ord")) - 1).withColumn("n", F.count("*").over(own))
    warm = F.least(F.lit(3), F.floor(F.col("n") / 5))
    rows = rows.where((F.col("n") >= least) & (F.col("i") >= warm)).withColumn("first", F.col("i") < warm + 10)
    fits = rows.groupBy("session_id", "model").agg(F.max("n").alias("n"), F.min(F.when(F.col("first"), F.col("l"))).alias("floor"), F.count("*").alias("n_fit"), F.regr_slope("l", "i").alias("slope"), F.max("l").alias("l_max"))
    return fits.where("n_fit >= 3 AND slope > 0")


def order_statistics(values: Column) -> dict[str, Column]:
    """Upper median and quartiles as elements of the sorted values, not interpolated. For bounded groups."""
    s = F.sort_array(F.collect_list(values))
    at = lambda k: F.try_element_at(s, (F.floor(F.size(s) * k / 4) + 1).cast("int"))
    return {"p25": at(1), "median": at(2), "p75": at(3)}


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """Rows (by, v) with i, the rank of v from 0, and n, within each group, whatever the group's size.

    Values are sorted by ranges: a rank is a place within its range and the number of values in the ranges before, so only the sizes of
    ranges meet in one place.
    """
    from stockline.sources.shared import cut_lineage

    placed = cut_lineage(rows.repartitionByRange(*by, "v").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy(*by, "part").agg(F.count("*").alias("size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*by, "part", before.alias("before"), F.sum("size").over(group).alias("n"))
    local = F.row_number().over(Window.partitionBy(*by, "part").orderBy("v")) - 1
    # one row for each range and group
    return placed.withColumn("i", local).join(sizes, [*by, "part"]).withColumn("i", F.col("i") + F.col("before")).drop("part", "before")


def order_stats(df: DataFrame, columns: dict[str, float], *by: str) -> DataFrame:
    """p25, median, p75 and mean of columns below their cuts, by rank: no group is collected or sorted in one task."""
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("v"), (F.col(name) < cut).alias("below")) for name, cut in columns.items()])).alias("x")
    rows = df.select(*by, one).where("x.below").select(*by, "x.measure", "x.v")
    pick = lambda k: F.max(F.when(F.col("i") == F.floor(F.col("n") * k / 4), F.col("v")))
    return ranked(rows, *by, "measure").groupBy(*by, "measure").agg(F.max("n").alias("n"), pick(1).alias("p25"), pick(2).alias("median"), pick(3).alias("p75"), F.avg("v").alias("mean"))


def break_even_shares(fits: DataFrame) -> DataFrame:
    """Sessions beyond their break-even and their position k = n / n*, by model and over all."""
    r = c_ratio_for(F.col("model"))
    rows = fits.withColumn("h", E.break_even(r, F.col("floor"), F.col("slope"))).withColumn("n_star", E.order_quantity(r, F.col("floor"), F.col("slope"))).withColumn("k", F.col("n") / F.col("n_star"))
    return rows.rollup("model").agg(F.count("*").alias("n_sessions"), F.count_if(F.col("n") > F.col("h")).alias("n_beyond"), F.count_if(F.col("k") > 3).alias("n_tail"), F.avg("k").alias("mean_k"), F.avg("h").alias("mean_h"))


def linearity(calls: DataFrame, least: int = 15) -> DataFrame:
    """Slope and R2 of L against the call number of each long segment with at least eight growing calls."""
    rows = calls.withColumn("t", F.row_number().over(by_segment()))
    return rows.groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.count_if(F.col("delta_l") > 0).alias("n_up"), F.regr_slope("l", "t").alias("slope"), F.regr_r2("l", "t").alias("r2")).where((F.col("n") >= least) & (F.col("n_up") >= 8))


def linearity_summary(fits: DataFrame) -> DataFrame:
    return fits.agg(F.count("*").alias("n_segments"), (F.sum(F.col("r2") * F.col("n")) / F.sum("n")).alias("weighted_r2"), F.percentile("r2", 0.1).alias("p10"), F.median("r2").alias("median"), F.percentile("r2", 0.9).alias("p90"))


def knee(calls: DataFrame) -> DataFrame:
    """First call of each segment whose next four growths are all below the median growth of its later half."""
    rows = calls.withColumn("i", F.row_number().over(by_segment())).withColumn("n", F.count("*").over(Window.partitionBy(*SEGMENT)))
    usual = rows.where(F.col("i") > F.col("n") / 2).groupBy(*SEGMENT).agg(F.median("delta_l").alias("usual"))
    ahead = by_segment().rowsBetween(1, 4)
    rows = rows.withColumn("_max", F.max("delta_l").over(ahead)).withColumn("_n", F.count("delta_l").over(ahead)).join(usual, SEGMENT)
    return rows.where((F.col("_n") == 4) & (F.col("_max") < F.col("usual"))).groupBy(*SEGMENT).agg(F.min("i").alias("knee"), F.max("usual").alias("usual"))


def fold_jumps(calls: DataFrame, n: float = 8, confirm: int = 3) -> DataFrame:
    """Calls where L leaves the line of growth by more than n usual steps and stays above for ``confirm`` calls; the line is
    then latched anew. Less its usual growth L is a level; a call jumps from a base if its level and the next ones are all n usual steps higher,
    so the next base is above all levels before it (``latch.fires``)."""
    rows = calls.select(*SEGMENT, "ord", F.col("l").cast("double").alias("l")).withColumn("i", F.row_number().over(by_segment()))
    rows = rows.withColumn("_step", F.col("l") - F.lag("l").over(by_segment()))
    usual = rows.where("_step > 0").groupBy(*SEGMENT).agg(F.median("_step").alias("k_stable"))
    ahead = by_segment().rowsBetween(0, confirm - 1)
    rows = cut_lineage(rows.join(usual, SEGMENT).withColumn("level", F.col("l") - F.col("k_stable") * F.col("i")))
    rows = rows.withColumn("reach", F.when(F.count("*").over(ahead) == confirm, F.min("level").over(ahead))).withColumn("need", F.col("level") + n * F.col("k_stable"))
    first = rows.where("i = 1").select(*SEGMENT, F.col("level").alias("first"), "need")
    found = latch.fires(rows.select(*SEGMENT, "ord", "need", "reach"), tuple(SEGMENT), first, strict=True)
    jumps = rows.join(found, [*SEGMENT, "ord"]).join(first.drop("need"), SEGMENT)
    base = F.coalesce(F.lag("level").over(by_segment()), F.col("first"))
    return jumps.select(*SEGMENT, "ord", (F.col("level") - base).alias("size"), "k_stable")


def plateaus(calls: DataFrame, jumps: DataFrame, min_len: int = 20) -> DataFrame:
    """Stretches between jumps of at least min_len calls, with slope and R2."""
    marks = jumps.select("session_id", "segment", "ord", F.lit(1).alias("_jump"))
    rows = calls.join(marks, ["session_id", "segment", "ord"], "left").withColumn("plateau", F.sum(F.coalesce("_jump", F.lit(0))).over(by_segment().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("t", F.row_number().over(by_segment()))
    return rows.groupBy(*SEGMENT, "plateau").agg(F.count("*").alias("n"), F.regr_slope("l", "t").alias("slope"), F.regr_r2("l", "t").alias("r2")).where(F.col("n") >= min_len)


DELTA_BINS = (0, 0.5, 1, 2, 4, 8, 15, 20)


def _relative_deltas(calls: DataFrame) -> DataFrame:
    usual = calls.where("delta_l > 0").groupBy(*SEGMENT).agg(F.median("delta_l").alias("k"))
    return calls.where("delta_l > 0").join(usual, SEGMENT).select((F.col("delta_l") / F.col("k")).alias("v"))


def delta_histogram(calls: DataFrame) -> DataFrame:
    """Growth of L in usual steps: number and share of each bin."""
    rows = _relative_deltas(calls).withColumn("bin", sum((F.col("v") >= b).cast("int") for b in DELTA_BINS))
    sums = rows.groupBy("bin").agg(F.count("*").alias("n"))
    return sums.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def delta_quantiles(calls: DataFrame) -> DataFrame:
    """Interpolated quantiles of the growth in usual steps, by rank, and the share beyond 8."""
    rows = ranked(_relative_deltas(calls))

    def at(p: int) -> Column:
        place = (F.col("n") - 1) * p / 100
        low = F.max(F.when(F.col("i") == F.floor(place), F.col("v")))
        high = F.max(F.when(F.col("i") == F.ceil(place), F.col("v")))
        part = F.max(place - F.floor(place))
        return (low + (high - low) * part).alias(f"p{p}")

    return rows.agg(F.count("*").alias("n"), *map(at, (50, 95, 99)), F.avg((F.col("v") > 8).cast("double")).alias("beyond_8"))


def ljung_box(calls: DataFrame, lags: int = 10, column: str = "g") -> DataFrame:
    """Q statistic of each segment from its autocorrelations."""
    mean = F.avg(column).over(Window.partitionBy(*SEGMENT))
    rows = calls.withColumn("_z", F.col(column) - mean)
    products = [F.sum(F.col("_z") * F.col(f"_z{k}")).alias(f"c{k}") for k in range(1, lags + 1)]
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"_z{k}", F.lag("_z", k).over(by_segment()))
    sums = rows.groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("c0"), *products).where((F.col("n") > lags + 2) & (F.col("c0") > 0))
    q = sum((F.col(f"c{k}") / F.col("c0")) * (F.col(f"c{k}") / F.col("c0")) / (F.col("n") - k) for k in range(1, lags + 1))
    return sums.select(*SEGMENT, "n", (F.col("n") * (F.col("n") + 2) * q).alias("q"))


def unit_root(calls: DataFrame, column: str = "l", least: int = 15) -> DataFrame:
    """Dickey-Fuller t statistic of each segment: the change regressed on the level."""
    y = F.col(column).cast("double")
    rows = calls.select(*SEGMENT, F.lag(y).over(by_segment()).alias("x"), (y - F.lag(y).over(by_segment())).alias("d")).where("x IS NOT NULL")
    sums = rows.groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.regr_slope("d", "x").alias("b"), F.regr_sxx("d", "x").alias("sxx"), F.regr_syy("d", "x").alias("syy")).where((F.col("n") >= least) & (F.col("sxx") > 0))
    error = F.sqrt((F.col("syy") - F.col("b") * F.col("b") * F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    return sums.select(*SEGMENT, "n", F.when(error > 0, F.col("b") / error).alias("t"), F.when(error > 0, F.col("b") / error < -2.86).alias("rejects"))


def lagged_unit_root(calls: DataFrame, column: str = "l", least: int = 15) -> DataFrame:
    """Augmented Dickey-Fuller t statistic of each segment: the change regressed on the level and on the change before.

    Two regressors have normal equations in closed form, so one grouping of covariances gives all segments. Null where they are collinear.
    """
    y = F.col(column).cast("double")
    rows = calls.select(*SEGMENT, "ord", F.lag(y).over(by_segment()).alias("x"), (y - F.lag(y).over(by_segment())).alias("d"))
    rows = rows.withColumn("z", F.lag("d").over(by_segment())).where("z IS NOT NULL")
    pair = lambda a, b: (F.covar_pop(a, b) * F.count("*")).alias(a + b)
    s = rows.groupBy(*SEGMENT).agg(F.count("*").alias("n"), *[pair(a, b) for a, b in ("xx", "zz", "xz", "xd", "zd", "dd")]).where(F.col("n") >= least)
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    s = s.withColumn("det", det).where(F.col("det") > 1e-9 * F.col("xx") * F.col("zz"))
    s = s.withColumn("b", (F.col("xd") * F.col("zz") - F.col("zd") * F.col("xz")) / F.col("det")).withColumn("c", (F.col("zd") * F.col("xx") - F.col("xd") * F.col("xz")) / F.col("det"))
    rest = F.col("dd") - F.col("b") * F.col("xd") - F.col("c") * F.col("zd")
    s = s.withColumn("e", F.when(rest > 1e-9 * F.col("dd"), F.sqrt(rest / (F.col("n") - 3) * F.col("zz") / F.col("det"))))
    return s.select(*SEGMENT, "n", (F.col("b") / F.col("e")).alias("t"), (F.col("b") / F.col("e") < -2.86).alias("rejects"))


#: 95 % point of chi-squared with ten degrees of freedom (fixed value).
CHI2_10 = 18.307


def stationarity(calls: DataFrame) -> DataFrame:
    """Segments and the share of them that reject a unit root in L and in g, and that have autocorrelated g by Ljung and Box."""
    share = lambda c: F.avg(c.cast("double"))
    tests = {"l": (lagged_unit_root(calls, "l"), F.col("rejects")), "g": (lagged_unit_root(calls, "g"), F.col("rejects")), "q": (ljung_box(calls), F.col("q") > CHI2_10)}
    found = None
    for name, (rows, hit) in tests.items():
        one = rows.agg(F.count(hit).alias("n"), share(hit).alias("share")).select(F.lit(name).alias("test"), "n", "share")
        found = one if found is None else found.unionByName(one)
    return found


def permutation_r2(calls: DataFrame, seed: int = 1) -> DataFrame:
    """R2 of each segment when its growths come in another order, drawn by a hash of seed and call."""
    dice = F.xxhash64(F.lit(seed), *[F.col(c) for c in ("session_id", "segment", "ord")])
    shuffled = Window.partitionBy(*SEGMENT).orderBy(dice, "ord")
    rows = calls.where("delta_l IS NOT NULL").withColumn("t", F.row_number().over(shuffled)).withColumn("y", F.sum("delta_l").over(shuffled.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.regr_r2("y", "t").alias("r2")).where("n >= 15")


def bootstrap_recovery(days: DataFrame, n: int = 10_000, seed: int = 1) -> DataFrame:
    """95 % intervals of the median and of the ratio of sums over n resamples of the days.

    Each of a resample's draws picks a day by a hash; resamples are rows, so they run in parallel.
    """
    numbered = days.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("day")).alias("i"), "usd_ratio", "usd_recon", "usd_bill")
    size = numbered.agg(F.max("i").alias("size"))
    draws = days.sparkSession.range(n).select(F.col("id").alias("resample")).join(F.broadcast(size)).select("resample", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("draw"))
    draws = draws.select("resample", (F.pmod(F.xxhash64(F.lit(seed), F.col("resample"), F.col("draw")), F.col("size")) + 1).cast("int").alias("i"))
    each = draws.join(numbered, "i").groupBy("resample").agg(F.median("usd_ratio").alias("median"), (F.sum("usd_recon") / F.sum("usd_bill")).alias("aggregate"))
    bounds = lambda c: [F.percentile(c, p).alias(f"{c}_{k}") for p, k in ((0.025, "low"), (0.975, "high"))]
    return each.agg(F.count("*").alias("n"), *bounds("median"), *bounds("aggregate"))


def session_summaries(calls: DataFrame, project: Column) -> DataFrame:
    first = F.min_by(F.struct("cr", "cc", "inp", "model"), "ord")
    return calls.groupBy("session_id", project.alias("project")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), first.alias("x")).select("session_id", "project", "first_ts", "last_ts", "x.*")


def cold_start_gaps(summaries: DataFrame, by: str = "project") -> DataFrame:
    """Seconds from the last activity of the session before in the same project to each session's start."""
    before = Window.partitionBy(by).orderBy("first_ts", "session_id")
    return summaries.withColumn("gap_s", F.unix_timestamp("first_ts") - F.unix_timestamp(F.lag("last_ts").over(before)))


GAP_BINS = ((300, "under 5 min"), (3600, "5 min to 1 h"), (86400, "1 h to 1 d"))


def cold_start_bins(gaps: DataFrame) -> DataFrame:
    """Starts by idle gap: number, share without a cache hit, mean hit share of the first call."""
    label = F.when(F.col("gap_s").isNull(), "first")
    for limit, name in GAP_BINS:
        label = label.when(F.col("gap_s") < limit, name)
    hit = F.try_divide("cr", F.col("cr") + F.col("cc") + F.col("inp"))
    return gaps.groupBy(label.otherwise("over 1 d").alias("gap")).agg(F.count("*").alias("n"), F.avg((F.col("cr") == 0).cast("double")).alias("zero_share"), F.avg(hit).alias("mean_hit"))


def p_cold(summaries: DataFrame) -> DataFrame:
    """Share of session starts whose first call reads nothing from the cache, by provider."""
    from stockline.functions.models import provider_of

    return summaries.groupBy(provider_of(F.col("model")).alias("provider")).agg(F.count("*").alias("n"), F.avg((F.col("cr") == 0).cast("double")).alias("p_cold"))


def p_ttl(dispatches: DataFrame, ttl_s: int = 300) -> DataFrame:
    """Share of dispatches (session_id, provider, idle_s) that outlast the cache, pooled and as a mean over sessions."""
    own = dispatches.groupBy("provider", "session_id").agg(F.count("*").alias("n"), F.count_if(F.col("idle_s") > ttl_s).alias("k"))
    return own.groupBy("provider").agg(F.sum("n").alias("n"), (F.sum("k") / F.sum("n")).alias("pooled"), F.avg(F.col("k") / F.col("n")).alias("per_session"))
