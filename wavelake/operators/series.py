"""Order-dependent operators over one series for each key: windows, runs, segments, filters with few taps, interpolation.

``keys`` name the series (recording, channel ...), ``at`` its whole-number order.  Everything is a window over (keys, at) or an
aggregate, so a chain of these operators on the same keys shares one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

Keys = list[str]


def over(keys: Keys, at: str, *frame: int):
    w = W.partitionBy(*keys).orderBy(at)
    return w.rowsBetween(*frame) if frame else w


def whole(keys: Keys):
    return W.partitionBy(*keys)


def smooth(df: DataFrame, keys: Keys, at: str, value: str, k: int, out: str | None = None) -> DataFrame:
    """Moving mean of k points with zeros beyond the ends and the divisor k throughout, so ends are damped."""
    return df.withColumn(out or value, F.sum(value).over(over(keys, at, -(k // 2), (k - 1) // 2)) / F.lit(float(k)))


def first_run(df: DataFrame, keys: Keys, at: str, good: Column, k: int) -> DataFrame:
    """(keys, run_start): the first position (0-based, in order) from which ``good`` holds k times in a row; null if none."""
    ok = F.when(good, 1).otherwise(0)
    w = over(keys, at, 0, k - 1)
    runs = df.select(*keys, (F.row_number().over(over(keys, at)) - 1).cast("long").alias("pos"), F.sum(ok).over(w).alias("hits"), F.count(F.lit(1)).over(w).alias("seen"))
    return runs.groupBy(*keys).agg(F.min(F.when((F.col("hits") == k) & (F.col("seen") == k), F.col("pos"))).alias("run_start"))


def segments(df: DataFrame, keys: Keys, at: str, mask: Column, most: int = 300) -> DataFrame:
    """(keys, start, end, n_segments, truncated): runs of the mask with exclusive end; the first ``most`` of each key."""
    marked = df.select(*keys, at, mask.alias("m"), (F.col(at) - F.row_number().over(W.partitionBy(*keys, mask).orderBy(at))).alias("island"))
    runs = marked.where("m").groupBy(*keys, "island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"))
    runs = runs.withColumn("n_segments", F.count(F.lit(1)).over(whole(keys))).withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("start")))
    return runs.where(F.col("nth") <= most).select(*keys, "start", "end", "n_segments", (F.col("n_segments") > most).alias("truncated"))


def dilate(df: DataFrame, keys: Keys, at: str, mask: str, reach: int = 1) -> DataFrame:
    return df.withColumn(mask, F.max(F.col(mask)).over(over(keys, at, -reach, reach)))


def difference(df: DataFrame, keys: Keys, at: str, value: str, out: str = "diff") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(over(keys, at)))


def mean_positive_step(df: DataFrame, keys: Keys, at: str, t: str) -> DataFrame:
    """(keys, fs): rate from the mean of the positive time steps, 250 if there is none."""
    d = difference(df, keys, at, t, "dt").groupBy(*keys).agg(F.avg(F.when(F.col("dt") > 0, F.col("dt"))).alias("dt"))
    return d.select(*keys, F.coalesce(F.rint(F.lit(1.0) / F.col("dt")), F.lit(250.0)).cast("long").alias("fs"))


def rate_from_median_step(df: DataFrame, keys: Keys, at: str, t: str) -> DataFrame:
    d = difference(df, keys, at, t, "dt").groupBy(*keys).agg(F.percentile("dt", F.lit(0.5)).alias("dt"))
    return d.select(*keys, F.when(F.col("dt") > 0, F.rint(F.lit(1.0) / F.col("dt"))).cast("long").alias("fs"))


def lost_packets(df: DataFrame, keys: Keys, at: str, number: str, modulus: int = 256) -> DataFrame:
    """(keys, lost): gaps of a package counter that starts again at ``modulus``, over all neighbours."""
    gap = F.pmod(F.col(number) - F.lag(number).over(over(keys, at)) - 1, F.lit(modulus))
    return df.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("lost"))


def hysteresis(df: DataFrame, keys: Keys, at: str, enter: Column, leave: Column, out: str = "state") -> DataFrame:
    """State idle / entered / exited: ``enter`` and ``leave`` switch it, anything between holds it."""
    signal = F.when(enter, F.lit("entered")).when(leave, F.lit("exited"))
    return df.withColumn(out, F.coalesce(F.last(signal, ignorenulls=True).over(over(keys, at, W.unboundedPreceding, 0)), F.lit("idle")))


def interpolate(df: DataFrame, keys: Keys, at: str, value: str, bad: Column, out: str | None = None) -> DataFrame:
    """Bad points from the line between their good neighbours, beyond the ends the nearest one; unchanged if none is good."""
    v = F.when(~bad, F.col(value))
    i = F.when(~bad, F.col(at))
    before = over(keys, at, W.unboundedPreceding, 0)
    # the next good point is the last one seen from behind: a frame that grows by a row at a time, where one that ends with the series is read anew for every row
    after = W.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_v0", F.last(v, True).over(before)).withColumn("_i0", F.last(i, True).over(before))
    df = df.withColumn("_v1", F.last(v, True).over(after)).withColumn("_i1", F.last(i, True).over(after))
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(at) - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))
    made = F.when(~bad, F.col(value)).when(F.col("_v0").isNull() & F.col("_v1").isNull(), F.col(value))
    made = made.when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(line)
    return df.withColumn(out or value, made).drop("_v0", "_v1", "_i0", "_i1")


def remove_mean(df: DataFrame, keys: Keys, value: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or value, F.col(value) - F.avg(value).over(whole(keys)))


def z_score(df: DataFrame, keys: Keys, value: str, out: str = "z", tiny: float = 1e-12) -> DataFrame:
    w = whole(keys)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + F.lit(tiny)))


def sliding(df: DataFrame, keys: Keys, at: str, size: int, step: int) -> DataFrame:
    """``df`` once for every window it is in: window_idx, and in_idx (place in the window).  Only whole windows of a key count."""
    n = F.floor((F.max(at).over(whole(keys)) + 1 - size) / F.lit(step)) + 1
    low = F.greatest(F.ceil((F.col(at) - size + 1) / F.lit(step)), F.lit(0))
    high = F.least(F.floor(F.col(at) / F.lit(step)), n - 1)
    out = df.withColumn("_lo", low.cast("long")).withColumn("_hi", high.cast("long")).where("_lo <= _hi")
    return out.withColumn("window_idx", F.explode(F.sequence("_lo", "_hi"))).withColumn("in_idx", F.col(at) - F.col("window_idx") * step).drop("_lo", "_hi")


def window_center(window_idx: Column, size: int, step: int, fs: float) -> Column:
    return window_idx * F.lit(step / fs) + F.lit(size / fs / 2)


def tumbling(df: DataFrame, keys: Keys, at: str, size: int, partial: bool = False) -> DataFrame:
    """chunk_idx by whole-number division; a last chunk that is not full stays only if asked for."""
    out = df.withColumn("chunk_idx", F.expr(f"{at} div {size}"))
    if partial:
        return out
    return out.withColumn("_n", F.floor((F.max(at).over(whole(keys)) + 1) / F.lit(size))).where(F.col("chunk_idx") < F.col("_n")).drop("_n")


def every_nth(df: DataFrame, keys: Keys, at: str, target: int, rounding: str = "ceil") -> DataFrame:
    """Stride decimation to about ``target`` points; 'ceil' strides give at most that many, 'floor' strides at least."""
    n = (F.max(at).over(whole(keys)) + 1) / F.lit(target)
    step = F.greatest((F.ceil(n) if rounding == "ceil" else F.floor(n)).cast("long"), F.lit(1))
    return df.withColumn("_step", step).where(F.col(at) % F.col("_step") == 0).drop("_step")


def even_places(df: DataFrame, at: str, n: int, m: int) -> DataFrame:
    """Rows at the m truncated places of an even grid over 0 .. n-1 (all, if there are no more)."""
    if n <= m:
        return df
    grid = df.sparkSession.range(m).select(F.floor(F.col("id") * F.lit((n - 1) / (m - 1)) + F.lit(1e-9)).cast("long").alias("_place"))
    return df.join(F.broadcast(grid.distinct()), F.col(at) == F.col("_place")).drop("_place")  # m rows


# Decomposition filters (high-pass) of the wavelets.
HAAR = [0.7071067811865475, -0.7071067811865475]
DB4 = [-0.2303778133088965, 0.7148465705529154, -0.6308807679294803, -0.02798376941685985, 0.187034811717913, 0.03084138183556054, -0.0328830116668852, -0.01059740178506903]


def wavelet_detail(df: DataFrame, keys: Keys, at: str, value: str, taps: list[float] = DB4) -> DataFrame:
    """(keys, detail_idx, detail): first-level detail: full convolution with zeros around, odd points kept."""
    k = len(taps)
    n = F.max(at).over(whole(keys))
    # the last point brings the zeros behind it (a union of two parts of one shuffle can lose its partitioning)
    tail = F.when(F.col(at) == F.col("_n"), F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = df.select(*keys, at, value, n.alias("_n")).withColumn("_o", F.explode(tail))
    rows = rows.select(*keys, (F.col(at) + F.col("_o")).alias(at), F.when(F.col("_o") == 0, F.col(value)).otherwise(0.0).alias(value))
    w = over(keys, at)
    conv = F.coalesce(F.col(value), F.lit(0.0)) * F.lit(taps[0])
    for j in range(1, k):
        conv = conv + F.coalesce(F.lag(value, j).over(w), F.lit(0.0)) * F.lit(taps[j])
    rows = rows.withColumn("detail", conv)
    return rows.where(F.col(at) % 2 == 1).select(*keys, F.expr(f"{at} div 2").alias("detail_idx"), "detail")


def robust_z(df: DataFrame, keys: Keys, value: str, out: str = "z") -> DataFrame:
    """Distance to the median over 1.4826 times the median absolute deviation; medians are exact."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_med"))
    df = df.join(med, keys)
    mad = df.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("_med")), F.lit(0.5)).alias("_mad"))
    return df.join(mad, keys).withColumn(out, F.abs(F.col(value) - F.col("_med")) / (F.col("_mad") * 1.4826 + 1e-12)).drop("_med", "_mad")


def quadratic_smooth(df: DataFrame, keys: Keys, at: str, value: str, out: str = "smoothed") -> DataFrame:
    """Least-squares parabola over five points; the two points at each end come from the parabola of the first or last five.

    Series of fewer than five points are left as they are.
    """
    w, n = over(keys, at), F.count(F.lit(1)).over(whole(keys))
    i = F.row_number().over(w) - 1
    lag = lambda k: F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w)

    def fit(place: int, shift: int):
        # value of the parabola through points 0..4 at ``place``; ``shift``: place of this row in the five
        weights = {0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5), 2: (-3, 12, 17, 12, -3), 3: (-5, 6, 12, 13, 9), 4: (3, -5, -3, 9, 31)}[place]
        return sum((F.lit(float(c)) * lag(shift - j) for j, c in enumerate(weights)), F.lit(0.0)) / 35.0

    made = F.when(n < 5, F.col(value)).when(i == 0, fit(0, 0)).when(i == 1, fit(1, 1)).when(i == n - 1, fit(4, 4)).when(i == n - 2, fit(3, 3)).otherwise(fit(2, 2))
    return df.withColumn(out, made)


def peak(df: DataFrame, keys: Keys, at: str, value: str, sign: Column) -> DataFrame:
    """(keys, amplitude, peak_idx, significance): the largest strict local extremum of sign * value, else the largest value."""
    w = over(keys, at)
    s = F.col(value) * sign
    local = (s > F.lag(value).over(w) * sign) & (s > F.lead(value).over(w) * sign)
    rows = df.select(*keys, at, value, s.alias("_s"), F.coalesce(local, F.lit(False)).alias("_l"))
    best = F.max(F.struct("_l", "_s", (-F.col(at)).alias("_i"), F.col(value).alias("_v")))
    got = rows.groupBy(*keys).agg(best.alias("_b"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_d"))
    return got.select(*keys, F.col("_b._v").alias("amplitude"), (-F.col("_b._i")).alias("peak_idx"), ((F.col("_b._v") - F.col("_m")) / (F.col("_d") + 1e-12)).alias("significance"))


def as_of(left: DataFrame, right: DataFrame, keys: Keys, t: str, payload: list[str]) -> DataFrame:
    """For each row of ``left`` the last row of ``right`` at or before its time: one sorted union, no range join."""
    names = [c for c in left.columns if c not in keys + [t]]
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*keys, t, F.struct(*payload).alias("_p")).withColumn("_side", F.lit(0))
    # an exchange of its own: the union of two parts that are already dealt out by the keys must not pass for dealt out itself
    both = a.unionByName(b, allowMissingColumns=True).repartition(*keys)
    w = W.partitionBy(*keys).orderBy(t, "_side").rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_p", F.last("_p", True).over(w)).where("_side = 1")
    return out.select(*keys, t, *names, *[F.col("_p")[p].alias(p) for p in payload])
