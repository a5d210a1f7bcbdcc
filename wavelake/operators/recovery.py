"""Flow metrics: baseline of a steady phase, loss during a switch and time to recover.

``features`` is (keys, window_idx, t_sec, six indicators); ``phases`` is one row for each key from ``intervals``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from . import series, spectral

PHASES = ["steady_start", "steady_end", "switch_start", "switch_end", "recovery_start"]


def intervals(events: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Named phases from event times, with fixed times for events that are missing; of equal events the last counts, by ``order`` or by time."""
    seq = F.col(order or "t_sec")
    at = lambda e: F.max_by(F.when(F.col("event_id") == e, F.col("t_sec")), F.when(F.col("event_id") == e, F.col("_seq")))
    e = events.withColumn("_seq", seq).groupBy(*keys).agg(*[at(x).alias(x) for x in ("F1", "F2", "X0", "X1", "R0")])
    or_ = lambda *c: F.coalesce(*[F.col(x) for x in c[:-1]], F.lit(c[-1]))
    return e.select(
        *keys, or_("F1", 300.0).alias("steady_start"), or_("F2", "X0", 540.0).alias("steady_end"), or_("X0", 540.0).alias("switch_start"),
        or_("X1", "R0", 660.0).alias("switch_end"), or_("R0", 660.0).alias("recovery_start"),
    )


def indicators(df: DataFrame, keys: list[str], smooth: int = 7) -> DataFrame:
    """Six indicators from relative band powers and spectral entropy by window, each smoothed first."""
    by = [*keys, "window_idx"]
    if smooth > 1:
        for c in ("theta", "alpha", "beta", "gamma", "entropy"):
            df = series.smooth(df, keys, "window_idx", c, smooth)
    alpha = F.col("alpha") + S.TINY
    return df.select(
        *by, (F.col("theta") / alpha).alias("theta_alpha_ratio"), F.col("alpha").alias("alpha_rel"), F.col("beta").alias("beta_rel"),
        F.col("gamma").alias("gamma_rel"), F.col("entropy").alias("eeg_entropy"), ((F.col("theta") + F.col("beta")) / alpha).alias("cog_load"),
    )


def features(samples: DataFrame, keys: list[str], fs: float, window_sec: float = 2.0, overlap: float = 0.5, smooth: int = 7) -> DataFrame:
    """Indicators of sliding windows; spectra are computed once and averaged over channels."""
    size = int(window_sec * fs)
    step = int(size * (1 - overlap))
    psd = spectral.densities(samples, [*keys, "channel_idx"], size, step, fs)
    psd = spectral.mean_density(psd, [*keys, "window_idx"])
    by = [*keys, "window_idx"]
    out = indicators(spectral.powers_and_entropy(psd, by), keys, smooth)
    return out.withColumn("t_sec", series.window_center(F.col("window_idx"), size, step, fs))


def long_form(feats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window_idx, t_sec, indicator, x)"""
    return feats.unpivot([*keys, "window_idx", "t_sec"], S.FEATURES, "indicator", "x")


def baseline(long: DataFrame, phases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, indicator, base): mean in the steady phase, 0 if no window is in it.

    Windows are added up in their order, so the last bit of the mean does not depend on how the rows come; a window at the very edge
    of the tolerance would be in or out by it.
    """
    by = [*keys, "indicator"]
    steady = F.when(F.col("t_sec").between(F.col("steady_start"), F.col("steady_end")), F.col("x"))
    j = long.join(phases, keys).select(*by, "window_idx", steady.alias("x"))
    j = j.withColumn("total", F.sum("x").over(series.over(by, "window_idx", W.unboundedPreceding, 0)))
    return j.groupBy(*by).agg(F.coalesce(F.max_by("total", "window_idx") / F.count("x"), F.lit(0.0)).alias("base"))


def recovery(long: DataFrame, phases: DataFrame, base: DataFrame, keys: list[str], tolerance: float = 0.05, hold_sec: float = 30.0) -> DataFrame:
    """(keys, indicator, recovery_sec): end of the first stretch of ``hold_sec`` within the tolerance of the baseline, from the first
    window at or after the start of recovery; null if there is none.

    Window rates may differ between keys, so the length of a stretch is a column; a stretch is found as an island of good windows.
    """
    by = [*keys, "indicator"]
    j = long.join(phases, keys).join(base, by)
    rate = series.difference(long, by, "window_idx", "t_sec", "dt").groupBy(*by).agg(F.percentile("dt", F.lit(0.5)).alias("dt"))
    j = j.join(rate, by).withColumn("fs", F.coalesce(F.lit(1.0) / F.col("dt"), F.lit(1.0))).where(F.col("t_sec") >= F.col("recovery_start"))
    j = j.withColumn("k", F.floor(F.lit(hold_sec) * F.col("fs") + 1e-9))
    lo, hi = (float(1 + s * Decimal(str(tolerance))) for s in (-1, 1))  # 0.1 of a tolerance of 0.9, where 1 - 0.9 is less by a bit
    good = (F.col("x") >= F.col("base") * lo) & (F.col("x") <= F.col("base") * hi)
    w = series.over(by, "window_idx")
    j = j.withColumn("pos", F.row_number().over(w) - 1).withColumn("good", good)
    j = j.withColumn("island", F.col("pos") - F.row_number().over(series.over([*by, "good"], "window_idx")))
    runs = j.where("good").groupBy(*by, "island").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), F.first("k").alias("k"), F.first("fs").alias("fs"))
    first = runs.where(F.col("n") >= F.col("k")).groupBy(*by).agg(F.min((F.col("pos") + F.col("k")) / F.col("fs")).alias("recovery_sec"))
    return base.select(*by).join(first, by, "left")


def attenuation(long: DataFrame, phases: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, indicator, attenuation): percent lost (flow) or gained (loss, at most 300) at the worst window of the switch."""
    by = [*keys, "indicator"]
    j = long.join(phases, keys).where(F.col("t_sec").between(F.col("switch_start"), F.col("switch_end")))
    ext = j.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    b = base.join(ext, by, "left")
    flow = F.col("indicator").isin(S.FLOW_INDICATORS)
    value = F.when(flow, (F.col("base") - F.col("low")) / (F.col("base") + S.TINY) * 100).otherwise(F.least((F.col("high") - F.col("base")) / (F.col("base") + S.TINY) * 100, F.lit(300.0)))
    return b.select(*by, F.coalesce(value, F.lit(0.0)).alias("attenuation"))


def overall(rec: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, recovery_time, n_unrecovered): the slowest indicator of those that recover."""
    return rec.groupBy(*keys).agg(F.max("recovery_sec").alias("recovery_time"), F.count_if(F.col("recovery_sec").isNull()).alias("n_unrecovered"))


def normalised(long: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Indicators over their baseline, as they are where the baseline is not positive."""
    j = long.join(base, [*keys, "indicator"])
    return j.withColumn("x", F.when(F.col("base") > 0, F.col("x") / F.col("base")).otherwise(F.col("x"))).drop("base")
