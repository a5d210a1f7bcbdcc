"""Artifact masks, signal statistics and the quality score of recordings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import series, spectral


def threshold_mask(samples: DataFrame, keys: list[str], limit: float = 100.0) -> DataFrame:
    """(keys, sample_idx, mask): any channel beyond the limit."""
    return samples.groupBy(*keys, "sample_idx").agg(F.bool_or(F.abs("value") > limit).alias("mask"))


def z_mask(samples: DataFrame, keys: list[str], limit: float = 3.0) -> DataFrame:
    """(keys, sample_idx, mask): any channel more than ``limit`` deviations from its mean."""
    by = [*keys, "channel_idx"]
    stats = samples.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = samples.join(stats, by)  # one row for each channel
    return z.groupBy(*keys, "sample_idx").agg(F.bool_or(F.abs((F.col("value") - F.col("_m")) / (F.col("_s") + S.TINY)) > limit).alias("mask"))


def wavelet_mask(samples: DataFrame, keys: list[str], limit: float = 3.0, taps: list[float] = series.DB4) -> DataFrame:
    """(keys, sample_idx, mask): near first-level details that are robust outliers of their channel."""
    by = [*keys, "channel_idx"]
    z = series.robust_z(series.wavelet_detail(samples, by, "sample_idx", "value", taps), by, "detail")
    hit = z.where(F.col("z") > limit).select(*keys, F.explode(F.array(*[2 * F.col("detail_idx") + k for k in (0, 1, 2)])).alias("sample_idx")).distinct()
    grid = samples.select(*keys, "sample_idx").distinct()
    return grid.join(hit.withColumn("mask", F.lit(True)), [*keys, "sample_idx"], "left").na.fill(False, ["mask"])


def mask_ratio(mask: DataFrame, keys: list[str]) -> DataFrame:
    return mask.groupBy(*keys).agg(F.avg(F.col("mask").cast("double")).alias("artifact_ratio"))


def channel_artifact_ratio(samples: DataFrame, keys: list[str], limit: float = 100.0) -> DataFrame:
    """Mean over channels of the share of samples beyond the limit."""
    per = samples.groupBy(*keys, "channel_idx").agg(F.avg((F.abs("value") > limit).cast("double")).alias("r"))
    return per.groupBy(*keys).agg(F.avg("r").alias("artifact_ratio"))


def repair(samples: DataFrame, keys: list[str], limit: float = 100.0) -> DataFrame:
    """Samples beyond the limit replaced by interpolation within their channel."""
    return series.interpolate(samples, [*keys, "channel_idx"], "sample_idx", "value", F.abs("value") > limit)


def signal_stats(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, channel_idx, peak, rms, variance, kurtosis, skewness): population forms, excess kurtosis."""
    v = F.col("value")
    return samples.groupBy(*keys, "channel_idx").agg(
        F.max(F.abs(v)).alias("peak"), F.sqrt(F.avg(v * v)).alias("rms"), F.var_pop(v).alias("variance"), F.kurtosis(v).alias("kurtosis"), F.skewness(v).alias("skewness")
    )


def snr_db(psd: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, snr_db): power of 1 to 45 Hz over that above."""
    f, p = F.col("freq"), F.col("power")
    s, n = F.sum(F.when((f >= 1) & (f <= 45), p).otherwise(0.0)), F.sum(F.when(f > 45, p).otherwise(0.0)) + S.TINY
    return psd.groupBy(*keys).agg((10 * F.log10(s / n + S.TINY)).alias("snr_db"))


def agreement(masks: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, consistency): mean Jaccard similarity of every two masks, 1 for two empty ones."""
    wide = masks[0].withColumnRenamed("mask", "m0")
    for k, m in enumerate(masks[1:], 1):
        wide = wide.join(m.withColumnRenamed("mask", f"m{k}"), [*keys, "sample_idx"])
    pairs = [(i, j) for i in range(len(masks)) for j in range(i + 1, len(masks))]
    cols = []
    for i, j in pairs:
        both, either = F.count_if(F.col(f"m{i}") & F.col(f"m{j}")), F.count_if(F.col(f"m{i}") | F.col(f"m{j}"))
        cols.append(F.when(either == 0, 1.0).otherwise(F.try_divide(both, either)))
    return wide.groupBy(*keys).agg((sum(cols, F.lit(0.0)) / len(pairs)).alias("consistency"))


def stability(samples: DataFrame, keys: list[str], fs: int) -> DataFrame:
    """(keys, cv): variation of the RMS of whole seconds over all channels; null with fewer than two seconds."""
    sec = series.tumbling(samples, [*keys, "channel_idx"], "sample_idx", max(fs, 1))
    rms = sec.groupBy(*keys, "channel_idx", "chunk_idx").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("r"))
    got = rms.groupBy(*keys).agg(F.stddev_pop("r").alias("sd"), F.avg(F.abs("r")).alias("m"), F.max("chunk_idx").alias("last"))
    return got.select(*keys, F.when(F.col("last") > 0, F.col("sd") / (F.col("m") + S.TINY)).alias("cv"))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("D")


def quality(samples: DataFrame, keys: list[str], fs: int, nperseg: int = 1024) -> DataFrame:
    """(keys, factors ..., score, grade): weighted factors 0.25, 0.20, 0.20, 0.15, 0.10, 0.10."""
    by = [*keys, "channel_idx"]
    psd = spectral.densities(samples, by, nperseg, nperseg // 2, fs).groupBy(*by, "bin", "freq").agg(F.avg("power").alias("power"))
    mean = spectral.mean_density(psd, keys)
    f, p = F.col("freq"), F.col("power")
    part = lambda b: F.sum(F.when((f >= S.BANDS[b][0]) & (f <= S.BANDS[b][1]), p).otherwise(0.0)) / (F.sum(p) + S.TINY)
    ab = mean.groupBy(*keys).agg((part("alpha") + part("beta")).alias("alpha_beta_ratio"))
    snr = snr_db(psd, by).groupBy(*keys).agg(F.avg("snr_db").alias("snr_db"))
    crest = signal_stats(samples, keys).groupBy(*keys).agg(F.avg(F.col("peak") / (F.col("rms") + S.TINY)).alias("crest_factor"))
    thr = threshold_mask(samples, keys)
    masks = [thr, z_mask(samples, keys), wavelet_mask(samples, keys)]
    out = mask_ratio(thr, keys)
    for more in (snr, stability(samples, keys, fs), ab, agreement(masks, keys), crest):
        out = out.join(more, keys, "left")
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    r = F.col("alpha_beta_ratio")
    out = out.withColumns({
        "artifact_factor": F.greatest(1 - F.col("artifact_ratio") * 5, F.lit(0.0)),
        "snr_factor": unit(F.col("snr_db") / 20),
        "stability_factor": F.coalesce(unit(1 - F.col("cv")), F.lit(0.5)),
        "freq_factor": F.when(r.between(0.2, 0.6), 1.0).otherwise(F.greatest(1 - F.abs(r - 0.4) * 2, F.lit(0.0))),
        "signal_quality_factor": unit(1 - (F.col("crest_factor") - 4) / 10),
    })
    weights = {"artifact_factor": 0.25, "snr_factor": 0.2, "stability_factor": 0.2, "freq_factor": 0.15, "consistency": 0.1, "signal_quality_factor": 0.1}
    out = out.withColumn("score", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) * 100)
    return out.withColumn("grade", grade(F.col("score")))


def validation(samples: DataFrame, keys: list[str], fs: float | None, least_sec: float = 10.0, most_channels: int = 32) -> DataFrame:
    """(keys, valid, errors, warnings, n_samples, n_channels, duration_sec)."""
    v = F.col("value")
    inf = F.abs(v) == float("inf")
    got = samples.groupBy(*keys).agg(
        F.countDistinct("sample_idx").alias("n_samples"), F.countDistinct("channel_idx").alias("n_channels"), F.count_if(F.isnan(v)).alias("n_nan"),
        F.count_if(inf).alias("n_inf"), F.max(F.when(~F.isnan(v) & ~inf, F.abs(v))).alias("top"),
    )
    good_fs = fs is not None and fs > 0
    got = got.withColumn("duration_sec", F.col("n_samples") / F.lit(float(fs)) if good_fs else F.lit(0.0))
    clean = (F.col("n_nan") == 0) & (F.col("n_inf") == 0)
    errors = [F.when(F.lit(fs is not None and not good_fs), "bad rate"), F.when(F.col("n_nan") > 0, F.concat(F.col("n_nan").cast("string"), F.lit(" not a number"))), F.when(F.col("n_inf") > 0, F.concat(F.col("n_inf").cast("string"), F.lit(" infinite")))]
    warnings = [
        F.when(F.lit(fs is None), "no rate"), F.when(F.col("n_channels") > most_channels, "many channels"), F.when(F.lit(good_fs) & (F.col("duration_sec") < least_sec), "short"),
        F.when(clean & (F.col("top") > 1e4), "large amplitude"), F.when(clean & (F.col("top") < 1e-3), "small amplitude"),
    ]
    out = got.withColumn("errors", F.array_compact(F.array(*errors))).withColumn("warnings", F.array_compact(F.array(*warnings)))
    return out.select(*keys, (F.size("errors") == 0).alias("valid"), "errors", "warnings", "n_samples", "n_channels", "duration_sec")


# -- independent components of whole recordings ----------------------------------------------------------------------


def spatial(loading: DataFrame, keys: list[str]) -> DataFrame:
    """Spatial features of the loadings (keys, channel_idx, loading) of components."""
    x, c = F.abs("loading"), F.col("channel_idx")
    n = F.count(F.lit(1)).over(series.whole(keys))
    rows = loading.select(*keys, "channel_idx", x.alias("x"), n.alias("n"))
    half = F.greatest(F.floor(F.col("n") / 2), F.lit(1))
    g = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg(F.when(c < half, F.col("x"))).alias("front"), F.coalesce(F.avg(F.when(c >= half, F.col("x"))), F.lit(0.0)).alias("back"),
        F.avg(F.when(c % 2 == 0, F.col("x"))).alias("l"), F.avg(F.when(c % 2 == 1, F.col("x"))).alias("r"), F.max(F.struct("x", (-c).alias("c")))["c"].alias("top"),
        F.max("x").alias("most"), F.avg("x").alias("mean"),
    )
    return g.select(
        *keys, (F.col("front") / (F.col("back") + S.TINY)).alias("front_back_ratio"),
        F.when(F.col("n") >= 4, F.abs(F.col("l") - F.col("r")) / (F.col("l") + F.col("r") + S.TINY)).otherwise(0.0).alias("lr_asymmetry"),
        (-F.col("top")).alias("max_channel_index"), (F.col("most") / (F.col("mean") + S.TINY)).alias("concentration"),
    )


#: Values (samples times channels) of the largest recording that one task decomposes as a whole.
WHOLE_RECORDING = 1 << 20


def decompose(samples: DataFrame, keys: list[str], n: int | None = None, most: int = WHOLE_RECORDING) -> DataFrame:
    """(keys, component, sample_idx, source, loadings): independent components of each recording.

    A recording of up to ``most`` values is one group, a larger one goes by sums over its blocks (``components``).  One that can't be
    decomposed gives no rows.
    """
    from ..functions import kernels as K
    from . import components
    from .timefreq import _short_and_long

    def run(pdf):
        import pandas as pd

        wide = pdf.pivot(index="sample_idx", columns="channel_idx", values="value").sort_index()
        source, mixing = K.independent_components(wide.to_numpy(), n)
        out = []
        for k in range(source.shape[1]):
            part = pd.DataFrame({"component": k, "sample_idx": wide.index.to_numpy(), "source": source[:, k]})
            part["loadings"] = [mixing[k].tolist()] * len(part)
            out.append(part)
        made = pd.concat(out, ignore_index=True)
        for c in reversed(keys):
            made.insert(0, c, pdf[c].iloc[0])
        return made

    kind = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in keys)
    rows = samples.select(*keys, F.col("sample_idx").cast("long").alias("sample_idx"), F.col("channel_idx").cast("int").alias("channel_idx"), "value")
    short, long = _short_and_long(rows, keys, most)
    out = short.groupBy(*keys).applyInPandas(run, f"{kind}, component int, sample_idx long, source double, loadings array<double>")
    return out if long is None else out.unionByName(components.decompose_blocks(components.blocks_of(long, keys), keys, n))


def classify(low_1_4: Column, high: Column, mid: Column, ecg: Column, slope: Column, kurt: Column, front_back: Column) -> tuple[Column, Column]:
    """(kind, confidence) of a component from its shares of power, slope, kurtosis and front to back loading."""
    # Limits and weights of the kinds.
    eog, emg, heart = (low_1_4 > 0.3) & (front_back > 1), (high > 0.4) & (kurt > 5), (ecg > 0.2) & (slope < -1.5) & (kurt > 3)
    near = 1 - F.least(F.abs(slope + 1) / 1.5, F.lit(1.0))
    kind = F.when(eog, "EOG").when(emg, "EMG").when(heart, "ECG").otherwise("EEG")
    sure = (
        F.when(eog, F.least(F.lit(0.95), 0.55 + low_1_4 * 0.3 + F.least(front_back, F.lit(3.0)) * 0.05))
        .when(emg, F.least(F.lit(0.95), 0.55 + high * 0.3 + F.least(kurt, F.lit(20.0)) * 0.01))
        .when(heart, F.least(F.lit(0.90), 0.55 + ecg * 0.3 + F.abs(slope) * 0.05))
        .otherwise(F.least(F.lit(0.95), 0.5 + mid * 0.3 + near * 0.15))
    )
    return kind, sure


def classified(components: DataFrame, keys: list[str], fs: float, nperseg: int = 1024) -> DataFrame:
    """(keys, component, kind, confidence, ...) of ``decompose``'s result."""
    by = [*keys, "component"]
    rows = components.select(*by, "sample_idx", F.col("source").alias("value"))
    psd = spectral.densities(rows, by, nperseg, nperseg // 2, fs).groupBy(*by, "bin", "freq").agg(F.avg("power").alias("power"))
    f, p = F.col("freq"), F.col("power")
    total = F.sum(p) + S.TINY
    share = lambda c: F.sum(F.when(c, p).otherwise(0.0)) / total
    shares = psd.groupBy(*by).agg(
        share(f < 8).alias("low"), share(f > 30).alias("high"), share(f.between(1, 30)).alias("mid"), share(f.between(1, 4)).alias("low_1_4"),
        share(f.between(1, 3)).alias("ecg_band"), (-F.max(F.struct("power", (-f).alias("f")))["f"]).alias("dom_freq"),
    )
    slope = spectral.aperiodic(psd, by, 1.0, 30.0).select(*by, (-F.col("slope")).alias("spectral_slope"))
    stats = rows.groupBy(*by).agg(F.kurtosis("value").alias("kurt"), F.skewness("value").alias("skew"), F.var_pop("value").alias("var"))
    load = components.groupBy(*by).agg(F.first("loadings").alias("loadings")).select(*by, F.posexplode("loadings").alias("channel_idx", "loading"))
    out = shares.join(slope, by).join(stats, by).join(spatial(load, by), by)
    kind, sure = classify(*(F.col(c) for c in ("low_1_4", "high", "mid", "ecg_band", "spectral_slope", "kurt", "front_back_ratio")))
    return out.withColumn("kind", kind).withColumn("confidence", sure)


def without_components(samples: DataFrame, components: DataFrame, keys: list[str], bad: list[int]) -> DataFrame:
    """(keys, sample_idx, channel_idx, value): recordings put together again from all components but ``bad``, plus channel means."""
    held = components.where(~F.col("component").isin(bad)) if bad else components
    parts = held.select(*keys, "sample_idx", F.posexplode("loadings").alias("channel_idx", "w"), "source")
    sums = parts.groupBy(*keys, "sample_idx", "channel_idx").agg(F.sum(F.col("w") * F.col("source")).alias("s"))
    means = samples.groupBy(*keys, "channel_idx").agg(F.avg("value").alias("m"))
    grid = samples.select(*keys, "sample_idx", "channel_idx").join(means, [*keys, "channel_idx"])
    return grid.join(sums, [*keys, "sample_idx", "channel_idx"], "left").select(*keys, "sample_idx", "channel_idx", (F.col("m") + F.coalesce("s", F.lit(0.0))).alias("value"))


def shown_points(n_samples: int, most: int = 2000) -> np.ndarray:
    """Places of the samples of a component that a display gets."""
    return np.arange(0, n_samples, max(1, n_samples // most) if n_samples > most else 1)
