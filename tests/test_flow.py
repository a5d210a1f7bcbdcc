"""Flow analysis, interpolation and corrections of many tests against plain numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake import schema as S
from wavelake.functions import kernels as K
from wavelake.operators import series, spectral, statistics
from wavelake.plans import pipelines

FS, SECONDS = 50, 900.0


def features(channels, fs, k=7):
    """Six indicators of 2 s windows, half overlapping, of the mean density over channels."""
    size = 2 * fs
    starts = range(0, channels.shape[1] - size + 1, size // 2)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    freq = np.arange(size // 2 + 1) * fs / size
    out = {b: [] for b in [*S.BANDS, "entropy"]}
    for s in starts:
        power = 0
        for x in channels:
            y = (x[s : s + size] - x[s : s + size].mean()) * taper
            p = np.abs(np.fft.fft(y)[: size // 2 + 1]) ** 2 / (fs * (taper**2).sum())
            p[1:-1] *= 2
            power = power + p / len(channels)
        for b, (lo, hi) in S.BANDS.items():
            out[b].append(power[(freq >= lo) & (freq < hi)].sum() / (power.sum() + S.TINY))
        q = power / (power.sum() + S.TINY)
        out["entropy"].append(-(q[q > 0] * np.log(q[q > 0])).sum())
    sm = {b: np.convolve(v, np.ones(k) / k, mode="same") for b, v in out.items()}
    a = sm["alpha"] + S.TINY
    t = np.array([(s + size / 2) / fs for s in starts])
    return t, {"theta_alpha_ratio": sm["theta"] / a, "alpha_rel": sm["alpha"], "beta_rel": sm["beta"], "gamma_rel": sm["gamma"], "eeg_entropy": sm["entropy"], "cog_load": (sm["theta"] + sm["beta"]) / a}


def test_flow_equals_numpy(spark):
    samples, events = pipelines.study(spark, SECONDS, FS, 2)
    samples = samples.where("recording_id = 'AtoB'")
    events = events.where("recording_id = 'AtoB'")
    row = pipelines.flow(samples, events, float(FS), lp=20.0, notch=None, tolerance=0.3).collect()[0]
    held = samples.toPandas().sort_values(["channel_idx", "sample_idx"])
    raw = held["value"].to_numpy().reshape(2, -1)
    clean = np.array([K.clean_channel(x, FS, 20.0, 1.0, None, False) for x in raw])
    for x in clean:
        bad = np.abs(x) > 100
        if bad.any() and not bad.all():
            x[bad] = np.interp(np.nonzero(bad)[0], np.nonzero(~bad)[0], x[~bad])
    at = {r.event_id: r.t_sec for r in events.collect()}
    start, end, x0, back = at.get("F1", 300.0), at.get("F2", at.get("X0", 540.0)), at.get("X0", 540.0), at.get("R0", 660.0)
    x1 = at.get("X1", back)
    t, feats = features(clean, FS)
    for name, x in feats.items():
        steady = (t >= start) & (t <= end)
        base = x[steady].mean()
        assert row.baseline_means[name] == pytest.approx(base, rel=1e-9)
        switch = x[(t >= x0) & (t <= x1)]
        lost = (base - switch.min()) / (base + S.TINY) * 100 if name in S.FLOW_INDICATORS else min((switch.max() - base) / (base + S.TINY) * 100, 300.0)
        assert row.attenuation[name] == pytest.approx(lost, rel=1e-6)
        good = (x >= base * 0.7) & (x <= base * 1.3)
        good, found = good[t >= back], None
        for i in range(len(good) - 30 + 1):
            if good[i : i + 30].all():
                found = i + 30.0
                break
        assert row.recovery_per_feature[name] == found
    assert row.recovery_time == max(v for v in row.recovery_per_feature.values() if v is not None)


def test_interpolation_of_a_whole_recording(spark):
    n = 375_000
    df = spark.range(n).select(F.lit("r").alias("k"), F.col("id").alias("i"), F.sin("id").alias("v"), (F.pmod(F.xxhash64("id"), F.lit(10)) < 3).alias("bad"))
    began = time.time()
    got = series.interpolate(df, ["k"], "i", "v", F.col("bad")).toPandas().sort_values("i")
    assert time.time() - began < 60
    bad, i = got["bad"].to_numpy(), np.arange(n)
    want = np.interp(i, i[~bad], np.sin(i[~bad]))
    assert np.abs(got["v"].to_numpy() - want).max() < 1e-9


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_false_discovery_equals_numpy(spark, keys):
    rng = np.random.default_rng(3)
    p = np.round(np.concatenate([rng.uniform(0, 1, 400), rng.uniform(0, 0.01, 100), np.zeros(3), np.ones(9)]), 3)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(p)], "k int, test_id long, p_value double")
    got = {r.test_id: r.adjusted_p for r in statistics.benjamini_hochberg(df, keys, buckets=16).collect()}
    order = np.lexsort((np.arange(len(p)), p))
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    assert len(got) == len(p)
    for i, v in zip(order, np.minimum(q, 1), strict=True):
        assert got[i] == pytest.approx(v, abs=1e-12)


def test_windows_with_gaps_or_repeats_are_left_out(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000)
    keep = [i for i in range(20_000) if i != 9_000]
    rows = [("a", i, float(x[i])) for i in keep] + [("a", 15_000, 1.0), ("b", 0, 1.0)]
    psd = spectral.densities(spark.createDataFrame(rows, "rec string, sample_idx long, value double"), ["rec"], 100, 30, 100.0)
    got = {}
    for r in psd.collect():
        got.setdefault(r.window_idx, {})[r.bin] = r.power
    want = {w for w in range((20_000 - 100) // 30 + 1) if not any(w * 30 <= bad < w * 30 + 100 for bad in (9_000, 15_000))}
    assert set(got) == want
    for w in (0, 136, 137, 400, max(want)):
        ref = K.segment_psd(x[None, w * 30 : w * 30 + 100], 100.0)[1][0]
        assert np.allclose([got[w][k] for k in range(51)], ref, rtol=1e-9)
