"""Independent components of mixed sources, put together again with and without some of them, and their kinds."""

import numpy as np
import pytest

from wavelake.functions import kernels as K
from wavelake.operators import artifacts as A

FS, N = 128.0, 4096


def mixed(seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(N) / FS
    s = np.stack([np.sign(np.sin(2 * np.pi * 1.3 * t)), np.sin(2 * np.pi * 10 * t), rng.laplace(size=N), rng.uniform(-1, 1, N)], axis=1)
    s = (s - s.mean(axis=0)) / s.std(axis=0)
    m = rng.standard_normal((4, 4)) + 2 * np.eye(4)
    return s, m, s @ m + 5.0


def test_sources_are_recovered_whatever_the_mixture():
    for seed in range(4):
        s, _, x = mixed(seed)
        got, mixing = K.independent_components(x)
        c = np.abs(np.corrcoef(s.T, got.T)[:4, 4:])
        assert (c.max(axis=1) > 0.97).all() and sorted(c.argmax(axis=1)) == [0, 1, 2, 3]
        assert np.allclose(got @ mixing + x.mean(axis=0), x, atol=1e-8)
        assert np.allclose(got.T @ got / N, np.eye(4), atol=1e-8)
        power = (mixing**2).sum(axis=1)
        assert (np.diff(power) <= 1e-12).all() and (mixing[np.arange(4), np.abs(mixing).argmax(axis=1)] > 0).all()


def test_flat_and_dependent_channels():
    s, _, x = mixed()
    got, mixing = K.independent_components(np.concatenate([x, x[:, :1], np.ones((N, 1))], axis=1))
    assert got.shape == (N, 4) and mixing.shape == (4, 6) and np.abs(mixing[:, 5]).max() < 1e-8
    assert K.independent_components(np.ones((10, 3)))[0].shape == (10, 0)


@pytest.fixture(scope="module")
def samples(spark):
    x = mixed()[2]
    rows = [("r", i + 1000, c, float(x[i, c])) for i in range(N) for c in range(4)]  # numbers start later
    return spark.createDataFrame(rows, "recording_id string, sample_idx long, channel_idx int, value double").repartition(3)


def test_recording_without_some_components(spark, samples):
    x = mixed()[2]
    parts = A.decompose(samples, ["recording_id"])
    wide = lambda df: df.toPandas().pivot(index="sample_idx", columns="channel_idx", values="value").sort_index().to_numpy()
    assert np.allclose(wide(A.without_components(samples, parts, ["recording_id"], [])), x, atol=1e-6)
    source, mixing = K.independent_components(x)
    want = x - source[:, [0, 2]] @ mixing[[0, 2]]
    assert np.allclose(wide(A.without_components(samples, parts, ["recording_id"], [0, 2])), want, atol=1e-6)


def test_kinds_of_components(spark, samples):
    got = A.classified(A.decompose(samples, ["recording_id"]), ["recording_id"], FS, 512).collect()
    assert len(got) == 4 and all(r.kind in ("EOG", "EMG", "ECG", "EEG") and 0 < r.confidence <= 0.95 for r in got)
    source = K.independent_components(mixed()[2])[0]
    for r in got:
        f, p = K.welch(source[:, r.component], FS, 512)
        assert r.low_1_4 == pytest.approx(p[(f >= 1) & (f <= 4)].sum() / p.sum(), abs=0.02)
    slow = max(got, key=lambda r: r.low_1_4)
    assert slow.kind == ("EOG" if slow.front_back_ratio > 1 else "EEG")
