"""Time-frequency grids and their permutation tests against transforms of one epoch at a time."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import kernels as K
from wavelake.operators import timefreq as T
from wavelake.plans import registry

D = "/root/testdata/sf0.001"
FREQS = K.log_grid(4, 45)


@pytest.fixture(scope="module")
def vectors():
    return duckdb.connect().execute(f"SELECT vec_id, label, embedding FROM '{D}/embeddings.parquet'").fetchall()


@pytest.fixture(scope="module")
def powers(vectors):
    """label -> (power, phase) of its epochs, one transform each."""
    out = {}
    for _, label, x in vectors:
        c = K.wavelet_transform(np.array(x, float), 128.0, FREQS)
        out.setdefault(label, []).append((np.abs(c) ** 2, np.angle(c)))
    return {k: (np.array([p for p, _ in v]), np.array([a for _, a in v])) for k, v in out.items()}


def grid(rows, column, shape=(50, 64)):
    got = {}
    for r in rows:
        got.setdefault(r.label, np.full(shape, np.nan))[r.freq_idx, r.time_idx] = r[column]
    return got


def test_w18_power(spark, powers):
    for r in registry.queries()["w18_wavelet_power"](spark, D).collect():
        assert r.power == pytest.approx(powers[r.label][0].mean(axis=(0, 2))[r.freq_idx], abs=2e-6) and r.freq == pytest.approx(FREQS[r.freq_idx], abs=1e-6)


def test_a17_and_a18_perturbation(spark, powers):
    got = grid(registry.queries()["a17_perturbation"](spark, D).collect(), "db")
    shares = {r.label: r for r in registry.queries()["a18_desynchronisation"](spark, D).collect()}
    assert set(got) == set(powers)
    for label, (p, _) in powers.items():
        mean = p.mean(axis=0)
        want = 10 * np.log10(mean / np.median(mean[:, :16], axis=1)[:, None])
        assert np.abs(got[label] - want).max() < 2e-6
        assert shares[label].erd_ratio == pytest.approx((want < -0.5).mean(), abs=1e-3) and shares[label].ers_ratio == pytest.approx((want > 0.5).mean(), abs=1e-3)


def test_a19_phase_locking(spark, powers):
    got = grid(registry.queries()["a19_phase_locking"](spark, D).collect(), "itpc")
    for label, (_, a) in powers.items():
        assert np.abs(got[label] - np.abs(np.exp(1j * a).mean(axis=0))).max() < 2e-6


def test_a32_null_distribution(spark, powers):
    got = grid(registry.queries()["a32_time_frequency_permutation"](spark, D).collect(), "p_value")
    label = min(powers)
    p = powers[label][0]
    after, ref = p[:, :, 16:], p[:, :, :16].mean(axis=2)
    pool = np.concatenate([after, np.repeat(ref[:, :, None], after.shape[2], axis=2)])
    e, rng = len(p), np.random.default_rng(1)
    seen, hits = np.abs(after.mean(axis=0) - ref.mean(axis=0)[:, None]), np.zeros(after.shape[1:])
    for _ in range(600):
        i = rng.permutation(2 * e)
        hits += np.abs(pool[i[:e]].mean(axis=0) - pool[i[e:]].mean(axis=0)) >= seen
    off = got[label][:, 16:] - hits / 600
    assert np.isnan(got[label][:, :16]).all() and np.abs(off).max() < 0.2 and abs(off.mean()) < 0.03


@pytest.mark.parametrize("block", [16, 4096])
def test_two_conditions(spark, block):
    rng = np.random.default_rng(4)
    n, t = 40, np.arange(64) / 128
    rows = []
    for e in range(2 * n):
        tone = (3.0 if e < n else 0.5) * np.sin(2 * np.pi * 20 * t)
        rows += [(e, c, i, float(v), int(e >= n)) for c in range(2) for i, v in enumerate(tone + rng.normal(0, 0.5, 64))]
    df = spark.createDataFrame(rows, "epoch_idx int, channel_idx int, rel_idx int, value double, side int").repartition(3)
    got = T.permuted(T.epochs_of(df, []), [], 128.0, [8.0, 20.0], n=199, block=block).collect()
    at = lambda f: [r.p_value for r in got if r.freq_idx == f]
    assert len(got) == 128 and max(at(1)[20:44]) <= 0.01 and np.mean(at(0)) > 0.1
    alone = T.permuted(T.epochs_of(df.where("side = 0"), []), [], 128.0, [8.0], n=9).collect()
    assert {r.p_value for r in alone} == {1.0}


def test_means_over_channels_and_tasks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 2, 50))
    rows = [(int(e % 3), int(e), c, i, float(x[e, c, i])) for e in range(30) for c in range(2) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, epoch_idx int, channel_idx int, rel_idx int, value double").repartition(5)
    got = T.mean_grids(T.epochs_of(df, ["k"]), ["k"], 100.0, [5.0, 17.0]).where("k = 1").collect()
    long = T.coefficients(df, ["k", "epoch_idx", "channel_idx"], "rel_idx", 100.0, [5.0, 17.0]).where("k = 1")
    power = {(r.freq_idx, r.time_idx): r.power for r in T.epoch_power(long, ["k"]).groupBy("freq_idx", "time_idx").agg(F.avg("power").alias("power")).collect()}
    locked = {(r.freq_idx, r.time_idx): r.itpc for r in T.phase_locking(long, ["k"]).collect()}
    assert len(got) == 100
    for r in got:
        assert r.power == pytest.approx(power[r.freq_idx, r.time_idx]) and r.itpc == pytest.approx(locked[r.freq_idx, r.time_idx])
