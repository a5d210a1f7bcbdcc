"""Filters, quadrature and resampling in chunks against the kernels over whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import kernels as K
from wavelake.operators import chunks as C
from wavelake.operators import timefreq as T


def series(n, seed=0, fs=128.0):
    rng, t = np.random.default_rng(seed), np.arange(n) / fs
    return 5 + np.cumsum(rng.normal(0, 0.1, n)) + np.sin(2 * np.pi * 6 * t) + 0.4 * np.sin(2 * np.pi * 37 * t) + rng.normal(0, 0.3, n)


def table(spark, many):
    rows = [(k, 10 + 2 * i, float(v)) for k, x in many.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, sample_idx long, value double").repartition(5)


def by_key(df, column="value"):
    out = {}
    for r in df.orderBy("k", "sample_idx").collect():
        out.setdefault(r.k, []).append(r[column])
    return {k: np.array(v, float) for k, v in out.items()}


MANY = {"a": series(1000), "b": series(401, 1), "short": series(130, 2), "tiny": series(12, 3), None: series(257, 4)}


@pytest.mark.parametrize("size", [100, 128, 333])
def test_filters_in_chunks(spark, size):
    df = table(spark, MANY)
    got = T.cleaned(df, ["k"], 128.0, 45.0, 1.0, 50.0, most=120, size=size)
    value = by_key(got)
    for k, x in MANY.items():
        if k != "tiny":
            assert np.abs(value[k] - K.clean_channel(x, 128.0, 45.0, 1.0, 50.0)).max() < 1e-9
    assert got.where("k = 'tiny'").select("error").distinct().collect()[0][0].startswith("ValueError")
    assert [r.sample_idx for r in got.where("k = 'b'").orderBy("sample_idx").limit(3).collect()] == [10, 12, 14]


def test_edges_that_do_not_fit(spark):
    got = T.cleaned(table(spark, {"a": series(300)}), ["k"], 50.0, 45.0, 1.0, None, strict=True, most=100, size=100)
    assert got.where("value IS NULL AND error LIKE 'ValueError%'").count() == 300


@pytest.mark.parametrize("size, fs, target", [(100, 128, 64), (90, 100, 250), (128, 128, 125)])
def test_resampling_in_chunks(spark, size, fs, target):
    got = by_key(T.resampled(table(spark, MANY), ["k"], fs, target, most=50, size=size))
    for k, x in MANY.items():
        want = K.resample_ratio(x, target, fs)
        assert len(got[k]) == len(want) and np.abs(got[k] - want).max() < 1e-9


def test_a_million_samples_in_many_tasks(spark):
    n, fs = 1_000_000, 128.0
    t = F.col("id") / fs
    df = spark.range(n).select(F.lit("r").alias("k"), F.col("id").alias("sample_idx"), (F.sin(t * 6 * 2 * np.pi) + F.sin(t * 0.01) * 3 + F.sin(t * 35 * 2 * np.pi) * 0.5 + F.rand(3)).alias("value"))
    df = df.withColumn("value", F.round("value", 9))
    x = np.array([r.value for r in df.orderBy("sample_idx").collect()])
    sos = K.butter_sos(4, 4.0, 8.0, fs)
    chunks = C.chunked(df, ["k"])
    assert chunks.count() == 16
    done = C.zero_phase(chunks, ["k"], sos)
    whole = K.filter_zero_phase(sos, x)
    rows = done.orderBy("chunk").collect()
    assert np.abs(np.concatenate([r.x for r in rows]) - whole).max() < 1e-9
    turned = np.concatenate([r.im for r in C.analytic(done, ["k"]).orderBy("chunk").collect()])
    assert np.abs(turned - K.analytic(whole).imag).max() < 1e-9


@pytest.mark.parametrize("n", [1000, 1001, 1037, 801])
def test_quadrature_of_a_ring(n):
    """Even and odd lengths, a last chunk of one sample; no band is needed."""
    x, size = series(n), 100
    moments = np.concatenate([C._moments(x[c * size : (c + 1) * size], c, n, size) for c in range(-(-n // size))])
    want = K.analytic(x).imag
    for c in range(-(-n // size)):
        first = c * size - 2 * size
        last = min((c + 1) * size, n) + 2 * size
        ring = np.arange(first, last) % n
        got = C._quadrature({"m": n, "c": c, "first": first, "x": x[ring], "moments": moments}, size)
        assert np.array_equal(got[0], x[c * size : (c + 1) * size])
        assert np.abs(got[1] - want[c * size : (c + 1) * size]).max() < 1e-9


def test_phase_and_amplitude_in_chunks(spark):
    many = {"a": series(5000), "b": series(4193, 5), "short": series(900, 6)}
    df = table(spark, many)
    chunked = T.phase_and_amplitude(df, ["k"], 128.0, size=400)
    whole = T.phase_and_amplitude(df, ["k"], 128.0)
    for c in ("phase", "amplitude"):
        one, other = by_key(chunked, c), by_key(whole, c)
        for k in many:
            off = np.angle(np.exp(1j * (one[k] - other[k]))) if c == "phase" else one[k] - other[k]
            assert np.abs(off).max() < 1e-7
