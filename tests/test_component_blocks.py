"""Components by sums over blocks against known sources and the kernel over whole recordings."""

import numpy as np
import pytest

from wavelake.functions import kernels as K
from wavelake.operators import artifacts as A
from wavelake.operators import components as C


def mixed(n, seed, offset=0.0):
    rng, t = np.random.default_rng(seed), np.arange(n)
    sources = np.stack([np.sign(np.sin(t / 17)), np.sin(t / 5.3), rng.laplace(size=n)], axis=1)
    return sources, sources @ rng.normal(size=(3, 3)) * [[1, 2, 3]] + offset


def table(spark, many):
    rows = [(k, i * 2, c, float(v)) for k, x in many.items() for i, r in enumerate(x) for c, v in enumerate(r)]
    return spark.createDataFrame(rows, "k string, sample_idx long, channel_idx int, value double").repartition(5)


def sources_of(rows, k, n):
    out = np.full((n, 1 + max(r.component for r in rows if r.k == k)), np.nan)
    for r in rows:
        if r.k == k:
            out[r.sample_idx // 2, r.component] = r.source
    return out


def test_sources_are_recovered_and_equal_the_kernel(spark):
    truth, x = mixed(1500, 1, 5e4)
    truth2, y = mixed(900, 2)
    flat = np.repeat(np.linspace(0, 1, 50)[:, None], 2, axis=1)
    df = table(spark, {"a": x, "b": y, "flat": flat})
    got = C.decompose_blocks(C.blocks_of(df, ["k"], 256), ["k"], warm=300).collect()
    for k, (s, v) in {"a": (truth, x), "b": (truth2, y)}.items():
        found = sources_of(got, k, len(v))
        near = np.abs(np.corrcoef(found.T, s.T)[:3, 3:])
        assert near.max(axis=0).min() > 0.99
        want, mixing = K.independent_components(v, tol=1e-12)
        assert np.abs(found - want).max() < 1e-2 and np.corrcoef(found[:, 0], want[:, 0])[0, 1] > 0.99999
        loads = {r.component: r.loadings for r in got if r.k == k}
        assert np.abs(np.array([loads[i] for i in range(3)]) - mixing).max() < 1e-2 * np.abs(mixing).max()
    assert {r.component for r in got if r.k == "flat"} == {0}


@pytest.mark.parametrize("bad", [[0], [1, 2]])
def test_muting_puts_the_rest_together(spark, bad):
    _, x = mixed(600, 3, 7.0)
    df = table(spark, {"a": x})
    whole, blocks = A.decompose(df, ["k"]), A.decompose(df, ["k"], most=100)
    one, other = ({(r.sample_idx, r.channel_idx): r.value for r in A.without_components(df, p, ["k"], bad).collect()} for p in (whole, blocks))
    assert one.keys() == other.keys() and max(abs(one[k] - other[k]) for k in one) < 0.05 * np.abs(x - x.mean(axis=0)).max()
    full = {(r.sample_idx, r.channel_idx): r.value for r in A.without_components(df, blocks, ["k"], []).collect()}
    assert max(abs(full[i * 2, c] - x[i, c]) for i in range(600) for c in range(3)) < 1e-8


def test_samples_without_a_channel_are_left_out(spark):
    _, x = mixed(300, 4)
    df = table(spark, {"a": x}).where("NOT (sample_idx = 10 AND channel_idx = 1)")
    got = C.decompose_blocks(C.blocks_of(df, ["k"], 64), ["k"]).collect()
    assert {r.sample_idx for r in got} == {2 * i for i in range(300)} - {10}
    assert C.decompose_blocks(C.blocks_of(df.where("k = 'none'"), ["k"]), ["k"]).count() == 0


def test_merged_parts():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 4)) + 1e6
    held = None
    for part in np.split(x, [3, 50, 51]):
        m = part.mean(axis=0)
        held = C.merged(held, (float(len(part)), m, (part - m).T @ (part - m)))
    assert np.allclose(held[1], x.mean(axis=0)) and np.allclose(held[2] / 100, np.cov(x.T, bias=True), rtol=1e-6, atol=1e-8)
