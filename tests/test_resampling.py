"""Resampling by counts against numpy's own draws, exact enumeration and plain loops."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.functions import draws as D
from wavelake.operators import resampling as R
from wavelake.operators import statistics as X


@pytest.mark.parametrize("again", [False, True])
def test_shares_of_blocks_add_up(again):
    total, picked, size = 1000, 400, 64
    parts = [D.shares(5, 300, total, picked, size, b, again) for b in range(16)]
    need = np.array([n for n, _ in parts])
    assert (need.sum(axis=0) == picked).all()
    assert np.array_equal(np.cumsum(need, axis=0)[:-1], np.array([b for _, b in parts])[1:])
    assert again or (need <= np.minimum(size, total - size * np.arange(16))[:, None]).all()
    assert abs(need[3].mean() - picked * size / total) < 1
    var = picked * (size / total) * (1 - size / total) * (1 if again else (total - picked) / (total - 1))
    assert 0.7 < need[3].var() / var < 1.4


def test_every_subset_is_as_likely():
    got = D.members(np.random.default_rng(1), 5, np.full(20_000, 2))
    assert (got.sum(axis=0) == 2).all()
    seen = {c: 0 for c in combinations(range(5), 2)}
    for column in got.T:
        seen[tuple(np.nonzero(column)[0])] += 1
    assert all(abs(n - 2000) < 200 for n in seen.values())
    x = np.arange(5.0) ** 2
    rng = lambda: np.random.default_rng(3)
    assert np.allclose(D.subset_sums(rng(), x, np.full(50, 3)), x @ D.members(rng(), 5, np.full(50, 3)))


def values(spark, n=60, shift=0.8):
    rng = np.random.default_rng(7)
    rows = [("m", "a", float(v)) for v in rng.normal(shift, 1, n)] + [("m", "b", float(v)) for v in rng.normal(0, 1, n + 13)]
    rows += [("same", g, 1.0) for g in "ab" for _ in range(9)] + [("lone", "a", 1.0), ("lone", "a", 3.0), ("nulls", "a", 1.0), ("nulls", "b", None), ("nulls", "b", float("nan")), (None, "a", 0.0), (None, "b", 4.0)]
    return spark.createDataFrame(rows, "metric string, g string, value double").repartition(4)


@pytest.mark.parametrize("block", [7, 2048])
def test_permutation_p_values(spark, block):
    df = values(spark)
    got = {r.metric: r for r in R.permutation_test(df, ["metric"], "g", "a", "b", n=4000, block=block).collect()}
    a = [r.value for r in df.where("metric = 'm' AND g = 'a'").collect()]
    b = [r.value for r in df.where("metric = 'm' AND g = 'b'").collect()]
    assert got["m"].observed_diff == pytest.approx(np.mean(a) - np.mean(b))
    assert (got["same"].p_value, got["same"].significant, got["same"].observed_diff) == (1.0, False, 0.0)
    for empty in ("lone", "nulls"):
        assert (got[empty].p_value, got[empty].significant, got[empty].observed_diff) == (1.0, False, 0.0)
    assert got[None].p_value == 1.0 and got[None].observed_diff == -4.0
    weak = values(spark, 40, 0.35)
    p = R.permutation_test(weak, ["metric"], "g", "a", "b", n=4000, block=block).where("metric = 'm'").first().p_value
    pool = np.array([r.value for r in weak.where("metric = 'm'").orderBy("g").collect()])
    rng, n_a = np.random.default_rng(11), 40
    seen = pool[:n_a].mean() - pool[n_a:].mean()
    null = [abs((q := rng.permutation(pool))[:n_a].mean() - q[n_a:].mean()) for _ in range(20_000)]
    want = np.mean(np.array(null) >= abs(seen))
    assert abs(p - want) < 4 * np.sqrt(want * (1 - want) / 4000) + 0.002


def test_small_sets_meet_the_enumeration(spark):
    x = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
    df = spark.createDataFrame([("a" if v > 7 else "b", v) for v in x], "g string, value double")
    sums = [np.mean(c) - np.mean([v for v in x if v not in c]) for c in combinations(x, 3)]
    seen = np.mean(x[3:]) - np.mean(x[:3])
    for alternative, share in (("two-sided", np.mean(np.abs(sums) >= seen)), ("greater", np.mean(np.array(sums) >= seen)), ("less", 1.0)):
        p = R.permutation_test(df, [], "g", "a", "b", n=5000, alternative=alternative, block=2).first().p_value
        assert abs(p - share) < 0.02


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("statistic, plain", [("mean", np.mean), ("stddev_pop", np.std), ("stddev_samp", lambda v: np.std(v, ddof=1)), ("median", np.median), (0.9, lambda v: np.quantile(v, 0.9)), (F.max, np.max)])
def test_bootstrap_intervals(spark, block, statistic, plain):
    rng = np.random.default_rng(2)
    x = rng.gamma(2.0, 3.0, 80)
    df = spark.createDataFrame([("k", float(v)) for v in x] + [("one", 5.0), ("none", None)], "key string, value double")
    n = 300 if callable(statistic) else 3000
    got = {r.key: r for r in R.bootstrap(df, ["key"], n=n, statistic=statistic, block=block).collect()}
    draws = np.array([plain(rng.choice(x, len(x))) for _ in range(20_000)])
    low, high = np.percentile(draws, [2.5, 97.5])
    r, near = got["k"], draws.std() * (0.5 if callable(statistic) else 0.25) + 1e-9
    assert r.mean == pytest.approx(plain(x))
    assert abs(r.ci_low - low) < near and abs(r.ci_high - high) < near and abs(r.bias - (draws.mean() - plain(x))) < near
    assert got["none"].mean is None and got["none"].ci_low is None
    if statistic in ("mean", "median"):
        assert (got["one"].ci_low, got["one"].ci_high) == (5.0, 5.0)


def test_draws_depend_on_the_rows_alone(spark):
    df = values(spark)
    one = R.bootstrap(df.repartition(1), ["metric"], n=50, block=16).orderBy("metric").collect()
    other = R.bootstrap(df.repartition(7), ["metric"], n=50, block=16).orderBy("metric").collect()
    for p, q in zip(one, other, strict=True):
        assert p.metric == q.metric and np.allclose([p.mean, p.ci_low, p.ci_high, p.bias], [q.mean, q.ci_low, q.ci_high, q.bias], rtol=0, atol=1e-9)


def test_means_of_ten_million_rows_hardly_vary():
    """Shares of large blocks keep the variance of whole draws."""
    need = np.array([D.shares(9, 200, 10_000_000, 5_000_000, 1 << 20, b, False)[0] for b in range(10)])
    assert (need.sum(axis=0) == 5_000_000).all()
    big = D._split(np.random.default_rng(0), 3 * 10**9, 7 * 10**9, np.full(500, 10**9), False)
    assert abs(big.mean() / 3e8 - 1) < 1e-4 and 0.7 < big.std() / np.sqrt(1e9 * 0.3 * 0.7 * 0.9) < 1.4


def test_corrections_without_keys(spark):
    t = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.2, 0.9])], "test_id int, p_value double")
    got = X.bonferroni(t, []).orderBy("test_id").collect()
    assert [r.adjusted_p for r in got] == pytest.approx([0.03, 0.6, 1.0]) and got[0].threshold == pytest.approx(0.05 / 3) and "_all" not in got[0]
    a = spark.createDataFrame([(3, 30.0), (1, 10.0), (2, 20.0)], "i int, value double")
    got = X.pair_up(a, a.where("i < 3").withColumn("value", F.col("value") + 1), [], "i").orderBy("pos").collect()
    assert [(r.pos, r.a, r.b) for r in got] == [(1, 10.0, 11.0), (2, 20.0, 21.0)]
