"""Tail probabilities and intervals of queries without SQL against integrals of the densities."""

import math

import numpy as np
import pytest

from wavelake.plans import registry

D = "/root/testdata/sf0.001"


def t_tail(t, df):
    """Two-sided tail of Student's t, its density integrated over the angle atan(x / sqrt(df))."""
    a = np.linspace(math.atan(abs(t) / math.sqrt(df)), math.pi / 2, 20_001)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * scale * np.trapezoid(np.cos(a) ** (df - 1), a)


def f_tail(f, d1, d2):
    """Upper tail of F by the beta density of d1 f / (d1 f + d2)."""
    x = np.linspace(d1 * f / (d1 * f + d2), 1, 400_001)[:-1] + 1e-12
    log = (d1 / 2 - 1) * np.log(x) + (d2 / 2 - 1) * np.log1p(-x)
    norm = math.lgamma(d1 / 2) + math.lgamma(d2 / 2) - math.lgamma((d1 + d2) / 2)
    return np.trapezoid(np.exp(log - norm), x)


def test_paired_t(spark):
    got = registry.queries()["a26_paired_t_p"](spark, D).collect()
    assert got
    for r in got:
        assert r.p_value == pytest.approx(t_tail(r.t_stat, r.df), abs=2e-4)
        half = (r.ci_high - r.ci_low) / 2
        assert r.ci_low + half == pytest.approx(r.mean_diff, abs=1e-5)
        assert t_tail(half / (r.std_diff / math.sqrt(r.n)), r.df) == pytest.approx(0.05, abs=5e-4)


def test_repeated_anova(spark):
    got = registry.queries()["a28_repeated_anova_p"](spark, D).collect()
    assert got
    for r in got:
        if r.n >= 2 and r.k >= 2 and (r.n - 1) * (r.k - 1) > 2:
            # with two conditions F is the square of t
            want = f_tail(r.f_stat, r.k - 1, (r.n - 1) * (r.k - 1)) if r.k > 2 else t_tail(math.sqrt(r.f_stat), r.n - 1)
            assert r.p_value == pytest.approx(want, abs=2e-3)


def test_intervals(spark):
    got = registry.queries()["a30_interval"](spark, D).collect()
    assert got
    for r in got:
        if r.n > 1 and r.sem > 0:
            assert t_tail((r.ci_high - r.mean) / r.sem, r.n - 1) == pytest.approx(0.05, abs=5e-4)
            assert r.mean - r.ci_low == pytest.approx(r.ci_high - r.mean, abs=1e-4)
