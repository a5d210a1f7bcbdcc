import inspect

import pytest

from wavelake.operators import statistics, timefreq
from wavelake.plans import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["w18_wavelet_power", "a17_perturbation", "a19_phase_locking"])
def test_all_fifty_frequencies(spark, name):
    got = {r.freq_idx for r in registry.queries()[name](spark, D).select("freq_idx").distinct().collect()}
    assert got == set(range(50))


@pytest.mark.parametrize("name, module, operator, n", [("a31_permutation", statistics, "permutation_test", 1000), ("a33_bootstrap", statistics, "bootstrap", 1000), ("a32_time_frequency_permutation", timefreq, "permuted", 200)])
def test_as_many_draws_as_the_operator_takes_by_itself(spark, monkeypatch, name, module, operator, n):
    whole, seen = getattr(module, operator), []

    def spy(*args, **options):
        bound = inspect.signature(whole).bind(*args, **options)
        bound.apply_defaults()
        seen.append(bound.arguments["n"])
        return whole(*args, **options)

    monkeypatch.setattr(module, operator, spy)
    registry.queries()[name](spark, D)
    assert seen == [n]
