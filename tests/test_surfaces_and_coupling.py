"""Surfaces joined from shares against kernels, coupling and window scores of the query tables against numpy."""

import duckdb
import numpy as np
import pytest

from wavelake.functions import kernels as K
from wavelake.plans import kernels_queries as Q
from wavelake.plans import pipelines, registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    return duckdb.connect().execute(f"SELECT vec_id, label, embedding FROM '{D}/embeddings.parquet' ORDER BY vec_id").fetchall()


@pytest.mark.parametrize("weights", [False, True])
def test_surfaces_of_many_keys(spark, weights):
    rng = np.random.default_rng(5)
    values = {k: rng.normal(size=8) for k in ("a", "b", None)}
    rows = [(k, e, float(v)) for k, x in values.items() for e, v in zip(Q.ELECTRODES, x, strict=True)] + [("gap", "Fp1", 1.0)]
    got = pipelines.surfaces(spark.createDataFrame(rows, "k string, electrode string, value double"), ["k"], Q.ELECTRODES, 12, weights).collect()
    grid = np.linspace(-1, 1, 12)
    px, py = zip(*[pipelines.POSITIONS[e] for e in Q.ELECTRODES], strict=True)
    assert {r.k for r in got} == {"a", "b", None} and len(got) == 3 * 144
    want = {k: (K.distance_surface if weights else K.radial_surface)(px, py, x, grid) for k, x in values.items()}
    for r in got:
        assert r.z == pytest.approx(want[r.k][round((r.y + 1) * 5.5), round((r.x + 1) * 5.5)], abs=1e-9)


def test_f07_equals_the_kernel(spark, vectors):
    means = np.abs(np.array([v for *_, v in vectors], float)).reshape(len(vectors), 8, 8).mean(axis=(0, 1))
    px, py = zip(*[pipelines.POSITIONS[e] for e in Q.ELECTRODES], strict=True)
    want = K.radial_surface(px, py, means, np.linspace(-1, 1, 30))
    for r in registry.queries()["f07_topography"](spark, D).collect():
        assert r.z == pytest.approx(want[round((r.y + 1) * 14.5), round((r.x + 1) * 14.5)], abs=2e-6)


def test_a20_and_w17_of_each_label(spark, vectors):
    series = {}
    for _, label, x in vectors:
        series.setdefault(str(label), []).extend(map(float, x))
    mi = {r.recording_id: r.mi for r in registry.queries()["a20_phase_amplitude_coupling"](spark, D).collect()}
    turned = {}
    for r in registry.queries()["w17_analytic_signal"](spark, D).orderBy("recording_id", "sample_idx").collect():
        turned.setdefault(r.recording_id, []).append((r.phase, r.amplitude))
    assert set(mi) == set(turned) == set(series)
    for label, x in series.items():
        band = lambda lo, hi: K.analytic(K.filter_zero_phase(K.butter_sos(4, lo, hi, 128.0), np.array(x)))  # noqa: B023, E731
        phase, amplitude = np.angle(band(4.0, 8.0)), np.abs(band(30.0, 45.0))
        got = np.array(turned[label])
        assert np.abs(got[:, 0] - phase).max() < 2e-6 and np.abs(got[:, 1] - amplitude).max() < 2e-6
        at = np.floor((phase + np.pi) / (2 * np.pi / 18)).astype(int)
        means = np.array([amplitude[at == b].mean() if (at == b).any() else 0.0 for b in range(18)])
        p = means / (means.sum() + 1e-12)
        assert mi[label] == pytest.approx((p[p > 0] * np.log(p[p > 0] * 18)).sum() / np.log(18), abs=1e-5)


def test_no_query_is_without_a_table():
    """Every registered query reads a table: none takes its rows from a range or a list alone."""
    assert not {"s25_generated_recording", "f10_flow_of_a_study"} & set(registry.queries())
    missing = [n for n, sql in registry.oracle_sql().items() if not any(t in sql for t in ("events", "orders", "part", "supplier", "customer", "lineitem", "embeddings", "nation", "region", "labels", "documents", "conversations"))]
    assert missing == []
