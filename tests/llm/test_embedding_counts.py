"""Links of pairs that share many tables, or only the last bits of a key in an earlier one, are counted once each."""

import numpy as np
import pytest

from wavelake.llm import common as C
from wavelake.llm import embeddings as E


def brute(rows):
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= E.COSINE - 1e-12) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(near, False)
    return near.sum(axis=1)


def vectors(n, groups, spread, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, 16))
    return [(i, [float(v) for v in centre[i % groups] + spread * rng.normal(size=16)], int(i % groups % 2)) for i in range(n)]


@pytest.mark.parametrize("block", [C.BLOCK, 8])
def test_counts_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = vectors(240, 12, 0.1, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(4)
    got = {r.vec_id: r.n_links for r in E.near_vectors(df).collect()}
    want = brute(rows)
    assert abs(sum(got.values()) - want.sum()) <= 0.01 * want.sum() and sum(got[i] != want[i] for i in range(240)) <= 12
    assert all(got[i] <= want[i] for i in range(240))


def test_whole_keys_come_out_alike(spark):
    """Keys made again for the rows that link are those by which they met."""
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.0, 0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: r.n_links for r in E.near_vectors(df).collect()}
    assert got == {1: 1, 2: 1, 3: 0}
    tables, projections = E.sizes(3)
    x = np.array([r[1] for r in rows])
    keys = E._keys_of(x, np.linalg.norm(x, axis=1), np.zeros(3, np.int64), np.full(3, 3), tables, projections)
    again = E._keys_of(x[1:2], np.linalg.norm(x[1:2], axis=1), np.zeros(1, np.int64), np.full(1, 3), tables, projections)
    assert np.array_equal(keys[1], again[0])  # whole keys come out alike however many rows are hashed together
