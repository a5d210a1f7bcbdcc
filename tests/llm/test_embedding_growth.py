"""Recall at the limit and unrelated candidates for the numbers of projections and tables that grow with the vectors."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from wavelake.llm import embeddings as E


def real(n):
    x = np.array(pq.read_table("/root/testdata/sf0.01/embeddings.parquet", columns=["embedding"]).column(0).to_pylist(), float)[:n]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [100, 5_000, 250_000, 10_000_000])
def test_planted_pairs_at_the_limit_are_found(n):
    rng = np.random.default_rng(n)
    a = real(400)
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.9301 * a + math.sqrt(1 - 0.9301**2) * o
    tables, projections = E.sizes(n)
    lab, one = np.ones(len(a), np.int64), np.ones(len(a))
    ka, kb = E.table_keys(a, one, lab, tables, projections), E.table_keys(b, one, lab, tables, projections)
    assert (ka == kb).any(axis=1).mean() > 0.97


def test_unrelated_vectors_meet_about_once_a_table_however_many_there_are():
    rng = np.random.default_rng(3)
    for n in (2_000, 20_000):
        x = rng.standard_normal((n, 64))
        tables, projections = E.sizes(n)
        keys = E.table_keys(x, np.linalg.norm(x, axis=1), np.ones(n, np.int64), tables, projections)
        met = 0
        for t in range(0, tables, 5):
            _, k = np.unique(keys[:, t], return_counts=True)
            met += (k * (k - 1)).sum() / n
        assert met / len(range(0, tables, 5)) < 2


def test_sizes_grow_slowly():
    got = [E.sizes(10**k) for k in range(3, 10)]
    assert all(t1 < t2 < 2 * t1 and p1 < p2 for (t1, p1), (t2, p2) in zip(got, got[1:], strict=False))
