import math

import numpy as np

from wavelake.llm import common as C
from wavelake.llm import embeddings as E


def brute(rows):
    n = len(rows)
    good = [lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    links, label = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
    least = {}
    for (i, _, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted((str(i), k, str(least.get(c))) for (i, _, _), k, c in zip(rows, links, label, strict=True))


def data():
    rng = np.random.default_rng(5)
    out = []
    for g in range(12):
        base = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 12))):
            v = base + rng.standard_normal(64) * rng.choice([0.0, 0.1, 0.25, 0.3])
            out.append((len(out), v.astype(np.float32).astype(float).tolist(), int(g % 3)))
    out += [(900, None, 1), (901, [0.0] * 64, 1), (902, [1.0] * 63 + [None], 1), (903, [math.nan] * 64, 1), (904, [], 1), (905, [1.0] * 64, None), (906, [1.0] * 64, 1), (906, [2.0] * 64, 1), (907, [1.0, 2.0], 1), (None, [1.0] * 64, 1)]
    return out


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_matches_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 8)
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS rid", "'x' AS norm")
    got = sorted((str(r.vec_id), r.n_links, str(r.component)) for r in E.near_vectors(df).collect())
    want = brute(rows)
    # pairs right at the limit may be missed with a small probability; none was here
    assert got == want


def test_recall_at_the_limit():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((2000, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.931 * a + math.sqrt(1 - 0.931**2) * o
    lab = np.ones(2000, np.int64)
    ka, kb = E.table_keys(a, np.ones(2000), lab), E.table_keys(b, np.ones(2000), lab)
    assert (ka == kb).any(axis=1).mean() > 0.98


def test_keys_do_not_depend_on_the_batch():
    x = np.random.default_rng(2).standard_normal((300, 64))
    n, lab = np.sqrt((x * x).sum(1)), np.zeros(300, np.int64)
    whole = E.table_keys(x, n, lab)
    assert (np.concatenate([E.table_keys(x[i : i + 1], n[i : i + 1], lab[i : i + 1]) for i in range(300)]) == whole).all()


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
