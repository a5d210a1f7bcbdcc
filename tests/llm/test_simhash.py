import random

import numpy as np
import pytest
import xxhash

from wavelake.llm import common as C
from wavelake.llm import simhash as S


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(ids, fps, bits=2):
    label = list(range(len(ids)))
    moved = True
    while moved:
        moved = False
        for i in range(len(ids)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    moved = True
    least = {}
    for i, c in zip(ids, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [least.get(c) for c in label]


def test_hash_of_slices_is_xxh64():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000))
    s = np.array([rng.randrange(2500) for _ in range(500)])
    n = np.array([rng.randrange(0, 200) for _ in range(500)])
    assert C.xxh64_slices(C.padded(data), s, n).tolist() == [xxhash.xxh64_intdigest(data[a : a + k], 42) for a, k in zip(s, n, strict=True)]


def test_golay_code_is_perfect_and_two_errors_share_a_key():
    assert [len(set(x)) for x in S._ERRORS].count(1) == 1 + 23 + 253
    fp = np.random.default_rng(0).integers(0, 2**63, 400, dtype=np.uint64)
    rng = random.Random(2)
    for bits in (0, 1, 2):
        other = fp.copy()
        for i in range(len(other)):
            for b in rng.sample(range(64), bits):
                other[i] ^= np.uint64(1 << b)
        assert all(set(a) & set(b) for a, b in zip(S.golay_keys(fp), S.golay_keys(other), strict=True))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    out = [(None, "no id"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "É x \x1cy"), (7, "repeated id")]
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 400))]
        for j in range(rng.randrange(1, 5)):
            w = list(base)
            if j > 1:
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append((100 + len(out), " ".join(w)))
    out.append((9999, " ".join(vocab) * 3000))
    return out


def test_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y").selectExpr("*", "1 AS fp", "2 AS key", "3 AS a")
    got = sorted((r.doc_id or -1, r.fp, r.component if r.component is not None else -1) for r in S.near_duplicates(df).collect())
    fps = [brute_fp(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert got == sorted((i or -1, f, c if c is not None else -1) for (i, _), f, c in zip(rows, signed, comp, strict=True))


def test_large_near_group_is_found_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    rng = random.Random(4)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 150:
        f = base
        for b in rng.sample(range(64), rng.randrange(0, 3)):
            f ^= 1 << b
        fps.add(f)
    fps = [*fps, *(rng.getrandbits(64) for _ in range(50))]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = S.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.node: r.root for r in C.connected_components(links, "t").collect()}
    got = {}
    for i, f in enumerate(signed):
        got.setdefault(roots.get(f, f), set()).add(i)
    want = {}
    for i, c in enumerate(brute_components(list(range(len(fps))), fps)):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty_table_and_chain_components(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    order = list(range(60))
    random.Random(5).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(40)] + [(order[50], order[51]), (7, 7)]
    got = {r.node: r.root for r in C.connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {n: min(order[:41]) for n in order[:41]} | {n: min(order[50:52]) for n in order[50:52]}


def test_keep_one_keeps_columns_and_one_row_of_a_group(spark):
    df = spark.createDataFrame([(5, "a b c d", "x"), (3, "A B C D", "y"), (9, "other words are here", None)], "doc_id long, text string, component string")
    assert sorted(map(tuple, S.keep_one(df).collect())) == [(3, "A B C D", "y"), (9, "other words are here", None)]
