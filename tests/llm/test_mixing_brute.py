"""Draws against a plain loop over sources, passes, blocks and rows; only the hashes that order them are taken from Spark."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.llm import mixing as M


def rows(n=90):
    rng = random.Random(8)
    out = [(i, " ".join(["w"] * rng.randrange(0, 9)), rng.choice(["big"] * 6 + ["s1", None, "s2"])) for i in range(n)]
    return out + [(500, "x " * 40_000, "long"), (501, None, "s1"), (502, "", "void"), (7, "w w", "big"), (7, "w w", "big"), (None, "a b", "s2")]


def hashes(spark, triples, cols):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(triples)], "i long, " + ", ".join(f"c{k} {t}" for k, t in enumerate(cols)))
    got = df.select("i", F.xxhash64(F.lit(M.SEED), *[f"c{k}" for k in range(len(cols))]).alias("h")).collect()
    by = {r.i: r.h for r in got}
    return {t: by[i] for i, t in enumerate(triples)}


def brute(spark, data, block_tokens):
    """(doc_id, source, tokens, epoch, block, start) of all draws."""
    sizes = [(i, s, len((t or "").split())) for i, t, s in data]
    tokens = Counter()
    for _, s, t in sizes:
        tokens[s] += t
    order = sorted(tokens, key=lambda s: (tokens[s], s is not None, s or ""))
    n = np.array([tokens[s] for s in order])
    budget = dict(zip(order, M.budgets(n, M.choose_alpha(n, int(n.sum())), int(n.sum())), strict=True))
    home = hashes(spark, sorted({(i, s, t) for i, s, t in sizes}, key=str), ["long", "string", "long"])
    blocks = {s: min(max(-(-tokens[s] // block_tokens), 1), M.MOST_BLOCKS) for s in tokens}
    held = {}
    for i, s, t in sizes:
        held.setdefault((s, home[i, s, t] % blocks[s]), []).append((i, t))
    passes = {s: -(-budget[s] // tokens[s]) if budget[s] else 0 for s in tokens}
    outer = hashes(spark, [(e, s, b) for s, b in held for e in range(passes[s])], ["int", "string", "int"])
    inner = hashes(spark, sorted({(e, i, t) for (s, _), got in held.items() for i, t in got for e in range(passes[s])}, key=str), ["int", "long", "long"])
    out = []
    for s in tokens:
        for e in range(passes[s]):
            at = e * tokens[s]
            for b in sorted((b for x, b in held if x == s), key=lambda b: (outer[e, s, b], b)):
                for i, t in sorted(held[s, b], key=lambda r: (inner[e, *r], r[0] is not None, r[0] or 0, r[1])):
                    if at < budget[s]:
                        out.append((i, s, t, e, b, at))
                    at += t
    return Counter(out)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_draws_equal_a_plain_loop(spark, monkeypatch, sent):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 32)
    monkeypatch.setattr(M, "SENT_SOURCES", sent)
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = Counter((r.doc_id, r.source, r.n_tokens, r.epoch, r.block, r.start) for r in M.mix(df, ["doc_id"]).collect())
    assert got == brute(spark, data, 32)


def test_plan_of_many_sources_equals_that_of_each(spark):
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 40, 300)
    per = spark.createDataFrame([(f"s{i:03d}", int(t)) for i, t in enumerate(tokens)], "src string, tokens long")
    got = {r.src: r.budget for r in M.plan(per, 5000, 0.95, 4.0)[0].collect()}
    whole = tokens.astype(float)
    alpha = M.choose_alpha(whole, 5000, 0.95, 4.0)
    exact = M.weights_at(whole, alpha) * 5000
    assert sum(got.values()) == 5000 and all(0 <= got.get(f"s{i:03d}", 0) - np.floor(exact[i] - 1e-9) <= 1 for i in range(300))


def test_a_limit_that_no_exponent_keeps_repeats_all_sources_alike():
    t = np.array([10.0, 30.0])
    assert M.choose_alpha(t, 200, 0.95, 4.0) == 1.0
    assert M.budgets(t, 1.0, 200).tolist() == [50, 150]
