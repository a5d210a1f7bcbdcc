import random

import numpy as np
import pytest

import corpus_pipeline
from wavelake.llm import common as C
from wavelake.llm import shingles as Sh
from wavelake.llm import simhash


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_kept(rows):
    """Rows that stay: the least id (null last) of each component of pairs at Jaccard 0.8 or more."""
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and (a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[label[k]] = min(least.get(label[k], (True, 0)), (i is None, i or 0))
    return sorted(str(i if not n else None) for n, i in least.values())


def replaced(rng, words, most):
    """``words`` with random words replaced as long as the similarity stays at ``most`` or more."""
    base, out = shingle_set(" ".join(words)), list(words)
    while True:
        nxt = list(out)
        nxt[rng.randrange(len(nxt))] = f"r{rng.random()}"
        s = shingle_set(" ".join(nxt))
        if len(base & s) < most * len(base | s):
            return out
        out = nxt


def test_pipeline_stage_finds_pairs_from_0_8_on(spark):
    rng, rows = random.Random(6), []
    for level in (0.8, 0.85, 0.9, 0.95):
        for _ in range(25):
            base = [f"w{rng.randrange(3000)}" for _ in range(300)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(replaced(rng, base, level)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect())
    assert got == brute_kept(rows) and len(got) == 100


@pytest.mark.parametrize("block", [512, 4])
def test_matches_brute_force_with_chains_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(7)
    rows = [(None, "no id here at all"), (1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (None, "no id here at all")]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(1, 12)):
            rows.append((rng.randrange(10**6), " ".join(base)))
            base = replaced(rng, base, rng.choice([0.75, 0.8, 0.9]))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS row", "3 AS key")
    out = Sh.keep_one(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == brute_kept(rows)


def test_one_row_stays_where_ids_repeat_or_are_null(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text of seven words"), (None, "third text with no id here"), (None, "third text with no id here"), (8, "h i j k l m"), (8, "h i j k l m")]
    got = Sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, rows[3][1]), (1, rows[0][1]), (2, rows[2][1]), (8, rows[5][1])]
    assert Sh.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_of_fingerprints_are_found_without_minima_and_checked(spark, monkeypatch):
    """The keys of SimHash alone bring pairs within two bits together, and the sets decide."""
    rng, rows = random.Random(8), []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(400)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:-1], "other"]))]
    fp = simhash.group_fingerprints([t.encode() for _, t in rows], Sh.WORDS)
    near = {k for k in range(0, len(rows), 2) if (int(fp[k]) ^ int(fp[k + 1])).bit_count() <= 2}
    assert len(near) > 20
    whole = Sh.nodes_and_keys

    def no_minima(at, h):
        node, full, keys = whole(at, h)
        return node, full, np.repeat(node[full][:, None], Sh.BANDS, axis=1)

    monkeypatch.setattr(Sh, "nodes_and_keys", no_minima)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in Sh.keep_one(df).collect()}
    assert kept == {k for k, _ in rows} - {k + 1 for k in near}
    # fingerprints that are near while the sets are not: no link
    monkeypatch.setattr(Sh, "group_fingerprints", lambda texts, *_: np.zeros(len(texts), np.uint64))
    far = spark.createDataFrame(rows[::2], "doc_id long, text string")
    assert Sh.keep_one(far).count() == 40
