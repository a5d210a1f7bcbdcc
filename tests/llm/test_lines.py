import random

import pytest

from wavelake.llm import common as C
from wavelake.llm import lines as L


def brute(rows):
    docs = sorted({(1 if i is None else 0, i or 0, L_hash.get(t, 0), i, t) for i, t in rows if t is not None}, key=lambda x: x[:3])
    seen, out = [], {}
    for *_, i, t in docs:
        keep, gone = [], 0
        for line in t.split("\n"):
            w = frozenset(line.encode().lower().split())
            dup = len(w) >= 5 and any(len(w & s) / len(w | s) >= 0.8 - 1e-12 for s in seen)
            if len(w) >= 5:
                seen.append(w)
            gone += dup
            if not dup:
                keep.append(line)
        out[i, t] = ("\n".join(keep), gone)
    return sorted(str((i, *(out[i, t] if t is not None else (None, 0)))) for i, t in rows)


L_hash = {}


def data():
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(400)]
    common = "the of and to in is it on as by".split()
    base = [[rng.choice(vocab) for _ in range(rng.randrange(5, 40))] for _ in range(15)]
    out = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(1, 8)):
            kind = rng.random()
            line = list(rng.choice(base)) if kind < 0.6 else rng.sample(common, 7) if kind < 0.75 else [rng.choice(vocab) for _ in range(12)]
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(vocab)
            text.append(" ".join(line))
        out.append((d, "\n".join(text)))
    return out + [(None, out[0][1]), (100, None), (101, ""), (102, "\n\n"), (3, out[3][1]), (3, "A B C D E\nother"), (103, "a b c d e"), (104, "x y z " * 9000 + "\nx y z " * 3), (105, "é è ê ë ē\r\nÉ")]


@pytest.mark.parametrize("block", [512, 4])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = data()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS did", "2 AS th", "3 AS line", "4 AS kind")
    for r in df.selectExpr("text", "xxhash64(text) AS h").collect():
        L_hash[r.text] = r.h
    out = L.dedup_lines(df, slots=1 << 16)
    assert out.columns[:6] == df.columns
    assert sorted(str((r.doc_id, r.text, r["__wl_gone"])) for r in out.collect()) == brute(rows)


def test_empty(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string"), slots=1 << 16).count() == 0
