import random

import numpy as np
import pytest

import corpus_pipeline
from wavelake.llm import common as C
from wavelake.llm import lines as L


def brute(rows):
    """Text left of each document: lines without a word stay, others go if an earlier line has a similarity of 0.8 or more."""
    seen, out = [], {}
    for i, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            w = frozenset(line.encode().lower().split())
            if not any(len(w & s) / len(w | s) >= 0.8 - 1e-12 for s in seen if w):
                keep.append(line)
            seen.append(w)
        out[i] = "\n".join(keep)
    return out


def data():
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(12)]
    rows = [(0, "All rights reserved.\n\nHome"), (1, "all rights  reserved.\n\nhome\n"), (2, "a b c d e\nk l m n"), (3, "d c b a\nk l m n o\nk l m"), (4, "x y z " * 2000 + "\nz y x")]
    return rows + [(k, "\n".join(" ".join(rng.choices(vocab, k=rng.randrange(0, 8))) for _ in range(rng.randrange(1, 6)))) for k in range(5, 90)]


@pytest.mark.parametrize("block", [512, 4])
def test_short_lines_are_deduplicated(spark, monkeypatch, block, tmp_path):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = data()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert want[1] == "\n" and want[3] == "k l m"
    assert {r.doc_id: r.text for r in L.op7_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, "").collect()} == want


def test_only_sizes_that_can_be_similar_are_paired():
    rng = np.random.default_rng(4)
    key, n = rng.integers(0, 12, 400) + (1 << 32) - 12, rng.integers(1, 60, 400)
    order = np.lexsort((n, key))
    key, n = key[order], n[order]
    got = [(i, j) for some in L._runs(key, n, 0.8) for i, j in zip(*some, strict=True)]
    assert len(set(got)) == len(got)
    assert set(got) == {(i, j) for i in range(400) for j in range(i + 1, 400) if key[i] == key[j] and min(n[i], n[j]) >= L._need(n[i], n[j], 0.8)}
    assert not list(L._runs(key[:0], n[:0], 0.8))
