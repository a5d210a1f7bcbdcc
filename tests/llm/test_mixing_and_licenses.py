import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wavelake.llm import licenses as Li
from wavelake.llm import mixing as M


def test_alpha_meets_entropy_and_repetition():
    t = np.array([900.0, 50, 30, 20])
    w = M.weights_at(t, M.choose_alpha(t, t.sum(), 0.9, 100))
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * np.log(4), abs=1e-6)
    a = M.choose_alpha(t, t.sum(), 0.9, 2.0)
    assert (M.weights_at(t, a) * t.sum() / t).max() == pytest.approx(2.0, abs=1e-6)
    assert M.choose_alpha(np.array([5.0, 5.0]), 10) == 1.0 and M.choose_alpha(np.array([7.0]), 7) == 1.0
    assert M.budgets(t, 0.3, 1000).sum() == 1000


def sources():
    return [(i, "w " * (1 + i % 7), "big" if i % 3 else ["s1", "s2", None][i % 9 // 3]) for i in range(600)] + [(9000, None, "s1"), (9001, "only", "tiny"), (None, "x y", "s2"), (7, "w w", "big"), (7, "w w", "big"), (9002, "", "void")]


def test_draws_meet_budgets(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 64)
    df = spark.createDataFrame(sources(), "doc_id long, text string, source string").selectExpr("*", "1 AS t", "2 AS src", "3 AS block")
    got = M.mix(df, ["doc_id"]).toPandas()
    tokens = {}
    for _, t, s in sources():
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    keys = sorted(tokens, key=lambda s: (s is not None, s))
    n = np.array([tokens[k] for k in keys])
    want = dict(zip(keys, M.budgets(n, M.choose_alpha(n, n.sum()), int(n.sum())), strict=True))
    for s in keys:
        part = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert want[s] <= part["n_tokens"].sum() < want[s] + 7 or (want[s] == 0 and part.empty)
        full = part[part["epoch"] < want[s] // max(tokens[s], 1)]
        for _, once in full.groupby("epoch"):  # whole passes hold every row
            assert once["n_tokens"].sum() == tokens[s]
        assert part["position"].between(0, 1, inclusive="left").all()
    again = M.mix(df.repartition(5), ["doc_id"]).toPandas()
    assert sorted(map(str, again.itertuples(index=False))) == sorted(map(str, got.itertuples(index=False)))


def test_mixed_documents_keep_columns_and_counts(spark):
    df = spark.createDataFrame([(*r, 5) for r in sources()], "doc_id long, text string, source string, n_chars long")
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    # other keys order the rows in another way, but the budgets are the same
    words = lambda d, c: {r[0]: r[1] for r in d.groupBy("source").agg(F.sum(c)).collect()}
    got, want = words(out, M.n_words("text")), words(M.mix(df, ["doc_id"]), "n_tokens")
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 7 for s in got)
    empty = spark.createDataFrame([], df.schema)
    assert M.mixed_documents(empty).count() == 0


def test_licenses_found_with_differences(spark):
    mit = Li.TEMPLATES[0][1]
    texts = [
        None, "", "nothing here", "Released under the MIT License.", "xx\nThis work is licensed under the GNU General Public License, version 3.\nyy", "licensed under the gnu general public license, version 9",
        "intro " * 300 + "\n" + mit.replace("hereby granted", "hereby given") + "\n" + "outro " * 300, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "Ä" * 3000 + " Licensed under the Apache License, Version 2.0 " + "İ" * 3000,
        "license " * 20_000, Li.TEMPLATES[4][1],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS licenses", "2 AS saved")
    got = {r.doc_id: r.licenses for r in Li.scan(df).collect()}
    names = {i: [x.license for x in v] for i, v in got.items()}
    assert names == {0: [], 1: [], 2: [], 3: ["MIT"], 4: ["GPL-3.0"], 5: [], 6: ["MIT"], 7: ["Apache-2.0", "CC-BY-NC-4.0"], 8: ["Apache-2.0"], 9: [], 10: ["BSD-3-Clause"]}
    assert got[6][0].differing == ["-granted", "+given"] and got[3][0].differing == []
    assert Li.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages(spark):
    prose = {"en": "the cat sat on a mat and the dog ran to it", "de": "der hund und die katze sind in dem haus"}
    rows = [(i, " ".join(f"{w}{i % 11}" if k % 4 == 0 else w for k, w in enumerate(prose[lang].split() * 3)), lang, f"s{i % 2}", 1) for i in range(60) for lang in [["en", "de"][i % 2]]]
    rows += [(100, "12345", "en", "s0", 5), (101, rows[0][1], "en", "s0", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, "")
        assert docs.columns == first.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()
    assert 100 not in {r.doc_id for r in last.collect()}
