"""Rows that differ in nulls only, samples that one id or one text would fill, and words too long to keep."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from wavelake.llm import bpe, language, mixing, token_tables
from wavelake.llm import common as C


def test_rows_that_differ_in_nulls_stay(spark):
    rows = [(1, "a b c", "web", None, "s", [None, 1]), (1, "a b c", None, "web", "s", [1, None]), (1, "a b c", None, None, "s", None), (1, "a b c", "web", None, "s", [1, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, topic string, source string, parts array<int>")
    got = [str(tuple(r)) for r in mixing.mixed_documents(df).collect()]
    assert sorted(got) == sorted(map(str, map(tuple, rows)))
    assert df.select(*[x.alias(f"n{i}") for i, x in enumerate(C.row_names(df))]).distinct().count() == 4


def test_extra_tokens_of_many_equal_sources(spark):
    df = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("src"), F.lit(3).cast("long").alias("tokens"))
    got, n = mixing.plan(df, 15_777, 0.95, 4.0)
    each = {r.budget: r["count"] for r in got.groupBy("budget").count().collect()}
    assert n == 5000 and each == {3: 5000 - 777, 4: 777}


def rows(spark, data):
    return spark.createDataFrame(data, "lang string, id string, text string")


def test_sample_bound_holds_for_any_ids(spark):
    one_id = [("en", "7", f"word{i} and more") for i in range(400)]
    got = language.bounded_sample(rows(spark, one_id), 600).collect()
    assert 0 < sum(len(r.text) for r in got) <= 600 and sum(len(r.text) for r in got) > 500
    copies = [("en", "7", "the same text again")] * 5000 + [("en", str(i), f"other {i}") for i in range(30)]
    got = {r.text: r.copies for r in language.bounded_sample(rows(spark, copies), 2000).collect()}
    assert len(got) == 31 and got["the same text again"] == 5000


def test_each_language_has_its_part(spark):
    data = [("en", str(i), f"english text number {i} of many") for i in range(2000)] + [("zu", str(i), f"amagama {i}") for i in range(3)] + [("xx", "1", "y" * 5000), ("xx", "2", None)]
    got = language.bounded_sample(rows(spark, data), 3000).collect()
    by = {}
    for r in got:
        by.setdefault(r.lang, []).append(len(r.text or ""))
    assert len(by["zu"]) == 3 and sum(by["en"]) > 2500 and sum(map(sum, by.values())) <= 3000
    assert by.get("xx") == [0]  # a text longer than the part is passed over
    assert language.shares({"a": 10, "b": 1000, "c": 1000}, 100) == {"a": 10, "b": 45, "c": 45}
    assert language.bounded_sample(rows(spark, []), 100).count() == 0


def test_model_learns_where_one_id_holds_most_rows(spark):
    words = {"en": ["water", "house", "stone"], "de": ["wasser", "haus", "stein"]}
    data = [(4 if i % 5 else i, " ".join(np.random.default_rng(i).choice(words[lang], 6)), lang) for i in range(600) for lang in ["en", "de"]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.learn(df, most_bytes=4000)
    assert model.langs == ["de", "en"] and {"water", "wasser"} <= set(model.index[0])
    assert {r.lang_pred for r in language.identify(df.where("lang = 'de'"), model).collect()} == {"de"}


def test_long_words_are_not_kept(monkeypatch):
    e = bpe.TrieBPE(P.path("byte_bpe_50k.json"))
    blobs = [f"{'ab' * 40}{chr(97 + i)}" for i in range(9)] + ["short words"]
    first = e.encode_all(blobs)
    assert e.encode_all(blobs) == first and max(map(len, [*e.words, *e.elder])) <= bpe.KEPT_LENGTH
    monkeypatch.setattr(bpe, "PART_CHARS", 50)
    assert e.encode_all(blobs) == first and max(map(len, [*e.words, *e.elder])) <= bpe.KEPT_LENGTH
    w = token_tables.WordEncoder(P.path("word_bpe_49k.json"))
    one = w(["x" * 500 + " y", "short"])
    assert one == w(["x" * 500 + " y", "short"]) and max(map(len, w.pieces)) <= token_tables.KEPT_LENGTH
    model = language.Model(["a", "b"], {"known": [1, 2]}, [{"k": [1, 1]}, *[{} for _ in range(language.LONGEST - 1)]])
    scorer = language.Scorer(model)
    assert scorer(["k" * 300 + " known"]) == scorer(["k" * 300 + " known"]) and max(map(len, scorer.index)) <= language.KEPT_LENGTH


@pytest.mark.parametrize("text", ["a" * 70, "b" * 3000 + " c"])
def test_long_words_decode(text):
    e = bpe.TrieBPE(P.path("byte_bpe_50k.json"))
    assert e.decode(e.encode(text)) == text
