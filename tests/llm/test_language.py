import random
import zlib

from wavelake.llm import language as L

ALPHABETS = {"aa": "abcde", "bb": "fghij", "cc": "klmnoé"}


def rows(n=240, seed=1):
    rng = random.Random(seed)
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randrange(2, 7))) for _ in range(60)] for k, a in ALPHABETS.items()}
    out = []
    for i in range(n):
        lang = rng.choice(list(vocab))
        out.append((i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(3, 40))), lang, "s", 1))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, lang_pred int"


def test_held_out_accuracy_and_edge_cases(spark):
    data = rows() + [(1000, None, "aa", "s", 1), (1001, "", None, "s", 1), (1002, "123 ½ _ !!", "aa", "s", 1), (None, "ABCDE abcd", None, None, 1), (1003, "ABEC " * 50_000, None, "s", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    got = L.identify(df.drop("lang_pred"), L.learn(df)).collect()
    assert len(got) == len(data)
    true = {d[0]: d[2] for d in data if d[2]}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 30 and all(r.lang_pred == true[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].lang_score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[None].lang_pred == "aa" and by[1003].lang_pred == "aa" and 0 <= by[1003].lang_score <= 1


def test_learns_nothing_from_held_out_or_unlabelled_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    df = spark.createDataFrame([(i, "abc abc", "aa") for i in held] + [(7777, "fff", None)], "doc_id long, text string, lang string")
    assert L.learn(df).langs == []
    assert {r.lang_pred for r in L.identify(df, L.learn(df)).collect()} == {"und"}


def test_backs_off_to_shorter_grams():
    m = L.Model(["x", "y"], {"abcd": [9.0, 0.0]}, [{"z": [1.0, 5.0]}, {}, {}, {}, {}])
    assert m.score("abcd")[0] > m.score("abcd")[1] and m.score("zq")[1] > m.score("zq")[0] and m.score("qqq") is None


def test_keep_and_empty(spark):
    df = spark.createDataFrame([*rows(60), (500, "!!", "aa", "s", 1)], SCHEMA)
    kept = L.keep_identified(df.drop("lang_pred"))
    assert kept.columns == ["doc_id", "text", "lang", "source"] and kept.count() == 60
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty, L.learn(empty)).count() == 0
