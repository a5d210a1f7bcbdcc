import re

import duckdb

from wavelake.llm import quality as Q

WS = "[ \t\n\x0b\x0c\r]+"


def brute(text):
    t = text or ""
    words = [w for w in re.split(WS, t) if w]
    lines = [x for x in t.split("\n") if re.sub(WS, "", x)]
    seen, cover = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {k for i in at for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_counts_match_brute_force(spark):
    w = "a b c d e f g h i j"
    texts = [None, "", " \t\n", "one", "a\x0bb\x0cc\rd\te", "é ü 字 # $ <x>|", f"{w}\n{w}\n\nx", f"{w} {w} {w}", "x " * 500, f"{w} k l m {w} n {w[2:]}", "\x1cab \x85 c", "f ff fff", "line\nline \nline"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS t", "2 AS ratio", "'q' AS b")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.counts(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_buckets_are_monotone_and_tight(spark):
    r = spark.range(0, 200_000, 7).selectExpr("id", f"{Q.bucket('id')} AS b").selectExpr("id", "b", f"{Q.bucket_top('CAST(b AS BIGINT)')} AS top").collect()
    assert all(x.id <= x.top <= x.id * 17 / 16 + 1 for x in r)
    assert all(a.b <= b.b for a, b in zip(r, r[1:], strict=False))


def rows():
    good = [(i, " ".join(f"word{(i * 7 + k) % 97}" for k in range(60)), ["en", None][i % 2], "s") for i in range(300)]
    return [*good, (900, " ".join(f"w{k}###" for k in range(60)), "en", "s"), (901, "too short", "en", "s"), (902, None, None, None), (903, "a b c d e f g h " * 20, "en", "other"), (None, "x" * 9 + " y" * 30, "en", "s")]


def test_verdicts_and_sql(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = Q.judge(df).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in (900, 901, 902, 903))
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", data)
    want = c.execute(Q.OP6_SQL).fetchall()
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(map(str, (tuple(r[k] for k in cols) for r in got))) == sorted(map(str, want))


def test_empty_and_no_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    out = Q.judge(df)
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()
