"""Scores against a plain computation from the counts, ties, repeated rows, and the bound of kept words."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from wavelake.llm import language as L

WORD = re.compile(r"[^\W\d_]+")


def pieces(word, k):
    if k == 1:
        return list(word)
    marked = f"\x02{word}\x03"
    return [marked[i : i + k] for i in range(len(marked) - k + 1)]


def brute(train, texts):
    words = defaultdict(Counter)
    for lang, text in train:
        words[lang].update(WORD.findall((text or "").lower()))
    langs = sorted(x for x in words if words[x])
    tables = [{} for _ in range(L.LONGEST + 1)]
    for lang in langs:
        for w, n in words[lang].items():
            tables[0].setdefault(w, Counter())[lang] += n
            for k in range(1, L.LONGEST + 1):
                for g in pieces(w, k):
                    tables[k].setdefault(g, Counter())[lang] += round((1 + math.log(n)) * 1e6) / 1e6
    sums = [{x: sum(c[x] for c in t.values()) for x in langs} for t in tables]
    log = lambda k, g, x: math.log((tables[k][g][x] + L.SMOOTH) / (sums[k][x] + L.SMOOTH * (len(tables[k]) + 1)))

    def word(w):
        if w in tables[0]:
            return [log(0, w, x) for x in langs]
        for k in range(L.LONGEST, 0, -1):
            known = [g for g in pieces(w, k) if g in tables[k]]
            if known:
                return [sum(log(k, g, x) for g in known) / len(known) for x in langs]

    out = []
    for t in texts:
        found = [w for w in WORD.findall((t or "").lower()) if any(map(str.isalpha, w))]
        if not found or not langs:
            out.append(("und", 0.0))
            continue
        heard = [s for s in map(word, found) if s]
        mean = [sum(s[i] for s in heard) / max(len(heard), 1) for i in range(len(langs))]
        e = [math.exp((m - max(mean)) * math.sqrt(min(max(len(heard), 1), 64))) for m in mean]
        best = max(range(len(langs)), key=lambda i: (round(mean[i], 12), -i))
        out.append((langs[best], e[best] / sum(e)))
    return out


def test_scores_equal_the_plain_computation(spark):
    rng = random.Random(5)
    vocab = {x: ["".join(rng.choice(a) for _ in range(rng.randrange(1, 9))) for _ in range(50)] for x, a in {"aa": "abcdef", "bb": "defghi", "cc": "ghiabé"}.items()}
    rows = []
    for i in range(150):
        lang = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choice(vocab[lang if rng.random() < 0.8 else rng.choice(list(vocab))]) for _ in range(rng.randrange(1, 30))), lang))
    rows += rows[:20] + [(200, "zzz qqq", "aa"), (201, "", None), (202, None, "bb"), (203, "日本 語", None), (None, "abc", "cc"), (204, "1 2 3", "cc"), (205, "ab" * 40_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    train = [(x, t) for i, t, x in rows if i is not None and x is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    want = Counter()
    for (i, t, _), (lang, score) in zip(rows, brute(train, [t for _, t, _ in rows]), strict=True):
        want[i, t, lang, round(score, 6)] += 1
    got = Counter((r.doc_id, r.text, r.lang_pred, round(r.lang_score, 6)) for r in L.identify(df, L.learn(df)).collect())
    assert got == want


def test_ties_go_to_the_language_that_sorts_first(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, "same words here", "zz" if k % 2 else "mm") for k, i in enumerate(ids[: len(ids) // 2 * 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(df, L.learn(df)).collect()
    assert {(r.lang_pred, r.lang_score) for r in got} == {("mm", 0.5)}


@pytest.mark.parametrize("letters", ["abc", "日本語"])
def test_kept_words_are_bounded_whether_they_say_something_or_not(letters):
    m = L.Model(["x", "y"], {"abcd": [9.0, 0.0]}, [{"a": [1.0, 5.0], "b": [2.0, 1.0]}, {}, {}, {}, {}])
    s, rng = L.Scorer(m, cache=100), random.Random(1)
    free = L.Scorer(m)
    for _ in range(300):
        text = " ".join("".join(rng.choice(letters) for _ in range(12)) for _ in range(40))
        assert s([text]) == free([text])
        assert len(s.index) <= 100 + 40 and s.n <= 100 + 42
