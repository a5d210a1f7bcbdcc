"""The stages of the corpus pipeline one after another against plain computations, with every awkward row at once."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_shingles import shingle_set
from tokenizers import Tokenizer

import corpus_pipeline
from wavelake.llm import mixing as M

STEPS = dict(corpus_pipeline.STAGES)
KIND = "doc_id long, text string, lang string, source string, n_chars long, did int, th int, line int, node int, row int, key int, src int, t int, lang_pred int, ids int"


def documents():
    rng = random.Random(9)
    vocab = {"en": [f"{a}{b}ing" for a in "abcdef" for b in "lmnop"], "de": [f"{a}{b}ung" for a in "ghijk" for b in "rstuv"]}
    prose = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    shared = [prose("en", 12) for _ in range(4)]
    rows = []
    for i in range(70):
        lang = ["en", "de"][i % 2]
        lines = [prose(lang, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        rows.append([i, "\n".join(lines), lang if i % 7 else None, ["big", "big", "small", None][i % 4]])
    long = prose("en", 30_000)
    rows += [[200, long, "en", "big"], [201, None, "en", "big"], [202, "", "de", None], [203, " \n\t", None, None], [204, "123 456", "en", "big"], [None, prose("de", 40), "de", "small"]]
    rows += [list(rows[5]), list(rows[5]), [300, rows[8][1], "en", "small"], [None, None, None, None], [301, rows[10][1] + "\n", "en", "void"]]
    return [(i, t, lang, s, len(t or ""), *range(10)) for i, t, lang, s in rows]


def show(rows):
    return sorted(str(tuple(r)) for r in rows)


def brute_lines(rows, hashes):
    """Texts without the lines that an earlier line, in the order of (id, hash of the text, place), equals or nearly equals."""
    seen, made = [], {}
    for i, t in sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0, hashes.get(x[1], 0))):
        if t is None:
            made[i, t] = None
            continue
        keep = []
        for line in t.split("\n"):
            w = frozenset(line.encode().lower().split())
            gone = bool(w) and any(len(w & s) >= 0.8 * len(w | s) - 1e-9 for s in seen)
            if w:
                seen.append(w)
            if not gone:
                keep.append(line)
        made[i, t] = "\n".join(keep)
    out = []
    for r in rows:
        text = made[r[0], r[1]]
        out.append((r[0], text, *r[2:4], len(text) if text is not None and text != r[1] else r[4], *r[5:]))
    return out


def brute_near(rows):
    """One row of each component of equal or similar texts: that with the least id (null last)."""
    sets, label = [shingle_set(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and (a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    best = {}
    for k, r in enumerate(rows):
        best.setdefault(label[k], []).append((r[0] is None, r[0] or 0))
    return Counter(str(None if n else i) for n, i in (min(v) for v in best.values()))


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.createDataFrame(documents(), KIND).repartition(5)
    out = [docs]
    for _, step in corpus_pipeline.STAGES:
        out.append(step(spark, out[-1], ""))
    return [[tuple(r) for r in d.collect()] for d in out[:-1]], out


def test_language(steps):
    held = [r for r in steps[0][0] if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert show(steps[0][1]) == show(held)


def test_lines(spark, steps):
    texts = sorted({r[1] for r in steps[0][1]})
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    assert show(steps[0][2]) == show(brute_lines(steps[0][1], hashes))


def test_near_duplicates(steps):
    assert Counter(str(r[0]) for r in steps[0][3]) == brute_near(steps[0][2])
    assert not Counter(steps[0][3]) - Counter(steps[0][2])


def test_mixing(steps):
    before, after = steps[0][3], steps[0][4]
    assert set(after) <= set(before)
    tokens, drawn = Counter(), Counter()
    for r in before:
        tokens[r[3]] += len((r[1] or "").split())
    for r in after:
        drawn[r[3]] += len((r[1] or "").split())
    import numpy as np

    names = sorted(tokens, key=lambda s: (tokens[s], s is not None, s or ""))
    n = np.array([tokens[s] for s in names])
    want = dict(zip(names, M.budgets(n, M.choose_alpha(n, int(n.sum())), int(n.sum())), strict=True))
    longest = {s: max(len((r[1] or "").split()) for r in before if r[3] == s) for s in names}
    assert all(want[s] <= drawn[s] < want[s] + max(longest[s], 1) or want[s] == drawn[s] == 0 for s in names)


def test_tokens(steps):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    lib.no_truncation()
    want = []
    for r in steps[0][4]:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert show(steps[1][-1].collect()) == show(want)


@pytest.mark.parametrize("name", list(STEPS))
def test_empty_tables(spark, name):
    out = STEPS[name](spark, spark.createDataFrame([], KIND), "")
    assert out.count() == 0 and (name == "bpe" or out.columns == [c.split()[0] for c in KIND.split(", ")])


def test_columns_are_kept(steps):
    assert all(d.columns == steps[1][0].columns for d in steps[1][1:-1])
