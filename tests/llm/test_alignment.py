"""Links and counts against the libraries' tokens, one pair of tokens at a time."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as PT
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wavelake.llm import alignment as A
from wavelake.llm import common as C


def texts():
    rng = random.Random(4)
    out = ["it's 1234 words", "", None, "a<|endoftext|>b <s>x</s>", "lit▁eral", "🙂 é½ ﬁ　x\t\ty\r\nz", "  two  blanks  ", " ", "   ", "x" * 200, "\x00\x1c", "�", "the the the the the " * 30]
    ranges = [(1, 128), (32, 48), (97, 110), (128, 0x300), (0x370, 0x3000), (0x10000, 0x1FFFF)]
    return out + ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(80))) for _ in range(150)]


def plain(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each row, by loops over tokens."""
    lib = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PT.path("piece_bpe_32k.model"))
    letters = {}
    for b in range(256):
        plain_byte = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        letters[chr(b) if plain_byte else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255) for x in range(b)))] = b
    told = []
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        a = lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        a_raw = [bytes(letters[c] for c in lib.id_to_token(x)) for x in a]
        b_raw = [bytes([int(p[3:5], 16)]) if model.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [model.id_to_piece(x)]]
        if not t or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            told.append((i, [], [], [], ""))
            continue
        span = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        sa, sb = span(a_raw), span(b_raw)
        links = [(x, y) for x, (s, e) in zip(a, sa) for y, (u, v) in zip(b, sb) if s < v and u < e]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for e in ends:
            pick = lambda ids, at: ",".join(str(x) for x, (_, z) in zip(ids, at) if low < z <= e)  # noqa: E731, B023
            groups.append(pick(a, sa) + "|" + pick(b, sb))
            low = e
        told.append((i, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest(), len(groups)))
    count = Counter(p for x in told for p in x[3])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [
        (x[0], len(x[1]), len(x[2]), x[5] if len(x) > 5 else 0, len(x[3]), sum(count[p] == most[p[1]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) for x in told
    ], count, Counter(p for x in told for p in set(x[3]))


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("slots, links, together", [(8192, 6_000_000, 1 << 21), (16, 6_000_000, 1 << 21), (8192, 300, 200)])
def test_equals_loops_over_tokens(spark, slots, links, together):
    sizes = {"slots": slots, "most_links": links, "together": together}
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts())] * 2
    want, count, docs = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pair", "'x' AS slot", "2 AS n_best", "3 AS n_a").repartition(3)
    got = A.align(df, **sizes).collect()
    assert sorted(map(str, (tuple(r[c] for c in COLUMNS) for r in got))) == sorted(map(str, want))
    assert all((r.pair, r.slot) == (1, "x") for r in got)
    pairs = A.pair_counts(C.stage(A.invert(df, **sizes), "t")).collect()
    assert {(r.a_id, r.b_id): (r.n_links, r.n_docs) for r in pairs} == {p: (n, docs[p]) for p, n in count.items()}


@pytest.mark.parametrize("share", [0.001, 0.05, 0.9])
def test_bitmaps(share):
    rng = np.random.default_rng(1)
    sets = [np.nonzero(rng.random(A.SLOTS) < share * rng.random())[0] for _ in range(50)] + [np.array([0]), np.array([8191]), np.arange(8192), np.array([0, 128, 257, 8191])]
    sets = [s for s in sets if len(s)]
    data, ends = A.pack(np.concatenate(sets), np.array([len(s) for s in sets]))
    slots, per = A.unpack(data, np.concatenate([[0], ends]))
    assert per.tolist() == [len(s) for s in sets] and np.array_equal(slots, np.concatenate(sets))
    assert ends[-1] <= len(sets) * (1 + A.SLOTS // 8)


def test_parts_of_a_container_are_or_ed():
    box = A.Container(0)
    box.add(np.array([5, 5, 5, 9]), np.array([0, 0, 1, 1]))
    box.add(np.array([5, 9, 9, 9]), np.array([2, 2, 2, 2]))
    got = box.postings()
    rows = list(zip(got["pair"].tolist(), got["plane"].tolist(), got["docs"].tolist(), got["links"].tolist(), strict=True))
    assert rows == [(5, 0, 3, 2), (5, 1, 0, 2), (9, 0, 2, 2), (9, 1, 0, 2)]


def test_empty(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r[c] for c in COLUMNS[1:]) for r in A.align(nothing).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
