"""Tokens of chunked texts against the library's for the whole text."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as PT
import pytest
import tiktoken
from tokenizers import Regex, Tokenizer, pre_tokenizers

from wavelake.llm import chunked_bpe as B
from wavelake.llm import common as C
from wavelake.llm import pieces as P


@pytest.fixture(scope="module")
def lib():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PT.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n=400):
    rng = random.Random(5)
    out = ["", " ", "it's DON'T'll we've 'd''s \"'s '", "a<|endoftext|>b", "\x1c\x85y​q　 ", "🙂👨‍👩‍👧 é½²٣", "\r\n\n  \t x  ", "'s't're'll  'x \n's", "x" * 70 + "ab" * 50]
    ranges = [(1, 128), (32, 48), (9, 14), (128, 0x300), (0x370, 0x3000), (0x3000, 0xD7FF), (0x10000, 0x1FFFF)]
    out += ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(60))) for _ in range(n)]
    return out + ["".join(rng.choice("'sltmdrev aA1.\n\t \"é") for _ in range(rng.randrange(60))) for _ in range(n)]


def test_classes_are_those_of_both_libraries():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, p in ((P.LETTER, r"\p{L}+"), (P.NUMBER, r"\p{N}+"), (P.SPACE, r"\s+")):
        found = "".join(x for x, _ in pre_tokenizers.Split(Regex(p), "removed", invert=True).pre_tokenize_str(every))
        assert np.array_equal(P.code_points(found), np.nonzero(P.classes() == kind)[0])


def test_pieces_equal_the_libraries(lib):
    some = texts(3000)
    assert [np.frombuffer(x, "<u4").tolist() for x in B._encoded(P.from_ranks(B._ranks_path()), some)] == [lib.encode_ordinary(t) for t in some]
    merges = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    merges.encode_special_tokens = True
    got = B._encoded(P.from_merges(PT.path("byte_bpe_50k.json")), some)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [merges.encode(t, add_special_tokens=False).ids for t in some]


def test_long_pieces(lib):
    bpe = P.from_ranks(B._ranks_path())
    for t in ["a" * 3000, "ab" * 1000 + "é" * 500, "thequickbrownfox" * 200, "\n" * 999, "=" * 777]:
        assert np.frombuffer(B._encoded(bpe, [t])[0], "<u4").tolist() == lib.encode_ordinary(t)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(C, "word_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    first, which = P.distinct(C.padded(b"abcabcab"), np.array([0, 3, 6]), np.array([3, 6, 8]))
    assert which.tolist() == [0, 0, 1] and first.tolist() == [0, 2]


def test_one_scan_over_chunks():
    rng = random.Random(8)
    for t in [*texts(), "x" * 500 + " y" * 9, "  \n" * 70 + "z"]:
        for size in (5, 17, 64):
            chunks = [t[k : k + size] for k in range(0, len(t), size)]
            assert B.starts_in_order(chunks).tolist() == B.starts_of(t).tolist()
        del rng
        rng = random.Random(8)


@pytest.mark.parametrize("chunk, overlap", [(37, 11), (64, 32), (20, 4)])
def test_chunks_give_the_tokens_of_the_whole_text(spark, lib, chunk, overlap):
    some = texts(60) + ["a long text, it's said, of many words and 1234 numbers " * 30, "blob" * 200 + " tail's end", "w" * 36 + " 's " * 40, "\n \n" * 100, "x'll" * 99, None]
    data = [(i if i % 7 else None, t) for i, t in enumerate(some)] * 2
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'k' AS key", "doc_id AS no", "1 AS ids", "2 AS a_b").repartition(5)
    sizes = {"chunk": chunk, "overlap": overlap}
    got = B.encode(df, **sizes).collect()
    want = [(i, t, lib.encode_ordinary(t or "")) for i, t in data]
    assert sorted(map(str, ((r.doc_id, r.text, r.ids) for r in got))) == sorted(map(str, want))
    assert {(r.key, r.a_b, r.no == r.doc_id) for r in got if r.doc_id is not None} == {("k", 2, True)}
    back = B.decode_bytes(B.encode_bytes(df, **sizes)).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back) and len(back) == len(data)
    assert B.decode_bytes(B.encode(df, **sizes)).where("decode(decoded, 'utf-8') <=> coalesce(text, '')").count() == len(data)


def test_seams_of_ordinary_chunks_are_found(spark):
    df = spark.createDataFrame([(0, "words of an ordinary text " * 200)], "doc_id long, text string")
    cut = C.stage(B._pretokenised(B._cut_chunks(df, "text", ["doc_id"], 200, 40), 200, 40), "t")
    got = B.seams(cut).collect()
    assert len(got) == cut.count() - 1 and all(r.no * 200 <= r.seam < r.no * 200 + 40 for r in got)


def test_query_columns(spark, lib, tmp_path):
    some = [(1, "it's"), (2, None), (None, "words " * 6000), (3, "")]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {(i, len(ids := lib.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for i, t in some}
    assert set(map(tuple, B.op13_byte_bpe(spark, str(tmp_path)).collect())) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.encode(df).count() == 0 and B.decode_bytes(B.encode_bytes(df)).count() == 0
