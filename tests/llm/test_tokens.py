import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from wavelake.llm import bpe as B
from wavelake.llm import token_tables as T


def texts():
    rng = random.Random(1)
    out = ["", "hello world", "a<|endoftext|>b  c<|endoftext|>", "\x1c\x1d x\x85y z​q 　", "🙂👨‍👩‍👧 é½²٣ ١ it's DON'T'll", "\r\n\n  \t x", "aaaa" * 500, "İstanbul ẞ Σς ’s ½²", "<|startoftext|> x", "the cat " * 4000]
    ranges = [(1, 128), (128, 0x300), (0x370, 0x3000), (0x10000, 0x1FFFF)]
    return out + ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(60)) for _ in range(150)]


@pytest.fixture(scope="module")
def byte_lib():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_trie_equals_the_library(byte_lib, monkeypatch):
    monkeypatch.setattr(B, "MOST_NODES", 300)
    monkeypatch.setattr(B, "MOST_WORDS", 40)
    bpe = B.TrieBPE(P.path("byte_bpe_50k.json"))
    for t in texts():
        ids = byte_lib.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == ids
        assert bpe.decode(ids) == byte_lib.decode(ids, skip_special_tokens=False)


def test_trie_shares_prefixes():
    bpe = B.TrieBPE(P.path("byte_bpe_50k.json"))
    bpe.learn(["walk", "walked", "walker", "walking"])
    assert len(bpe.last) == 1 + len("walk") + len("ed") + len("r") + len("ing")


def test_op9_columns(spark, byte_lib):
    data = [(i, t) for i, t in enumerate(texts())] + [(900, None), (None, "no id"), (7, "twice")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS decoded")
    got = sorted(map(str, map(tuple, B.digests(B.encode(df.drop("decoded"), decoded=True)).collect())))
    want = []
    for i, t in data:
        ids = byte_lib.encode(t or "", add_special_tokens=False).ids
        text = byte_lib.decode(ids, skip_special_tokens=False)
        want.append(str((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())))
    assert got == sorted(want)
    again = B.decode(B.encode(df.drop("decoded"))).collect()
    assert {(r.doc_id, r.decoded) for r in again} == {(i, t or "") for i, t in data}


def test_word_ids_equal_the_library():
    path = P.path("word_bpe_49k.json")
    lib, enc = Tokenizer.from_file(path), T.WordEncoder(path)
    assert enc.by_piece
    got = enc(texts())
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts()]


def test_shard_files_and_lookup(tmp_path):
    path = str(tmp_path / "x" / "s.sst")
    w = T.ShardWriter(path, 2)
    rng = np.random.default_rng(0)
    want = {}
    for i, c in [(None, 0), (None, 1), *((i, 0) for i in range(-500, 4000, 3))]:
        ids = rng.integers(0, 49408, int(rng.integers(0, 200))).astype("<u2")
        want.setdefault(i, []).append(ids)
        w.add(T.make_key(i, c), ids.tobytes())
    w.close()
    r = T.ShardReader(path)
    assert len(r.index) > 3 and r.docs == sum(map(len, want.values()))
    for i, ids in want.items():
        assert [x.tolist() for x in r.get(i)] == [x.tolist() for x in ids]
    assert r.get(1_000_000) == [] and sum(r._may_hold(T.make_key(i)) for i in range(10_000, 12_000)) < 100
    keys = [k for k, _, _ in r]
    assert keys == sorted(keys)
    data = bytearray(open(path, "rb").read())
    data[-60] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        T.ShardReader(path)


@pytest.mark.parametrize("rows", [20_000, 20])
def test_round_trip(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(T, "SHARD_ROWS", rows)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    data = [(i * 3 % 101, f"text number {i}") for i in range(101)] + [(50, f"hot {i}") for i in range(80)] + [(None, "no id"), (200, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS shard").repartition(5)
    manifest = T.save(df, str(tmp_path / "out"))
    got = T.entry_digests(T.read_shards(spark, manifest)).orderBy("start").collect()
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if i is None else i for i, _ in data)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted(str((r.doc_id, r.ids_crc32)) for r in got) == sorted(str((i, crc(t))) for i, t in data)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_shards(spark, T.save(df, str(tmp_path / "none"))).count() == 0
    assert B.encode(df, decoded=True).count() == 0
