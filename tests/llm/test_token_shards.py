import time
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from wavelake.llm import token_tables as T


def test_bisection_is_quick_and_in_order():
    rng = np.random.default_rng(0)
    bounds = np.sort(rng.integers(-(1 << 62), 1 << 62, T.MOST_SHARDS - 1))
    keys = rng.integers(-(1 << 62), 1 << 62, 100_000)
    began = time.time()
    got = T.place(pa.array(keys), [b""] * len(keys), bounds, 0)
    assert time.time() - began < 5
    order = np.argsort(keys, kind="stable")
    assert (np.diff(got[order]) >= 0).all()
    for i in range(0, 100_000, 9973):
        assert got[i] == sum(b < keys[i] for b in bounds)


def test_alike_rows_of_one_id_and_of_none_are_spread():
    low = -(1 << 63)
    bounds = np.array([low] * 4 + [7] * 3 + [100])
    for key, shards in ((None, range(5)), (7, range(4, 8))):
        got = Counter(T.place(pa.array([key] * 1000, pa.int64()), [b"same"] * 1000, bounds, 0).tolist())
        assert set(got) == set(shards) and max(got.values()) < 1000 / len(shards) + 3
    # the least id comes after all nulls
    assert set(T.place(pa.array([low] * 9, pa.int64()), [b"x"] * 9, bounds, 0).tolist()) == {4}


def test_long_texts_repeated_rows_and_hot_nulls_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 10)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.no_truncation()
    rows = [(None, "no id")] * 60 + [(5, "twice the same")] * 60 + [(-(1 << 63), "least"), (9, "long words " * 60_000), (10, "ab" * 100_000), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = T.save(df, str(tmp_path / "out"))
    assert manifest.count() > 5
    got = T.entry_digests(T.read_shards(spark, manifest)).orderBy("start").collect()
    rank = lambda i: (i is not None, i or 0)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=rank)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
