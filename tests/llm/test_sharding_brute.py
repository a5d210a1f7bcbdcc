"""Placement against a plain Feistel network over numbers counted by hand, and rows that repeat very often."""

from collections import Counter

import numpy as np

from wavelake.llm import sharding as H

M = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 33)) * 14029467366897019727 & M
    x = (x ^ (x >> 29)) * 1609587929392839161 & M
    return x ^ (x >> 32)


def plain(row, n, seed):
    """One number at a time, with whole Python integers."""
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    high = bits - low
    keys = [mix(k + seed) for k in range(1, H.ROUNDS + 1)]
    x = row
    while True:
        lo, hi = x % (1 << low), x >> low
        for r in range(H.ROUNDS):
            if r % 2 == 0:
                hi ^= mix(lo ^ keys[r]) % (1 << high)
            else:
                lo ^= mix(hi ^ keys[r]) % (1 << low)
        x = (hi << low) | lo
        if x < n:
            return x


def test_shards_and_slots_equal_a_plain_network(spark):
    rows = [(i * 17 % 1000, f"t{i}") for i in range(700)] + [(5, "same")] * 40 + [(None, None)] * 30 + [(9, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = H.shuffle_into_shards(df, 8).collect()
    n = len(rows)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert sorted(r.row_number for r in got) == list(range(n))
    # rows are numbered in order of their columns within a bucket; there is one bucket here
    rank = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")
    assert [rank(r) for r in sorted(got, key=lambda r: r.row_number)] == sorted(map(rank, got))
    for r in got:
        p = plain(r.row_number, n, H.SEED)
        assert (r.shard, r.slot) == (p % 8, p // 8)


def test_a_row_with_many_copies_is_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(H, "RANGE", 10)
    rows = [(None, None)] * 1234 + [(1, "a")] * 10 + [(2, "b")] * 11 + [(3, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = H.shuffle_into_shards(df, 8).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert H.permute(np.arange(7), 7).tolist() == [plain(i, 7, H.SEED) for i in range(7)]
