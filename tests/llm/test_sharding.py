import zlib

import numpy as np
import pytest

from wavelake.llm import sharding as H


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 100, 4097])
def test_permutation_and_inverse(n):
    p = H.permute(np.arange(n), n)
    assert sorted(p) == list(range(n))
    assert (H.permute(p, n, back=True) == np.arange(n)).all()


def test_rows_law(spark):
    rows = [(i, f"text {i}", 1) for i in range(101)] + [(None, None, 2), (None, None, 2), (7, "text 7", 1), (8, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").drop("slot").withColumnRenamed("row_number", "r")
    got = H.shuffle_into_shards(df, 8).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b, _ in rows)
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (13, 14)
    for r in got:
        assert (r.shard, r.slot) == H.place(r.row_number, len(rows), 8)
        assert H.row_at(r.shard, r.slot, len(rows), 8) == r.row_number
    again = H.shuffle_into_shards(df.repartition(7), 8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty(spark):
    assert H.shuffle_into_shards(spark.createDataFrame([], "doc_id long"), 8).count() == 0


def test_query_columns(spark):
    d = "/root/testdata/sf0.001"
    got = H.op1_sharding(spark, d).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        b = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
