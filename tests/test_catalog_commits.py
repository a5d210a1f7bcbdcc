"""Writers that read the same version: none is lost."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from wavelake import schema as S
from wavelake.sources import writers


def test_of_two_writers_one_reads_anew(spark, tmp_path):
    path = str(tmp_path / "c")
    a, b = writers.Catalog(spark, path), writers.Catalog(spark, path)
    real, done = a.log.put, []

    def late(n, tables):
        if not done:
            done.append(b.add_subject("from b"))  # comes between a's reading and its commit
        real(n, tables)

    a.log.put = late
    assert done == [] and a.add_subject("from a") == 2 and done == [1]
    assert {r.code for r in a.subjects().collect()} == {"from a", "from b"}
    with pytest.raises(writers.Conflict):
        b.log.put(1, {})


def test_many_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "c d")
    first = writers.Catalog(spark, path).add_subject("s")
    with ThreadPoolExecutor(3) as pool:
        ids = list(pool.map(lambda i: writers.Catalog(spark, path).add_experiment(first, f"c{i}"), range(5)))
    c = writers.Catalog(spark, path)
    assert sorted(ids) == [1, 2, 3, 4, 5] and sorted(r.condition for r in c.experiments().collect()) == [f"c{i}" for i in range(5)]
    n, before = c.log.latest()
    c.delete_subject(first)
    assert c.log.latest()[0] == n + 1 and c.experiments().count() == c.subjects().count() == 0
    assert len(before["experiments"]) == 5  # adding wrote new rows alone


def test_a_catalog_from_before_the_log_goes_on(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(4, "old", 30, None, "2024-01-01 00:00:00")], S.SUBJECTS).write.parquet(f"{path}/subjects/v7")
    spark.createDataFrame([("subjects", 7)], "name string, version long").write.parquet(f"{path}/versions")
    c = writers.Catalog(spark, path)
    assert c.add_subject("new") == 5 and {r.code for r in c.subjects().collect()} == {"old", "new"}
    with pytest.raises(ValueError):
        c.add_subject("old")
