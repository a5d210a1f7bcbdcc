"""Files that queries write and read back are whole where Spark joins small partitions: one file for each kind, its head first."""

import duckdb
import pytest

from wavelake.plans import registry

D = "/root/testdata/sf0.01"
NAMES = ["s05_header_settings", "s06_header_exports", "s06_pruned_columns", "s09_plain_tables", "s11_metadata"]


@pytest.fixture
def small_partitions(spark):
    made = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in made}
    for k, v in made.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", NAMES)
def test_files_are_whole_where_partitions_are_joined(spark, small_partitions, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{D}/events.parquet'")
    c.register("got", registry.queries()[name](spark, D).toArrow())
    cols = lambda t: ", ".join(f"round({x[0]}, 4) + 0.0" if x[1] == "DOUBLE" else x[0] for x in c.execute(f"DESCRIBE {t}").fetchall())
    c.execute(f"CREATE TABLE want AS {registry.oracle_sql()[name]}")
    got, want = (f"SELECT {cols('want')} FROM {t}" for t in ("got", "want"))
    for a, b in ((got, want), (want, got)):
        assert c.execute(f"{a} EXCEPT ALL {b}").fetchall() == []
