"""Recovery where a window is at the very edge of the tolerance."""

import duckdb
from pyspark.sql import functions as F

from wavelake.operators import recovery as R
from wavelake.plans import registry

# their mean, added up in order, is 43.10000000000001, so 4.31 is less than its tenth but not than (1 - 0.9) times it
STEADY = [4.96, 47.74, 25.73, 32.77, 60.68, 63.78, 85.38, 53.13, 15.96, 67.1, 56.59, 20.71, 94.2, 10.63, 7.14]


def table(tmp_path):
    """One user: steady windows from 5 to 19; recovery starts at 30 and has the value at the edge second; squares are too small throughout."""
    values = [43.1] * 5 + STEADY + [43.1] * 10 + [6.0, 4.31] + [6.0] * 5
    d = tmp_path / "in"
    d.mkdir()
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, TIMESTAMP '2024-01-01' + to_seconds(?), 7, 'click', ?, '{}')", [(i, i, v) for i, v in enumerate(values)])
    c.execute(f"COPY events TO '{d}/events.parquet' (FORMAT parquet)")
    return str(d), c


def test_overall_recovery_at_the_edge_of_the_tolerance(spark, tmp_path):
    d, c = table(tmp_path)
    name = "a23_overall_recovery"
    got = [(r.user_id, r.recovery_time, r.n_unrecovered) for r in registry.queries()[name](spark, d).collect()]
    assert got == c.execute(f"SELECT user_id, recovery_time, n_unrecovered FROM ({registry.oracle_sql()[name]})").fetchall() == [(7, 6.0, 1)]


def test_baseline_adds_up_windows_in_order_however_rows_come(spark):
    rows = [(k, "alpha_rel", i, float(i), x) for k in range(40) for i, x in enumerate(STEADY[k % 15 :] + STEADY[: k % 15])]
    df = spark.createDataFrame(rows, "k long, indicator string, window_idx long, t_sec double, x double").repartition(7, "x")
    phases = spark.range(41).select(F.col("id").alias("k"), F.lit(1.0).alias("steady_start"), F.lit(13.0).alias("steady_end"))
    got = {r.k: r.base for r in R.baseline(df.unionByName(df.sparkSession.createDataFrame([(40, "alpha_rel", 0, 0.0, 1.0)], df.schema)), phases, ["k"]).collect()}
    for k in range(40):
        total = 0.0
        for x in (STEADY[k % 15 :] + STEADY[: k % 15])[1:14]:
            total += x
        assert got[k] == total / 13
    assert got[40] == 0.0


def test_recovery_time_at_the_edge_of_the_tolerance(spark, tmp_path):
    d, c = table(tmp_path)
    name = "w04_recovery_time"
    got = sorted((r.indicator, r.recovery_sec) for r in registry.queries()[name](spark, d).collect())
    assert got == sorted(c.execute(f"SELECT indicator, recovery_sec FROM ({registry.oracle_sql()[name]})").fetchall()) == [("gamma_rel", None), ("theta_alpha_ratio", 6.0)]
