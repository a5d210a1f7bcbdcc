from datetime import datetime

from wavelake.plans import registry


def test_grid_holds_all_kinds_of_events(spark, tmp_path):
    rows = [(f"kind{k}", datetime(2026, 1, 1 + k % 2, 12), float(k)) for k in range(1100)]
    spark.createDataFrame(rows, "event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["r04_filled_grid"](spark, str(tmp_path)).collect()
    assert len(got) == 2 * 1100 and sum(r.v for r in got) == sum(range(1100))
