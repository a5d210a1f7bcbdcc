"""Columns that are not wanted stay unread; exact quantiles; stamps."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.operators import resampling as R
from wavelake.sources import readers, writers


def test_only_wanted_columns_are_in_the_scan(spark, tmp_path):
    (tmp_path / "s 1").mkdir()
    body = lambda names, rows: "\n".join(["%OpenBCI Raw EXG Data", "%Sample Rate = 250 Hz", names, *rows]) + "\n"
    (tmp_path / "s 1" / "a.txt").write_text(body("Sample Index, EXG Channel 0, EXG Channel 1, Other, Other, Timestamp", [f"{i}, {i}.5, {-i}, x, y, {i * 4}" for i in range(5)]))
    (tmp_path / "b.txt").write_text(body("Sample Index, EXG Channel 1, Timestamp (Formatted)", ["0, 7, 2024-01-01", "1, bad, 2024-01-01"]))
    got = readers.read_columns(spark, str(tmp_path), ["EXG Channel 1", "Timestamp"])
    plan = got._jdf.queryExecution().toString()
    schemas = [x.split("\n")[0] for x in plan.split("ReadSchema: ")[1:]]
    assert schemas and all("EXG Channel 0" not in x and "Other" not in x and "Sample Index" not in x for x in schemas) and any("EXG Channel 1:double" in x for x in schemas)
    rows = sorted(((r.recording_id, r["EXG Channel 1"], r.Timestamp) for r in got.collect()), key=str)
    assert rows == sorted([("s 1/a.txt", float(-i), float(i * 4)) for i in range(5)] + [("b.txt", 7.0, None), ("b.txt", None, None)], key=str)
    assert readers.read_columns(spark, str(tmp_path), ["None such"]).where("`None such` IS NOT NULL").count() == 0


def test_order_statistics_equal_numpy(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=501), "b": np.repeat([1.0, 2.0], 300), "one": np.array([4.0]), None: rng.gamma(2, size=40)}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(6)
    got = {r.k: r for r in R.order_statistics(df, ["k"], {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    scale = {r.k: r for r in R.robust_scale(df, ["k"]).collect()}
    for k, x in values.items():
        assert [got[k].low, got[k].mid, got[k].top] == pytest.approx([np.quantile(x, 0.1), np.median(x), x.max()])
        assert [scale[k].median, scale[k].mad] == pytest.approx([np.median(x), 1.4826 * np.median(np.abs(x - np.median(x)))])
    assert got["none"].mid is None and R.order_statistics(df, [], {"mid": 0.5}).first().mid == pytest.approx(np.median(np.concatenate(list(values.values()))))


def test_stamps(spark):
    at = F.lit(datetime.datetime(2024, 2, 9, 3, 4, 5))
    r = spark.range(1).select(writers.stamp(at).alias("s"), writers.stamped_name(F.lit("up/my  file.csv"), at).alias("n"), writers.stamp().alias("now")).first()
    assert (r.s, r.n) == ("20240209_030405", "20240209_030405_my_file.csv") and len(r.now) == 15
