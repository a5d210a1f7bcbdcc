"""Samples of one long recording are dealt over many tasks and numbered as one."""

import pytest
from pyspark.sql import functions as F

from wavelake.sources import readers

N = 24_593


@pytest.fixture
def apart(spark):
    made = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "100k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in made}
    for k, v in made.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def line(fmt, i):
    t = 100 + i / 125
    if fmt == "plain":
        return f"{t},{i}.5"
    if fmt == "session":
        return f"{i}\t{i}.5\t{t * 1000}\t{3 if i == 9000 else 0}"
    if fmt == "odf":
        return f"{i % 256}, {i}.5, {t * 1000}, 0"
    return ",".join([str(i % 256), f"{i}.5", *["0"] * 8, str(t), "0"])  # twelve columns: a width that no board has


HEADS = {"plain": "time,ch1\n", "session": "Index\tEXG0\tTimestamp\tMarker\n", "odf": "%OpenBCI Raw EXG Data\n%Number of channels = 1\n%Sample Rate = 125 Hz\nSample Index, EXG Channel 0, Timestamp, Marker Channel\n", "board": ",".join(map(str, range(12))) + "\n"}


@pytest.mark.parametrize("fmt", sorted(HEADS))
def test_a_recording_is_no_task(spark, apart, tmp_path, fmt):
    (tmp_path / "long.txt").write_text(HEADS[fmt] + "".join(f"{line(fmt, i)}\n" for i in range(N)))
    (tmp_path / "short.txt").write_text(HEADS[fmt] + f"{line(fmt, 7)}\n")
    rows = readers.load(spark, str(tmp_path), fmt).select("recording_id", "fs", "sample_idx", "wall_sec", F.get("exg", F.lit(0)).alias("x"), F.spark_partition_id().alias("task"))
    got = rows.collect()
    mine = sorted((r for r in got if r.recording_id == "long.txt"), key=lambda r: r.sample_idx)
    assert [r.sample_idx for r in mine] == list(range(N)) and [r.x for r in mine] == [i + 0.5 for i in range(N)]
    assert {r.fs for r in mine} == {125} and all(abs(r.wall_sec - i / 125) < 1e-6 for i, r in enumerate(mine))
    assert [(r.sample_idx, r.wall_sec, r.x) for r in got if r.recording_id == "short.txt"] == [(0, 0.0, 7.5)]
    tasks = [r.task for r in mine]
    assert max(tasks.count(t) for t in set(tasks)) < N * 0.8
