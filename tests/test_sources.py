import datetime as dt

import numpy as np
import pytest

from wavelake.sources import readers, scratch, synthetic, writers
from wavelake.streaming import live


def board_lines(n_cols, n, fs, sep=",", header=True):
    out = [sep.join(str(i) for i in range(n_cols))] if header else []
    for i in range(n):
        row = [str(i % 256)] + [f"{np.sin(i):.3f}"] * (n_cols - 3) + [f"{i / fs:.6f}", "1" if i == 5 else "2" if i == 8 else "0"]
        out.append(sep.join(row))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    odf = ["%OpenBCI Raw EXG Data", "%Number of channels = 4", "%Sample Rate = 200 Hz", "%Board = OpenBCI_GUI$BoardGanglionBLE"]
    odf.append("Sample Index, EXG Channel 0, EXG Channel 1, EXG Channel 2, EXG Channel 3, Accel Channel 0, Accel Channel 1, Accel Channel 2, Timestamp, Marker Channel, Timestamp (Formatted)")
    odf += [f"{i}, {i}.5, 2, 3, 4, 0, 0, 1, {1557936889064 + 5 * i}, {7 if i == 3 else 0}, 12:14:49.064" for i in range(20)]
    (d / "odf.txt").write_text("\n".join(odf))
    (d / "cyton.csv").write_text("\n".join([*board_lines(24, 100, 250), "1,2,-"]))
    (d / "ganglion.csv").write_text("\n".join(board_lines(15, 30, 200, "\t", header=False)))
    (d / "ten.txt").write_text("\n".join(board_lines(10, 20, 100, "\t", header=False)))
    (d / "plain.csv").write_text("\n".join(["time,ch1,ch2", *(f"{i * 0.004:.3f},{i},{i * 2}" for i in range(50))]))
    (d / "session.csv").write_text("\n".join(["Index\tEXG0\tEXG1\tAccel_X\tAccel_Y\tAccel_Z\tTimestamp\tMarker", *(f"{i}\t{i}\t1\t0\t0\t1\t{1700000000000 + 10 * i}\t{3 if i == 2 else 0}" for i in range(10))]))
    (d / "ignored.bin").write_bytes(b"\x00\x01")
    return str(d)


def test_formats_and_recordings(spark, folder):
    rows = scratch.staged(readers.load(spark, folder), "rows")
    got = {r.recording_id: r for r in readers.recordings(rows).collect()}
    seen = {k: (r.format, r.board, r.fs, r.n_channels, r.n_samples, r.has_accelerometer, r.has_markers) for k, r in got.items()}
    assert seen == {
        "odf.txt": ("odf", "ganglion", 200, 4, 20, True, True),
        "cyton.csv": ("board", "cyton", 250, 8, 100, True, True),
        "ganglion.csv": ("board", "ganglion", 200, 4, 30, True, True),
        "ten.txt": ("board", "unknown", 100, 2, 20, True, True),
        "plain.csv": ("plain", "unknown", 250, 2, 50, False, False),
        "session.csv": ("session", "unknown", 100, 2, 10, True, True),
    }
    assert got["odf.txt"].channels == ["EXG_0", "EXG_1", "EXG_2", "EXG_3"] and got["plain.csv"].channels == ["ch1", "ch2"]
    marks = {(r.recording_id, r.event_id) for r in readers.markers(rows).collect()}
    assert marks >= {("odf.txt", "marker_7"), ("cyton.csv", "marker_1"), ("cyton.csv", "marker_2"), ("session.csv", "marker_3")}
    long = readers.samples(rows)
    assert long.where("recording_id = 'odf.txt' AND channel_idx = 0 AND sample_idx = 3").first().value == 3.5
    assert readers.accel(rows).where("recording_id = 'session.csv'").count() == 10
    wide = writers.wide(long.where("recording_id = 'plain.csv'"), ["ch1", "ch2"]).orderBy("time").collect()
    assert (wide[7].time, wide[7].ch1, wide[7].ch2) == (0.028, 7.0, 14.0)


def test_events_resolution(spark, tmp_path):
    (tmp_path / "e.csv").write_text("event_id,timestamp\nX0,1.5\n")
    given = readers.events(spark, str(tmp_path / "e.csv")).selectExpr("'a' AS recording_id", "event_id", "t_sec")
    found = spark.createDataFrame([("a", "marker_1", 2.0), ("b", "marker_2", 3.0)], "recording_id string, event_id string, t_sec double")
    recs = spark.createDataFrame([("a",), ("b",), ("c",)], "recording_id string")
    default = spark.createDataFrame([("S0", 0.0)], "event_id string, t_sec double")
    got = sorted(map(tuple, readers.resolved_events(recs, given, found, default).collect()))
    assert got == [("a", "X0", 1.5), ("b", "marker_2", 3.0), ("c", "S0", 0.0)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.events(spark, str(tmp_path / "bad.csv"))


def test_catalog(spark, tmp_path):
    c = writers.Catalog(spark, str(tmp_path / "catalog"))
    a, b = c.add_subject("S1", 30), c.add_subject("S2")
    with pytest.raises(ValueError):
        c.add_subject("S1")
    e = c.add_experiment(a, "AtoB")
    c.add_experiment(b, "AtoC")
    c.update_subject(b, age=41)
    c.set_status(e, "done")
    assert {(r.subject_code, r.condition, r.analysis_status, r.source) for r in c.experiments().collect()} == {("S1", "AtoB", "done", "upload"), ("S2", "AtoC", "pending", "upload")}
    c.delete_subject(b)
    assert [r.code for r in c.subjects().collect()] == ["S1"] and c.experiments().count() == 1


def test_json_and_bundle(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "condition string, x double")
    assert sorted(r.json for r in writers.to_json(df).collect()) == ['{"condition":"a","x":null}', '{"condition":"b","x":1.0}']
    assert writers.bundle(df, "# report")[:2] == b"PK"


def test_generated_recording_does_not_depend_on_partitions(spark):
    one = synthetic.recordings(spark, [("A", 1.0, 7)], 100, 5.0, 2, block=200)
    rows = {(r.channel_idx, r.sample_idx): r.value for r in one.collect()}
    assert len(rows) == 1000 and rows == {(r.channel_idx, r.sample_idx): r.value for r in one.repartition(3).collect()}


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i % 2, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), float((i * 37) % 100)) for i in range(60)]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "k long, seq long, ts timestamp, v double")
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = live.flow_state(stream.selectExpr("k", "seq", "v > 80 AS enter", "v < 10 AS leave"), "k", "seq").writeStream.format("memory").queryName("flow_states").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.k, r.seq): r.state for r in spark.sql("SELECT * FROM flow_states").collect()}
    state, want = {}, {}
    for k, seq, _, v in rows:
        state[k] = "entered" if v > 80 else "exited" if v < 10 else state.get(k, "idle")
        want[k, seq] = state[k]
    assert got == want
    q = live.windowed(stream, ["k"], "v", "20 seconds", "10 seconds").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = live.windowed(df, ["k"], "v", "20 seconds", "10 seconds")
    assert sorted(map(str, spark.sql("SELECT * FROM win").collect())) == sorted(map(str, batch.collect()))
