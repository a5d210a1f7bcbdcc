import json

import pytest

from wavelake.sources import readers


def test_files_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    for k, sub in enumerate(("s1", "s2")):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "rec.csv").write_text("\n".join(["time,ch1", *(f"{i * 0.004:.3f},{i + 1000 * k}" for i in range(40))]))
    rows = readers.load(spark, str(tmp_path))
    got = {}
    for r in readers.samples(rows).collect():
        got.setdefault(r.recording_id, {})[r.sample_idx] = r.value
    assert got == {f"{s}/rec.csv": {i: float(i + 1000 * k) for i in range(40)} for k, s in enumerate(("s1", "s2"))}
    one = readers.samples(readers.load(spark, str(tmp_path / "s1" / "rec.csv")))
    assert {r.recording_id for r in one.collect()} == {"rec.csv"}


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("\n".join(["time,ch1", *(f"{i * 0.004:.3f},{i}" for i in range(30_000))]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        text = readers.lines(spark, str(tmp_path))
        assert text.select("line_no.split").distinct().count() > 5
        got = readers.samples(readers.load(spark, str(tmp_path))).orderBy("sample_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.value for r in got] == [float(i) for i in range(30_000)]


def test_metadata_of_each_format(spark, tmp_path):
    board = lambda n, rows, head: "\n".join(([",".join(map(str, range(n)))] if head else []) + [",".join(["1.5"] * n) for _ in range(rows)])
    (tmp_path / "cyton.csv").write_text(board(24, 500, True))
    (tmp_path / "odd.csv").write_text(board(12, 250, False))
    (tmp_path / "plain.csv").write_text("time,Fp1,Fp2\n" + "\n".join("0,1,2" for _ in range(25)))
    got = {r.recording_id: r for r in readers.info(spark, str(tmp_path)).collect()}
    seen = {k: (r.format, r.board, r.fs, r.n_channels, r.header_lines, r.n_samples, r.duration_sec, r.has_accelerometer) for k, r in got.items()}
    assert seen == {"cyton.csv": ("board", "cyton", 250, 8, 1, 500, 2.0, True), "odd.csv": ("board", "unknown", 250, 3, 0, 250, 1.0, True), "plain.csv": ("plain", "unknown", 250, 2, 1, 25, 0.1, False)}
    assert got["plain.csv"].channels == ["Fp1", "Fp2"] and got["cyton.csv"].channels == [f"EXG_{i}" for i in range(8)]
    assert got["cyton.csv"].size_kb == pytest.approx((tmp_path / "cyton.csv").stat().st_size / 1024)


def test_assignments_and_their_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"filename": "x.csv", "subject": "S1", "condition": "AtoB"}, {"filename": "y.csv"}, {"filename": "gone.csv", "subject": "S2"}], indent=1))
    table = readers.assignments(spark, str(tmp_path / "a.json"))
    recs = spark.createDataFrame([("x.csv", 250), ("y.csv", 250), ("z.csv", 250)], "recording_id string, fs int")
    got = {r.filename: (r.subject, r.condition, r.error) for r in readers.assigned(recs, table).collect()}
    assert got == {"x.csv": ("S1", "AtoB", None), "y.csv": ("unknown", "custom", None), "z.csv": (None, None, "no assignment"), "gone.csv": ("S2", "custom", "no such file")}
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        readers.assignments(spark, str(tmp_path / "bad.json")).collect()
