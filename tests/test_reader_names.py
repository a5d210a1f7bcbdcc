"""Names of recordings under roots of any name, and event files with headers of their own."""

import io
import zipfile

import pytest

from wavelake.plans import pipelines
from wavelake import schema as S
from wavelake.sources import readers, writers
from wavelake.streaming import live


def put(folder, first=0, n=5):
    folder.mkdir(parents=True)
    (folder / "rec.csv").write_text("\n".join(["time,ch1", *(f"{i * 0.004:.3f},{i + first}" for i in range(n))]))


@pytest.mark.parametrize("root", ["my study", "plus+and%20", "größe é", "plain"])
def test_roots_with_blanks_and_other_letters(spark, tmp_path, root):
    for k, sub in enumerate(("s1", "s 2", "ü")):
        put(tmp_path / root / sub, 100 * k)
    for path in (str(tmp_path / root), f"{tmp_path / root}/*", f"{tmp_path / root}/"):
        got = {}
        for r in readers.samples(readers.load(spark, path)).collect():
            got.setdefault(r.recording_id, []).append(r.value)
        assert {k: sorted(v) for k, v in got.items()} == {f"{s}/rec.csv": [100.0 * k + i for i in range(5)] for k, s in enumerate(("s1", "s 2", "ü"))}
    assert {r.recording_id for r in readers.info(spark, str(tmp_path / root)).collect()} == {"s1/rec.csv", "s 2/rec.csv", "ü/rec.csv"}
    assert {r.recording_id for r in readers.load(spark, str(tmp_path / root / "s 2" / "rec.csv")).collect()} == {"rec.csv"}


def test_each_event_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('event_id,timestamp,note\nS0,0.5,"x, y"\nX0,2,\n')
    (tmp_path / "b.csv").write_text("timestamp,event_id\n7,B0\n8.25,B1\n")
    (tmp_path / "c.csv").write_text("Other,Event_ID,Timestamp\nq,Z,9\n")
    got = sorted(map(tuple, readers.events(spark, str(tmp_path), ["note"]).collect()), key=lambda r: r[2])
    assert got == [("x, y", "S0", 0.5), (None, "X0", 2.0), (None, "B0", 7.0), (None, "B1", 8.25), (None, "Z", 9.0)]
    (tmp_path / "d.csv").write_text("name,when\nS0,1\n")
    with pytest.raises(ValueError, match="d.csv"):
        readers.events(spark, str(tmp_path))


def test_bundles_keep_files_of_one_name(spark, tmp_path):
    put(tmp_path / "in" / "s1", 1)
    put(tmp_path / "in" / "s2", 2)
    originals = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "in"))
    data = writers.bundle(spark.createDataFrame([("a", 1.0)], "condition string, x double"), "# r", originals)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert sorted(z.namelist()) == ["files/s1/rec.csv", "files/s2/rec.csv", "report.md", "results.json"]
        assert z.read("files/s2/rec.csv") == (tmp_path / "in" / "s2" / "rec.csv").read_bytes()


def test_an_unrecovered_recording_is_compared(spark):
    kind = "recording_id string, recovery_time double, artifact_ratio double, baseline_means map<string,double>, attenuation map<string,double>, recovery_per_feature map<string,double>"
    one = {k: 1.0 for k in S.FEATURES}
    flow = [("AtoA", 50.0, 0.0, one, one, one), ("AtoC", None, 0.0, one, {S.FLOW_INDICATORS[0]: 90.0}, {})]
    got = [r.line for r in pipelines.report(spark.createDataFrame(flow, kind)).where("recording_id = 'AtoC'").orderBy("line_no").collect()]
    assert "- recovery is longer than in the control" in got
    both_long = [("AtoA", None, 0.0, one, one, one), ("AtoC", None, 0.0, one, one, {})]
    got = [r.line for r in pipelines.report(spark.createDataFrame(both_long, kind)).where("recording_id = 'AtoC'").collect()]
    assert "- recovery is no longer than in the control" in got


def test_the_buffer_holds_values_not_channels(spark, tmp_path):
    """1,200 values are 400 samples of three channels; the handler of refresh gets every row."""
    rows = [("s", i / 50, [float(i), 0.0, 1.0]) for i in range(500)]
    df = spark.createDataFrame(rows, "room string, t double, channels array<double>").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live.refresh(stream, "room", 50.0, lambda batch: seen.extend(batch.collect()), str(tmp_path / "state"), every="0 seconds", most=1200)
    q.processAllAvailable()
    q.stop()
    assert [r.n_samples for r in sorted(seen, key=lambda r: r.t)] == [min(i + 1, 400) for i in range(500)]
