"""Streams over a session's buffer, its states and heartbeats, the generated board and the recorder."""

import numpy as np
import pytest

from wavelake import schema as S
from wavelake.functions import kernels as K
from wavelake.sources import synthetic
from wavelake.streaming import live


def played(spark, tmp_path, df, build, name, parts=1):
    src = str(tmp_path / name)
    df.repartition(parts).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_metrics_over_the_bounded_buffer(spark, tmp_path):
    fs, n, most = 50.0, 1200, 1600  # 800 samples of two channels
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    rows = [("s", i / fs, [float(x[i, 0])] if i % 100 == 7 else [float(v) for v in x[i]]) for i in range(n)]
    x[7::100, 1] = 0.0  # a channel that a frame lacks counts as zero
    df = spark.createDataFrame(rows, "room string, t double, channels array<double>").orderBy("t").coalesce(1)
    score = lambda m: m.mean(axis=1)
    got = sorted(played(spark, tmp_path, df, lambda s: live.metrics(s, "room", fs, score, most, channels=2), "metrics"), key=lambda r: r.t)
    assert [r.n_samples for r in got] == [min(i + 1, 800) for i in range(n)]
    last = None
    for i, r in enumerate(got):
        if last is None or i / fs - last > 2.0:
            last = i / fs
            buffer = x[max(0, i + 1 - 800) : i + 1]
            power = np.mean([K.welch(c, fs, min(len(c), 100))[1] for c in buffer.T], axis=0)
            freq = K.welch(buffer[:, 0], fs, min(len(buffer), 100))[0]
            want = [power[(freq >= lo) & (freq < hi)].sum() / (power.sum() + S.TINY) for lo, hi in S.BANDS.values()]
            focus = score(buffer[: len(buffer) // 200 * 200].mean(axis=1).reshape(-1, 200)) if len(buffer) >= 200 else None
        assert [r[b] for b in S.BANDS] == pytest.approx(want, abs=1e-9)
        assert (r.focus, r.stability) == (pytest.approx((focus.mean(), 1 - focus.std())) if focus is not None else (0.0, 0.0))


def test_session_states(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["start", "connected", "stop", "error", "nonsense"]
    rows = [(f"r{i % 3}", i, words[int(rng.integers(0, 5))]) for i in range(120)]
    df = spark.createDataFrame(rows, "room string, seq long, command string").orderBy("seq").coalesce(1)
    got = {r.seq: (r.state, r.accepted) for r in played(spark, tmp_path, df, lambda s: live.session_states(s, "room", "seq"), "sessions")}
    now = {}
    for room, seq, c in rows:
        old = now.get(room, "IDLE")
        new = {"IDLE": {"start": "CONNECTING"}, "CONNECTING": {"connected": "STREAMING", "error": "ERROR", "stop": "IDLE"}, "STREAMING": {"stop": "IDLE", "error": "ERROR"}, "ERROR": {"stop": "IDLE"}}[old].get(c)
        now[room] = new or old
        assert got[seq] == (now[room], new is not None)


def test_a_silent_session_gets_heartbeats(spark, tmp_path):
    import time

    src = tmp_path / "beats"
    spark.createDataFrame([("a", 1), ("a", 2)], "room string, seq long").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("room string, seq long").parquet(str(src))
    q = live.heartbeats(stream, "room", "seq", 300).writeStream.format("memory").queryName("beats").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.sql("SELECT * FROM beats WHERE type = 'ping'").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    got = [(r.room, r.seq, r.type) for r in spark.sql("SELECT * FROM beats").collect()]
    assert got[:2] == [("a", 1, "data"), ("a", 2, "data")] and len(got) >= 4 and all(x == ("a", None, "ping") for x in got[2:])


def test_messages_of_a_session(spark):
    rows = [('{"type":"frame","ts":1.5,"channels":[1,2]}',), ('{"type":"metrics","theta_alpha_ratio":2.5}',), ('{"type":"marker","label":"x"}',), ("no json",)]
    got = live.parsed(spark.createDataFrame(rows, "json string")).collect()
    assert [r.type for r in got] == ["frame", "metrics", "marker", None] and got[0].channels == [1.0, 2.0] and got[1].theta_alpha_ratio == 2.5 and got[2].label == "x"


def test_board_to_recorder(spark, tmp_path):
    synthetic.register_board(spark)
    board = spark.readStream.format("synthetic_board").option("fs", 50).option("channels", 2).option("batch", 40).load()
    rows = board.selectExpr("seq AS Index", "package", "channels[0] AS EXG0", "channels[1] AS EXG1", "CASE WHEN seq % 10 = 0 THEN 'entered' ELSE 'idle' END AS state")
    out = str(tmp_path / "rec")
    q = live.recorder_rows(rows).writeStream.format("csv").option("sep", "\t").option("header", True).option("checkpointLocation", str(tmp_path / "state")).option("path", out).start()
    try:
        import time

        until = time.time() + 60
        while time.time() < until and not any(p["numInputRows"] for p in q.recentProgress):
            time.sleep(0.3)
    finally:
        q.stop()
    got = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(out).orderBy("Index").collect()
    assert len(got) >= 40 and [r.Index for r in got] == list(range(len(got))) and [r.package for r in got] == [i % 256 for i in range(len(got))]
    assert all(r.marker == (3 if r.Index % 10 == 0 else 0) for r in got)
    assert got[7].EXG1 == pytest.approx(50 * np.sin(2 * np.pi * 11 * 7 / 50))
