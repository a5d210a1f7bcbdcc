"""Queries that write events as files of each format and read them back: one recording for each kind of event.

The files stand in the shared folder; what the readers make of them must be what SQL makes of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources import readers
from ..sources.scratch import folder, staged
from .base import Tables, query

KINDS = "k AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events)"


def _kinds(t: Tables) -> DataFrame:
    w = W.partitionBy("event_type").orderBy("event_id")
    return t.table("events").select("event_type", "event_id", "value", (F.row_number().over(w) - 1).cast("long").alias("i"))


def _written(t: Tables, name: str, head: list[str], line: Column) -> str:
    """Writes ``line`` of every row below the lines ``head``: a folder for each kind with one file of it.

    The head comes from the first row of a kind.  A union of heads and rows would not do: each side is dealt out by kind already, so
    Spark leaves out the shuffle above them, and once it joins partitions of one side the two are no longer dealt alike.
    """
    made = F.when(F.col("i") == 0, F.array(*[F.lit(h) for h in head], line)).otherwise(F.array(line))
    body = _kinds(t).select(F.col("event_type").alias("kind"), "i", F.posexplode(made).alias("nth", "line"))
    out = folder(t.spark, name)
    body.repartition("kind").sortWithinPartitions("kind", "i", "nth").select("kind", "line").write.partitionBy("kind").option("compression", "none").text(out)
    return out


def _kind() -> Column:
    return F.regexp_extract("recording_id", "kind=([^/]+)/", 1).alias("event_type")


ODF = ["%OpenBCI Raw EXG Data", "%Number of channels = 2", "%Sample Rate = 200 Hz", "%Board = OpenBCI_GUI$BoardGanglionBLE"]
ODF_NAMES = "Sample Index, EXG Channel 0, EXG Channel 1, Accel Channel 0, Accel Channel 1, Accel Channel 2, Timestamp, Marker Channel"


def _odf_line() -> Column:
    i, v = F.col("i"), F.col("value").cast("string")
    return F.concat_ws(", ", i.cast("string"), v, (-F.col("value")).cast("string"), F.lit("0"), F.lit("0"), F.lit("1"), (i * 5).cast("string"), F.when(i % 50 == 3, "7").otherwise("0"))


def _board_line() -> Column:
    i, v = F.col("i"), F.col("value").cast("string")
    return F.concat_ws(",", (i % 256).cast("string"), *[v if c else (-F.col("value")).cast("string") for c in range(4)], F.lit("0"), F.lit("0"), F.when(i % 11 == 5, "-").otherwise("1"), *[F.lit("0")] * 5, (i / 200).cast("string"), F.lit("0"))


@query(
    "s06_header_exports",
    f"WITH {KINDS} SELECT event_type, i AS sample_idx, i / 200.0 AS t_sec, channel_idx, 'EXG_' || channel_idx AS channel, round(CASE WHEN channel_idx = 0 THEN value ELSE -value END, 6) AS value FROM k CROSS JOIN (SELECT unnest([0, 1]) AS channel_idx)",
)
def s06(t):
    rows = readers.load(t.spark, _written(t, "odf", [*ODF, ODF_NAMES], _odf_line()))
    return readers.samples(rows).select(_kind(), "sample_idx", "t_sec", "channel_idx", "channel", "value")


@query("s06_pruned_columns", f"WITH {KINDS} SELECT event_type, count(*) AS n, round(sum(-value), 4) AS total, max(i * 5.0) AS last FROM k GROUP BY event_type", digits=4)
def s06_pruned(t):
    """Two of eight columns: no other is cut from the lines."""
    got = readers.read_columns(t.spark, _written(t, "odf", [*ODF, ODF_NAMES], _odf_line()), ["EXG Channel 1", "Timestamp"])
    return got.groupBy(_kind()).agg(F.count(F.lit(1)).alias("n"), F.sum("EXG Channel 1").alias("total"), F.max("Timestamp").alias("last"))


@query("s05_header_settings", f"WITH {KINDS} SELECT event_type, 'odf' AS format, 'ganglion' AS board, 200 AS fs, 2 AS n_channels, count(*) AS n_samples, true AS has_accelerometer, max(i) >= 3 AS has_markers, round(count(*) / 200, 6) AS duration_sec FROM k GROUP BY event_type")
def s05(t):
    rows = readers.load(t.spark, _written(t, "odf", [*ODF, ODF_NAMES], _odf_line()))
    return readers.recordings(rows).select(_kind(), "format", "board", "fs", "n_channels", "n_samples", "has_accelerometer", "has_markers", "duration_sec")


@query(
    "s07_board_rows_read",
    f"WITH {KINDS}, f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY i) - 1 AS j FROM k WHERE i % 11 <> 5) SELECT event_type, j AS sample_idx, j / 200.0 AS t_sec, channel_idx, round(CASE WHEN channel_idx = 0 THEN -value ELSE value END, 6) AS value FROM f CROSS JOIN (SELECT unnest(range(4)) AS channel_idx)",
)
def s07(t):
    head = ",".join(map(str, range(15)))
    rows = readers.load(t.spark, _written(t, "board", [head], _board_line()))
    return readers.samples(rows).select(_kind(), "sample_idx", "t_sec", "channel_idx", "value")


@query("s09_plain_tables", f"WITH {KINDS} SELECT event_type, 'plain' AS format, 125 AS fs, i AS sample_idx, round(i / 125.0, 6) AS t_sec, round(value, 6) AS value FROM k")
def s09(t):
    line = F.concat_ws(",", (F.col("i") / 125).cast("string"), F.col("value").cast("string"))
    rows = staged(readers.load(t.spark, _written(t, "plain", ["time,ch1"], line)), "plain-samples")  # read twice
    meta = readers.recordings(rows).select("recording_id", "format", "fs")
    return readers.samples(rows).join(meta, "recording_id").select(_kind(), "format", "fs", "sample_idx", "t_sec", "value")


@query(
    "s11_metadata",
    f"""WITH {KINDS}, n AS (SELECT event_type, count(*) AS n_samples FROM k GROUP BY event_type)
SELECT event_type, 'odf' AS format, 'ganglion' AS board, 200 AS fs, 2 AS n_channels, 'EXG_0,EXG_1' AS channels, 5 AS header_lines, n_samples, round(n_samples / 200, 6) AS duration_sec, true AS has_accelerometer FROM n
UNION ALL SELECT event_type, 'board', 'ganglion', 200, 4, 'EXG_0,EXG_1,EXG_2,EXG_3', 1, n_samples, round(n_samples / 200, 6), true FROM n""",
)
def s11(t):
    both = [_written(t, "odf", [*ODF, ODF_NAMES], _odf_line()), _written(t, "board", [",".join(map(str, range(15)))], _board_line())]
    got = [readers.info(t.spark, d).select(_kind(), "format", "board", "fs", "n_channels", F.array_join("channels", ",").alias("channels"), "header_lines", "n_samples", "duration_sec", "has_accelerometer") for d in both]
    return got[0].unionByName(got[1])


@query(
    "s12_event_files",
    "SELECT user_id, event_type AS event_id, round(epoch(ts), 3) AS t_sec FROM events",
    digits=3,
)
def s12(t):
    out = folder(t.spark, "events")
    e = t.table("events").select(F.col("event_type").alias("event_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), "user_id")
    e.write.option("header", True).csv(out)
    return readers.events(t.spark, out, ["user_id"]).select(F.col("user_id").cast("long").alias("user_id"), "event_id", "t_sec")


@query(
    "s23_assignment_table",
    """SELECT c_name AS filename, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'S' || c_nationkey END AS subject, CASE WHEN c_custkey % 5 = 0 THEN 'custom' ELSE c_mktsegment END AS condition, CASE WHEN o.k IS NULL THEN 'no such file' END AS error
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey""",
)
def s23(t):
    c = t.table("customer")
    out = folder(t.spark, "assignments")
    row = F.struct(F.col("c_name").alias("filename"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("S"), F.col("c_nationkey").cast("string"))).alias("subject"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("condition"))
    c.groupBy("c_nationkey").agg(F.to_json(F.collect_list(row)).alias("j")).write.partitionBy("c_nationkey").text(out)  # one array a file
    known = c.join(t.table("orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi").select(F.col("c_name").alias("recording_id"))
    return readers.assigned(known, readers.assignments(t.spark, out)).select("filename", "subject", "condition", "error")
