"""Board exports and plain delimited text as ``samples``, ``events`` and ``recordings``.

Formats: ``odf`` (text export with % header), ``board`` (numeric columns by position, comma or tab), ``session`` (tab separated, with
a header line, written by the session recorder) and ``plain`` (CSV with a time column).  All files of a path are read at once; a
recording is a file.  Lines are cut and typed by built-in functions, needed columns are picked before they become rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S

TIME_NAMES = ("time", "timestamp", "t", "时间")

#: Lines of a block. Samples are numbered block by block, so the rows of a long recording are dealt over all tasks.
BLOCK = 8192
AT = ["recording_id", "_split", "_block"]


def _place(path: Column) -> Column:
    """The path of a file's address: without scheme and host, decoded (a plus stays a plus)."""
    bare = F.regexp_replace(path, "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def _named_below(spark: SparkSession, root: str, path: Column) -> Column:
    """The path of a file below ``root`` (of a pattern: below the part before its first wildcard), its base name if it is ``root``
    itself; a file found elsewhere, through a link say, keeps its whole path, so no two files share a name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fixed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath()
    parts = fixed.split("/")
    wild = [i for i, x in enumerate(parts) if re.search(r"[*?\[{]", x)]
    key = "/".join(parts[: wild[0]] if wild else parts).rstrip("/")
    place = _place(path)
    return F.when(place == key, F.regexp_extract(place, "([^/]+)$", 1)).when(place.startswith(F.lit(f"{key}/")), F.substring(place, len(key) + 2, 1 << 30)).otherwise(place)


def lines(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".csv", ".tsv")) -> DataFrame:
    """(recording_id, path, line_no, line): non-empty lines; files of other suffixes are left out.

    A recording is named by its path below ``path``, so files of one name in two folders stay apart.  Large files are read in
    splits: ``line_no`` (offset of the split, number in it) orders the lines of a file.
    """
    text = spark.read.text(path, recursiveFileLookup=True)
    text = text.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n")).alias("line_no"), F.col("value").alias("line"))
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.lower(F.col("path")).endswith(s)
    return text.where(keep & (F.trim("line") != "")).select(_named_below(spark, path, F.col("path")).alias("recording_id"), "path", "line_no", "line")


def separator(line: Column) -> Column:
    return F.when(line.contains("\t"), F.lit("\t")).otherwise(F.lit(","))


def cells(line: Column) -> Column:
    return F.transform(F.split(line, F.when(line.contains("\t"), F.lit("\t")).otherwise(F.lit(","))), lambda c: F.trim(c))


def numbers(line: Column) -> Column:
    return F.transform(cells(line), lambda c: c.try_cast("double"))


def is_index_row(nums: Column) -> Column:
    """0, 1, 2, ...: the header of a board file."""
    n = F.size(nums)
    places = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    return (n >= 2) & F.forall(F.zip_with(nums, places, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)


def file_format(first: Column) -> Column:
    """Format by the first line of a file."""
    nums = numbers(first)
    numeric = (F.size(nums) >= 10) & F.forall(nums, lambda x: x.isNotNull())
    head = F.transform(cells(first), F.lower)
    return (
        F.when(first.startswith("%OpenBCI"), "odf").when(~first.startswith("%") & numeric, "board")
        .when(first.contains("\t") & F.array_contains(head, "index") & F.array_contains(head, "marker"), "session").otherwise("plain")
    )


def formats(text: DataFrame) -> DataFrame:
    """(recording_id, path, first, format)"""
    first = F.min_by("line", "line_no")
    return text.groupBy("recording_id", "path").agg(first.alias("first")).withColumn("format", file_format(F.trim("first")))


def odf_header(text: DataFrame) -> DataFrame:
    """(recording_id, fs, n_channels, board, cols): what the % lines and the line of column names say; cols are the names in order."""
    pct = F.col("line").startswith("%")
    number = lambda what: F.max(F.when(pct, F.nullif(F.regexp_extract("line", what + r"\s*=\s*(\d+)", 1), F.lit("")))).cast("int")
    board = F.max(F.when(pct & F.col("line").contains("BoardCyton") & F.col("line").contains("Daisy"), "daisy").when(pct & F.col("line").contains("BoardCyton"), "cyton").when(pct & F.col("line").contains("BoardGanglion"), "ganglion"))
    names = F.min_by(F.when(~pct, F.col("line")), F.when(~pct, F.col("line_no")))
    g = text.groupBy("recording_id").agg(number("Number of channels").alias("n"), F.coalesce(number("Sample Rate"), F.lit(250)).alias("fs"), F.coalesce(board, F.lit("unknown")).alias("board"), names.alias("names"))
    return g.select("recording_id", "fs", F.coalesce("n", F.lit(0)).alias("n_channels"), "board", F.transform(F.split("names", ","), lambda c: F.trim(c)).alias("cols"))


def _blocks(rows: DataFrame, seq: str) -> DataFrame:
    """Rows dealt out by block: a shuffle of its own, as rows dealt by recording (for a join with its head) would pass for it."""
    return rows.withColumns({"_split": F.col(f"{seq}.split"), "_block": F.expr(f"{seq}.n div {BLOCK}")}).repartition(*AT)


def _steps(rows: DataFrame, ts: Column) -> DataFrame:
    """(recording_id, dt): the time from the row before to each row, null for the first."""
    rows = _blocks(rows.select("recording_id", "line_no", ts.alias("ts")), "line_no")
    last = rows.groupBy(*AT).agg(F.max_by("ts", "line_no").alias("last"))
    last = last.select(*AT, F.lag("last").over(W.partitionBy("recording_id").orderBy("_split", "_block")).alias("last")).repartition(*AT)
    w = W.partitionBy(*AT).orderBy("line_no")
    rows = rows.withColumn("nth", F.row_number().over(w)).withColumn("before", F.lag("ts").over(w)).join(last, AT)
    return rows.select("recording_id", (F.col("ts") - F.when(F.col("nth") == 1, F.col("last")).otherwise(F.col("before"))).alias("dt"))


def _mean_rate(rows: DataFrame, ts: Column) -> DataFrame:
    """(recording_id, guess): one over the mean of the positive time steps, 250 if there is none."""
    mean = F.avg(F.when(F.col("dt") > 0, F.col("dt")))
    return _steps(rows, ts).groupBy("recording_id").agg(F.coalesce(F.rint(F.lit(1.0) / mean).cast("int"), F.lit(250)).alias("guess"))


def _picked(rows: DataFrame) -> DataFrame:
    """From (recording_id, path, format, board, fs, nums, seq, exg places, accel places, ts place, unit, marker place) to one row for
    each sample, with the arrays of its values."""
    at = lambda p: F.get(F.col("nums"), F.col(p))
    rows = _blocks(rows.withColumn("ts", at("ts_at") / F.col("unit")), "seq")
    blocks = rows.groupBy(*AT).agg(F.count(F.lit(1)).alias("n"), F.min_by("ts", "seq").alias("ts"))
    w = W.partitionBy("recording_id").orderBy("_split", "_block").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.select(*AT, (F.sum("n").over(w) - F.col("n")).alias("_before"), F.first("ts").over(w).alias("_start")).repartition(*AT)  # else a join may deal the rows by recording
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*AT).orderBy("seq"))).join(blocks, AT)
    rows = rows.withColumn("sample_idx", (F.col("_before") + F.col("_nth") - 1).cast("long"))
    wall = F.col("ts") - F.col("_start")
    return rows.select(
        "recording_id", "path", "format", "board", "fs", "sample_idx", F.coalesce(wall, F.col("sample_idx") / F.col("fs")).alias("wall_sec"),
        F.transform("exg_at", lambda p: F.get(F.col("nums"), p)).alias("exg"), F.transform("accel_at", lambda p: F.get(F.col("nums"), p)).alias("accel"), at("marker_at").alias("marker"), "names",
    )


def read_odf(text: DataFrame) -> DataFrame:
    places = lambda pattern: F.filter(F.transform(F.col("cols"), lambda c, i: F.when(c.rlike(pattern), i)), lambda x: x.isNotNull())
    place = lambda name: F.array_position(F.col("cols"), name).cast("int") - 1
    head = odf_header(text)
    exg = F.when(F.size(places(r"^EXG Channel \d+")) > 0, places(r"^EXG Channel \d+")).otherwise(F.sequence(F.lit(1), F.greatest("n_channels", F.lit(1))))
    head = head.withColumns({"exg_at": exg, "accel_at": places("^Accel Channel"), "ts_at": F.nullif(place("Timestamp"), F.lit(-1)), "marker_at": F.nullif(place("Marker Channel"), F.lit(-1))})
    head = head.withColumn("names", F.transform("exg_at", lambda p, i: F.concat(F.lit("EXG_"), F.coalesce(F.nullif(F.regexp_extract(F.get(F.col("cols"), p), r"^EXG Channel (\d+)", 1), F.lit("")), i.cast("string")))))
    rows = text.where(~F.col("line").startswith("%")).join(head, "recording_id")
    rows = rows.withColumn("nums", numbers(F.col("line"))).where(F.get("nums", F.lit(0)).isNotNull())
    return _picked(rows.withColumn("format", F.lit("odf")).withColumn("unit", F.lit(1000.0)).withColumn("seq", F.col("line_no")))


def board_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, b, c, f) for n, (b, c, f) in S.BOARD_COLUMNS.items()], "n_cols int, board string, n_exg int, board_fs int")


def read_board(text: DataFrame) -> DataFrame:
    """Rows with an empty or unreadable cell are dropped, and the header of column numbers; unknown widths take their rate from the
    mean of the positive time steps."""
    rows = text.withColumn("nums", numbers(F.col("line"))).withColumn("n_cols", F.size("nums"))
    rows = rows.where(F.forall("nums", lambda x: x.isNotNull()))
    first = rows.groupBy("recording_id").agg(F.min("line_no").alias("first_no"))
    rows = rows.join(first, "recording_id").where((F.col("line_no") != F.col("first_no")) | ~is_index_row(F.col("nums")))
    rows = rows.join(F.broadcast(board_map(text.sparkSession)), "n_cols", "left")  # six rows
    n = F.coalesce("n_exg", F.greatest(F.expr("n_cols div 4"), F.lit(1)))
    rows = rows.withColumn("n", n).withColumn("board", F.coalesce("board", F.lit("unknown")))
    guess = _mean_rate(rows.where("board_fs IS NULL"), F.get("nums", F.col("n_cols") - 2))
    rows = rows.join(guess, "recording_id", "left").withColumn("fs", F.coalesce("board_fs", "guess"))
    accel = F.when(F.col("n_cols") >= F.col("n") + 4, F.sequence(F.col("n") + 1, F.col("n") + 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumns({
        "exg_at": F.sequence(F.lit(1), F.col("n")), "accel_at": accel, "ts_at": F.col("n_cols") - 2, "marker_at": F.col("n_cols") - 1,
        "names": F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("EXG_"), i.cast("string"))),
        "format": F.lit("board"), "unit": F.lit(1.0), "seq": F.col("line_no"),
    })
    return _picked(rows)


def _named(text: DataFrame, fmt: str) -> DataFrame:
    """Files with a line of column names: (…, cols, nums) of their data lines."""
    head = text.groupBy("recording_id").agg(F.min("line_no").alias("head_no"), F.min_by("line", "line_no").alias("head"))
    head = head.select("recording_id", "head_no", F.transform(cells(F.col("head")), F.lower).alias("cols"), cells(F.col("head")).alias("real_cols"))
    rows = text.join(head, "recording_id").where("line_no <> head_no").withColumn("nums", numbers(F.col("line")))
    return rows.withColumn("format", F.lit(fmt)).withColumn("board", F.lit("unknown")).withColumn("seq", F.col("line_no"))


def read_session(text: DataFrame) -> DataFrame:
    """Recordings of the session recorder; times are in milliseconds."""
    rows = _named(text, "session")
    places = lambda pattern: F.filter(F.transform("cols", lambda c, i: F.when(c.rlike(pattern), i)), lambda x: x.isNotNull())
    place = lambda name: F.nullif(F.array_position(F.col("cols"), name).cast("int") - 1, F.lit(-1))
    rows = rows.withColumns({"exg_at": places("^exg"), "accel_at": places("^accel"), "ts_at": place("timestamp"), "marker_at": place("marker"), "unit": F.lit(1000.0)})
    rows = rows.join(_mean_rate(rows, F.get("nums", F.col("ts_at")) / 1000), "recording_id").withColumnRenamed("guess", "fs")
    return _picked(rows.withColumn("names", F.transform("exg_at", lambda p: F.get(F.col("real_cols"), p))))


def read_plain(text: DataFrame) -> DataFrame:
    """CSV with a time column (the rate is one over the median step) or without (250 Hz)."""
    rows = _named(text, "plain")
    isin = lambda c: c.isin(*TIME_NAMES)
    rows = rows.withColumns({
        "exg_at": F.filter(F.transform("cols", lambda c, i: F.when(~isin(c), i)), lambda x: x.isNotNull()),
        "accel_at": F.array().cast("array<int>"), "marker_at": F.lit(None).cast("int"), "unit": F.lit(1.0),
        "ts_at": F.get(F.filter(F.transform("cols", lambda c, i: F.when(isin(c), i)), lambda x: x.isNotNull()), F.lit(0)),
    })
    mid = _steps(rows, F.get("nums", F.col("ts_at"))).groupBy("recording_id").agg(F.percentile("dt", F.lit(0.5)).alias("mid"))
    rows = rows.join(mid, "recording_id").withColumn("fs", F.coalesce(F.when(F.col("mid") > 0, F.rint(F.lit(1.0) / F.col("mid"))).cast("int"), F.lit(250)))
    return _picked(rows.withColumn("names", F.transform("exg_at", lambda p: F.get(F.col("real_cols"), p))))


READERS = {"odf": read_odf, "board": read_board, "session": read_session, "plain": read_plain}


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Sample rows with arrays (see ``_picked``) of all files under a path, each read by its own format, or all by ``fmt``."""
    from .scratch import staged

    text = lines(spark, path)
    if fmt:
        return READERS[fmt](text)
    # the format of each file from its first line; lines are written once, each reader takes its own
    text = staged(text.join(formats(text).select("path", "format"), "path").select("recording_id", "path", "line_no", "line", "format"), "typed-lines")
    found = {r.format for r in text.select("format").distinct().collect()} or {"plain"}  # four at most
    out = None
    for name, read in READERS.items():
        if name not in found:
            continue
        part = read(text.where(F.col("format") == name).drop("format"))
        out = part if out is None else out.unionByName(part)
    return out


def layouts(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """(line of column names, files that have it) of header exports: only lines are read for this, no cell is cut."""
    text = lines(spark, path).where(~F.col("line").startswith("%"))
    heads = text.groupBy("path").agg(F.min_by("line", "line_no").alias("head"))
    return [(r.head, r.paths) for r in heads.groupBy("head").agg(F.collect_list("path").alias("paths")).collect()]  # a row for each layout


def read_columns(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(recording_id, line_no, wanted: doubles) of header exports, by the names in their headers.

    Files of one layout are one CSV scan with the layout's schema: the scan skips % lines and the header and cuts only the wanted
    columns (``ReadSchema``).  A file without one of them has nulls; of columns of one name the first counts.
    """
    from pyspark.sql.types import DoubleType, StructType

    out = None
    for head, files in layouts(spark, path):
        names: list[str] = []
        for i, n in enumerate(x.strip() for x in re.split("\t" if "\t" in head else ",", head)):
            names.append(n if n and n not in names else f"{n}#{i}")
        schema = StructType()
        for n in names:
            schema = schema.add(n, DoubleType())
        files = [r[0] for r in spark.createDataFrame([(f,) for f in files], "f string").select(F.coalesce(F.try_url_decode(F.replace("f", F.lit("+"), F.lit("%2B"))), "f")).collect()]
        rows = spark.read.schema(schema).csv(files, header=True, comment="%", sep="\t" if "\t" in head else ",", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n")).alias("line_no")
        cols = [F.col(f"`{c}`") if c in names else F.lit(None).cast("double").alias(c) for c in wanted]
        part = rows.select(_named_below(spark, path, F.col("_metadata.file_path")).alias("recording_id"), at, *cols)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "recording_id string, line_no struct<split: bigint, n: bigint>, " + ", ".join(f"`{c}` double" for c in wanted)) if out is None else out


def samples(rows: DataFrame) -> DataFrame:
    """Long form; t_sec is by sample number, the wall clock stays in the rows."""
    z = rows.select("recording_id", "sample_idx", (F.col("sample_idx") / F.col("fs")).alias("t_sec"), F.posexplode(F.arrays_zip("names", "exg")).alias("channel_idx", "z"))
    return z.select("recording_id", "sample_idx", "t_sec", "channel_idx", F.col("z.names").alias("channel"), F.col("z.exg").alias("value"))


def accel(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("accel") >= 3).select("recording_id", "sample_idx", *[F.get("accel", F.lit(i)).alias(n) for i, n in enumerate(("ax", "ay", "az"))])


def markers(rows: DataFrame) -> DataFrame:
    """Events of the rows whose marker is not zero."""
    v = F.col("marker").cast("int")
    return rows.where(F.col("marker") != 0).select("recording_id", F.concat(F.lit("marker_"), v.cast("string")).alias("event_id"), F.col("wall_sec").alias("t_sec"), v.alias("value"))


def recordings(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("recording_id", "path", "format", "board", "fs").agg(
        F.max(F.size("exg")).alias("n_channels"), F.count(F.lit(1)).alias("n_samples"), F.bool_or(F.size("accel") >= 3).alias("has_accelerometer"),
        F.coalesce(F.bool_or(F.col("marker") != 0), F.lit(False)).alias("has_markers"), F.first("names").alias("channels"),
    )
    return g.withColumn("duration_sec", F.when(F.col("fs") > 0, F.col("n_samples") / F.col("fs")).otherwise(0.0))


def info(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, path, format, size_kb, n_lines, header_lines, n_samples, board, fs, n_channels, channels, duration_sec,
    has_accelerometer) of each file, from its first lines and its number of lines; samples are not typed.

    Boards of unknown width and plain files count as recorded at 250 Hz.
    """
    text = lines(spark, path)
    n = text.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").startswith("%")).alias("marked"))
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", (F.col("length") / 1024).alias("size_kb"))
    size = size.select(_named_below(spark, path, F.col("path")).alias("recording_id"), "size_kb")
    kinds = formats(text)
    head = odf_header(text.join(kinds.where("format = 'odf'").select("recording_id"), "recording_id", "left_semi"))
    exg = F.filter("cols", lambda c: c.rlike(r"^EXG Channel \d+"))
    head = head.select(
        "recording_id", F.col("board").alias("h_board"), F.col("fs").alias("h_fs"), F.greatest("n_channels", F.size(exg)).alias("h_n"),
        F.transform(exg, lambda c: F.concat(F.lit("EXG_"), F.regexp_extract(c, r"(\d+)", 1))).alias("h_names"), F.exists("cols", lambda c: c.startswith("Accel Channel")).alias("h_accel"),
    )
    first = F.col("first")
    cols, nums = cells(first), numbers(first)
    out = kinds.join(n, "recording_id").join(size, "recording_id", "left").join(head, "recording_id", "left").withColumn("n_cols", F.size(cols))
    out = out.join(F.broadcast(board_map(spark)), "n_cols", "left")  # six rows
    odf, wide = F.col("format") == "odf", F.col("format") == "board"
    names = F.filter(cols, lambda c: ~F.lower(c).isin(*TIME_NAMES, "index", "marker") & ~F.lower(c).startswith("accel"))
    n_exg = F.when(odf, F.col("h_n")).when(wide, F.coalesce("n_exg", F.greatest(F.expr("n_cols div 4"), F.lit(1)))).otherwise(F.size(names))
    made = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_channels"), F.lit(1)) - 1), lambda i: F.concat(F.lit("EXG_"), i.cast("string")))
    head_lines = F.when(odf, F.col("marked") + F.lit(1)).when(wide, is_index_row(nums).cast("long")).otherwise(F.lit(1))
    out = out.withColumns({
        "board": F.when(odf, F.col("h_board")).when(wide, F.coalesce("board", F.lit("unknown"))).otherwise("unknown"), "n_channels": n_exg.cast("int"),
        "fs": F.when(odf, F.col("h_fs")).when(wide, F.coalesce("board_fs", F.lit(250))).otherwise(250), "header_lines": head_lines.cast("long"),
    })
    out = out.withColumn("channels", F.when(odf & (F.size("h_names") > 0), F.col("h_names")).when(odf | wide, made).otherwise(names)).withColumn("n_samples", F.col("n_lines") - F.col("header_lines"))
    accel = F.when(odf, F.col("h_accel")).when(wide, F.col("n_cols") >= F.col("n_channels") + 4).otherwise(F.exists(cols, lambda c: F.lower(c).startswith("accel")))
    out = out.withColumn("has_accelerometer", accel).withColumn("duration_sec", F.when(F.col("fs") > 0, F.col("n_samples") / F.col("fs")).otherwise(0.0))
    return out.select("recording_id", "path", "format", "size_kb", "n_lines", "header_lines", "n_samples", "board", "fs", "n_channels", "channels", "duration_sec", "has_accelerometer")


def assignments(spark: SparkSession, path: str) -> DataFrame:
    """(filename, subject, condition) of assignment files: JSON arrays of objects, subject 'unknown' and condition 'custom' by default."""
    rows = spark.read.schema("filename string, subject string, condition string").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select("filename", F.coalesce("subject", F.lit("unknown")).alias("subject"), F.coalesce("condition", F.lit("custom")).alias("condition"))


def assigned(recs: DataFrame, table: DataFrame) -> DataFrame:
    """Recordings with the subject and condition of their file; a file or an assignment without the other is an error row."""
    a = table.withColumn("_a", F.lit(True))
    out = recs.withColumn("filename", F.col("recording_id")).join(a, "filename", "full")
    error = F.when(F.col("recording_id").isNull(), "no such file").when(F.col("_a").isNull(), "no assignment")
    return out.select("filename", "subject", "condition", error.alias("error"), *[c for c in recs.columns if c != "filename"])


def events(spark: SparkSession, path: str, more: list[str] | None = None) -> DataFrame:
    """Event files: event_id, timestamp in seconds and the columns ``more``, each by the header of its own file (in any order; a
    file without one of ``more`` has nulls).  A file without the first two is an error; a quoted value stays on one line."""
    text = spark.read.text(path, recursiveFileLookup=True)
    text = text.select(F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n")).alias("no"), F.col("value").alias("line"))
    text = text.where(F.trim("line") != "")
    head = text.groupBy("path").agg(F.min(F.struct("no", "line")).alias("h")).select("path", F.col("h.no").alias("head_no"), F.col("h.line").alias("head"))
    widest = head.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    kind = ", ".join(f"c{i} string" for i in range(widest))
    cut = lambda line: F.transform(F.array(*[F.from_csv(line, kind)[f"c{i}"] for i in range(widest)]), lambda c: F.nullif(F.trim(c), F.lit("")))
    head = head.select("path", "head_no", F.transform(cut(F.regexp_replace("head", "^\ufeff", "")), lambda c: F.lower(c)).alias("names"))
    named = lambda name: F.coalesce(F.array_contains("names", name), F.lit(False))
    bad = head.where(~(named("event_id") & named("timestamp"))).select("path").first()
    if bad is not None:
        raise ValueError(f"an event file needs the columns event_id and timestamp: {bad.path}")
    rows = text.join(head, "path").where("no <> head_no").withColumn("cells", cut(F.col("line")))
    at = lambda name: F.when(F.array_position("names", name.lower()) > 0, F.get("cells", (F.array_position("names", name.lower()) - 1).cast("int")))
    return rows.select(*[at(c).alias(c) for c in more or []], at("event_id").alias("event_id"), at("timestamp").try_cast("double").alias("t_sec"))


def resolved_events(recs: DataFrame, given: DataFrame, found: DataFrame, default: DataFrame) -> DataFrame:
    """Events of each recording from the first of: given ones, markers, the default schedule."""
    cols = ["recording_id", "event_id", "t_sec"]
    both = given.select(*cols, F.lit(0).alias("pri")).unionByName(found.select(*cols, F.lit(1).alias("pri"))).unionByName(recs.select("recording_id").crossJoin(F.broadcast(default)).select(*cols, F.lit(2).alias("pri")))  # eleven rows
    both = both.repartition("recording_id")  # see series.as_of
    best = F.min("pri").over(W.partitionBy("recording_id"))
    return both.withColumn("best", best).where("pri = best").select(*cols)
