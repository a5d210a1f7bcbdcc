"""Sinks: wide CSV, JSON without not-a-number, tables of results, bundles, and the catalog of subjects and experiments."""

from __future__ import annotations

import io
import json
import posixpath
import random
import re
import time
import uuid
import zipfile
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def wide(samples: DataFrame, channels: list[str]) -> DataFrame:
    """(recording_id, time, one column for each channel)"""
    return samples.groupBy("recording_id", "sample_idx", F.col("t_sec").alias("time")).pivot("channel", channels).agg(F.first("value")).drop("sample_idx")


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def finite(df: DataFrame) -> DataFrame:
    """Not-a-number and infinite doubles become null, as JSON has neither."""
    cols = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(cols) if cols else df


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    return finite(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def preview(samples: DataFrame, points: int = 500) -> DataFrame:
    return samples.where(F.col("sample_idx") < points)


def summary_export(results: DataFrame) -> DataFrame:
    return results.select("condition", "recovery_time", "artifact_ratio")


def detail_export(results: DataFrame) -> DataFrame:
    """(condition, indicator, baseline, attenuation, recovery)"""
    return results.select("condition", F.explode(F.map_keys("baseline_means")).alias("indicator"), "baseline_means", "attenuation", "recovery_per_feature").select(
        "condition", "indicator", F.col("baseline_means")[F.col("indicator")].alias("baseline"), F.col("attenuation")[F.col("indicator")].alias("attenuation"),
        F.col("recovery_per_feature")[F.col("indicator")].alias("recovery"),
    )


def stamp(at: Column | None = None) -> Column:
    """The id that a time gives (now by default), to the second: 20240229_235959."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")


def stamped_name(name: Column, at: Column | None = None) -> Column:
    """A file's name behind the stamp of its time, without folders and with blanks as underscores."""
    return F.concat(stamp(at), F.lit("_"), F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), r"\s+", "_"))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def bundle(results: DataFrame, report: str, originals: DataFrame | None = None, most: int = 100_000, most_bytes: int = 1 << 28) -> bytes:
    """ZIP of a report, the results and the files that ``originals`` (path, length, content) names; refused beyond ``most`` rows or
    ``most_bytes`` bytes of files: write those as a table."""
    rows = to_json(results).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} results: write them as a table")
    if originals is not None and (originals.agg(F.sum("length")).first()[0] or 0) > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes of files")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("report.md", report)
        z.writestr("results.json", json.dumps([json.loads(r.json) for r in rows], ensure_ascii=False, indent=1))
        if originals is not None:
            names = [r.path for r in originals.select("path").orderBy("path").toLocalIterator()]
            root = posixpath.commonpath([posixpath.dirname(n) for n in names]) if names else ""
            for r in originals.select("path", "content").orderBy("path").toLocalIterator():
                z.writestr("files/" + unquote(posixpath.relpath(r.path, root)), bytes(r.content))  # files of one name in two folders stay apart
    return out.getvalue()


class Conflict(Exception):
    """Another writer has put the version first."""


class CommitLog:
    """Numbered versions of a set of tables: each is a small file that names the parquet folders of every table.

    A version is put only if its number is free, so of two writers that read the same version one fails and reads anew; readers see
    a version as a whole or not at all.  Local files are claimed by a hard link, others by creating without overwriting.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path, spark.sparkContext._jvm
        self.fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def latest(self) -> tuple[int, dict[str, list[str]]]:
        if not self.fs.exists(self._at(self.path)):
            return 0, {}
        names = [f.getPath().getName() for f in self.fs.listStatus(self._at(self.path))]
        n = max((int(x[:-5]) for x in names if re.fullmatch(r"\d+\.json", x)), default=0)
        if not n:
            return 0, {}
        stream = self.fs.open(self._at(f"{self.path}/{n:020d}.json"))
        try:
            return n, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, n: int, tables: dict[str, list[str]]) -> None:
        from py4j.protocol import Py4JJavaError

        name, data = f"{self.path}/{n:020d}.json", json.dumps(tables).encode()
        self.fs.mkdirs(self._at(self.path))
        local = self.fs.getUri().getScheme() == "file"
        own = f"{self.path}/_{uuid.uuid4().hex}" if local else name
        try:
            out = self.fs.create(self._at(own), False)
            out.write(data)
            out.close()
            if local:
                file = lambda x: self.jvm.java.io.File(self.fs.makeQualified(self._at(x)).toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(file(name), file(own))
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {n} is taken") from None
            raise
        finally:
            if local:
                self.fs.delete(self._at(own), False)


class Catalog:
    """Subjects and experiments as parquet folders under a log of versions; adding writes the new rows alone."""

    TRIES = 40

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/_log")

    def _latest(self) -> tuple[int, dict[str, list[str]]]:
        n, tables = self.log.latest()
        return (n, tables) if n else (0, self._before_the_log())

    def _before_the_log(self) -> dict[str, list[str]]:
        """The tables of a catalog that was written before it had a log."""
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.schema("name string, version long").parquet(f"{self.path}/versions").groupBy("name").agg(F.max("version").alias("v")).collect()
        except AnalysisException:
            return {}
        return {r.name: [f"{self.path}/{r.name}/v{r.v}"] for r in rows}

    def _read(self, name: str, kind: str, tables: dict | None = None) -> DataFrame:
        found = (self._latest()[1] if tables is None else tables).get(name)
        return self.spark.read.option("mergeSchema", True).parquet(*found) if found else self.spark.createDataFrame([], kind)

    def _change(self, made) -> object:
        """Commits ``made(tables)``: (result, {table: (rows, whether they are added to it or stand for it)}); anew if another came first."""
        for k in range(self.TRIES):
            n, tables = self._latest()
            result, new = made(tables)
            after = dict(tables)
            for name, (df, added) in new.items():
                to = f"{self.path}/{name}/{n + 1}-{uuid.uuid4().hex}"
                df.coalesce(1).write.parquet(to)
                after[name] = [*after.get(name, []), to] if added else [to]
            try:
                self.log.put(n + 1, after)
                return result
            except Conflict:
                time.sleep(0.02 * (k + 1) * random.random())
        raise Conflict(f"{self.TRIES} other changes came first")

    def subjects(self) -> DataFrame:
        return self._read("subjects", S.SUBJECTS).orderBy(F.desc("created_at"), F.desc("id"))

    def experiments(self, subject_id: int | None = None) -> DataFrame:
        """Latest first, with the code of the subject."""
        e = migrated(self._read("experiments", S.EXPERIMENTS))
        e = e if subject_id is None else e.where(F.col("subject_id") == subject_id)
        s = self._read("subjects", S.SUBJECTS).select(F.col("id").alias("subject_id"), F.col("code").alias("subject_code"))
        return e.join(s, "subject_id").orderBy(F.desc("created_at"), F.desc("id"))

    def _add(self, name: str, kind: str, row: dict, fits=None) -> int:
        def made(tables):
            if fits is not None:
                fits(tables)
            new = (self._read(name, kind, tables).agg(F.max("id")).first()[0] or 0) + 1
            one = self.spark.createDataFrame([{**row, "id": new}], kind).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
            return new, {name: (one, True)}

        return self._change(made)

    def add_subject(self, code: str, age: int | None = None, gender: str | None = None) -> int:
        def fits(tables):
            if not self._read("subjects", S.SUBJECTS, tables).where(F.col("code") == code).isEmpty():
                raise ValueError(f"there is a subject {code}")

        return self._add("subjects", S.SUBJECTS, {"code": code, "age": age, "gender": gender, "created_at": None}, fits)

    def update_subject(self, subject_id: int, **changes) -> None:
        def made(tables):
            t = self._read("subjects", S.SUBJECTS, tables)
            return None, {"subjects": (t.withColumns({c: F.when(F.col("id") == subject_id, F.lit(v)).otherwise(F.col(c)).cast(dict(t.dtypes)[c]) for c, v in changes.items()}), False)}

        self._change(made)

    def delete_subject(self, subject_id: int) -> None:
        """Takes the subject's experiments along, in one version."""
        self._change(lambda tables: (None, {
            "experiments": (self._read("experiments", S.EXPERIMENTS, tables).where(F.col("subject_id") != subject_id), False),
            "subjects": (self._read("subjects", S.SUBJECTS, tables).where(F.col("id") != subject_id), False),
        }))

    def add_experiment(self, subject_id: int, condition: str, date: str | None = None, notes: str | None = None) -> int:
        def fits(tables):
            if self._read("subjects", S.SUBJECTS, tables).where(F.col("id") == subject_id).isEmpty():
                raise ValueError(f"there is no subject {subject_id}")

        return self._add("experiments", S.EXPERIMENTS, {"subject_id": subject_id, "condition": condition, "date": date, "notes": notes, "created_at": None}, fits)

    def set_status(self, experiment_id: int, status: str) -> None:
        def made(tables):
            e = migrated(self._read("experiments", S.EXPERIMENTS, tables))
            return None, {"experiments": (e.withColumn("analysis_status", F.when(F.col("id") == experiment_id, status).otherwise(F.col("analysis_status"))), False)}

        self._change(made)

    def delete_experiment(self, experiment_id: int) -> None:
        self._change(lambda tables: (None, {"experiments": (self._read("experiments", S.EXPERIMENTS, tables).where(F.col("id") != experiment_id), False)}))


def migrated(experiments: DataFrame) -> DataFrame:
    """Adds the columns that older tables lack, with their defaults."""
    for c, (kind, default) in S.EXPERIMENT_ADDITIONS.items():
        if c not in experiments.columns:
            experiments = experiments.withColumn(c, F.lit(default).cast(kind))
        elif default is not None:
            experiments = experiments.withColumn(c, F.coalesce(c, F.lit(default)))
    return experiments
