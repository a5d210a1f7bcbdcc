"""How named queries are declared, and the signal tables they read.

A query is a function (spark, sf_dir) -> DataFrame with, where SQL can express it, the text that DuckDB runs for the same rows.
Computed doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Epochs of 64 samples count as recorded at this rate; bins are 2 Hz apart.
RATE, SIZE = 128.0, 64


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(Tables(spark, sf_dir)), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places, minus zero to zero, row numbers to long, as the other engine has them."""
    cols = []
    for c, t in df.dtypes:
        x = F.col(c)
        cols.append((F.round(x, digits) + 0.0).alias(c) if t == "double" else x.cast("long").alias(c) if t in ("int", "smallint", "tinyint") else x)
    return df.select(*cols)


class Tables:
    """Driver tables, and their reading as signals.

    ``epochs``: each embedding is 64 samples of one channel; its label is the recording.  ``series``: the events of a user, in order,
    are one channel; the user is the recording.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def epochs(self) -> DataFrame:
        """(vec_id, label, sample_idx, value)"""
        e = self.table("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("sample_idx", "value"))
        return e.select("vec_id", F.col("label").cast("long").alias("label"), F.col("sample_idx").cast("long").alias("sample_idx"), F.col("value").cast("double").alias("value"))

    def channels(self) -> DataFrame:
        """Epochs with the vector as channel of the recording ``label``."""
        return self.epochs().withColumnRenamed("vec_id", "channel_idx")

    def series(self) -> DataFrame:
        """(user_id, sample_idx, value, event_id, event_type, ts, props)"""
        w = W.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").withColumn("sample_idx", (F.row_number().over(w) - 1).cast("long"))

    def one_channel(self) -> DataFrame:
        return self.series().select("user_id", "sample_idx", F.lit(0).alias("channel_idx"), "value")


EPOCHS = "e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
SERIES = "u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
DENSITY = f"""{EPOCHS},
c AS (SELECT vec_id, label, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM e),
g AS (SELECT c.*, k, 0.5 - 0.5 * cos(2 * pi() * i / 64) AS w, 2 * pi() * i * k / 64 AS a FROM c CROSS JOIN (SELECT unnest(range(33)) AS k)),
p AS (SELECT vec_id, label, k, 2.0 * k AS f, (pow(sum(v * w * cos(a)), 2) + pow(sum(v * w * sin(a)), 2)) * (CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) / (128 * sum(w * w)) AS power FROM g GROUP BY vec_id, label, k),
m AS (SELECT label, k, f, avg(power) AS power FROM p GROUP BY label, k, f)"""
BANDS_SQL = "bands AS (SELECT * FROM (VALUES ('delta', 1.0, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 45.0)) t(band, lo, hi))"
