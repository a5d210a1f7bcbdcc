"""Generated recordings, and a streaming source of generated board frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

#: Steady amplitudes and their change by one unit of disruption.
STEADY = {"delta": 0.15, "theta": 0.22, "alpha": 0.35, "beta": 0.28, "gamma": 0.08}
SHIFT = {"delta": 0.0, "theta": 0.06, "alpha": -0.17, "beta": 0.10, "gamma": 0.14}


def recordings(spark: SparkSession, table: list[tuple[str, float, int]], fs: int = 250, seconds: float = 1500.0, channels: int = 3, tones: int = 10, block: int = 10_000) -> DataFrame:
    """``samples`` of (recording_id, disruption, seed): five bands of tones under piecewise linear envelopes, plus noise.

    Blocks of samples are generated where they are used, each from its own seed, so the result does not depend on tasks.
    """
    n = int(fs * seconds)
    recs = spark.createDataFrame([(r, float(d), int(s)) for r, d, s in table], "recording_id string, d double, seed long")
    blocks = spark.range(-(-n // block)).withColumnRenamed("id", "block")
    chans = spark.range(channels).select(F.col("id").cast("int").alias("channel_idx"))
    jobs = blocks.crossJoin(F.broadcast(recs)).crossJoin(F.broadcast(chans))  # a few rows each

    def make(batches):
        for jobs_ in batches:
            for j in jobs_.itertuples(index=False):
                i = np.arange(j.block * block, min(n, (j.block + 1) * block))
                t = i / fs
                phase = np.random.default_rng([j.seed, j.channel_idx]).uniform(0, 2 * np.pi, (len(S.BANDS), tones))
                noise = np.random.default_rng([j.seed, j.channel_idx, j.block])
                value = noise.normal(0, 0.5, len(i))
                for b, (name, (lo, hi)) in enumerate(S.BANDS.items()):
                    steady, switched = STEADY[name], STEADY[name] + SHIFT[name] * j.d
                    # Times and levels of the envelope, share of noise, amplitude of all tones of a band.
                    env = np.interp(t, [0, 60, 300, 540, 545, 665, 725 + 120 * j.d], [0.25, 0.25, steady, steady, switched, switched, steady])
                    for k, f in enumerate(np.linspace(lo + 0.5, hi - 0.5, tones)):
                        value += env * (1 + noise.normal(0, 0.015, len(i))) * np.sin(2 * np.pi * f * t + phase[b, k]) * (50.0 / tones)
                yield pd.DataFrame({"recording_id": j.recording_id, "sample_idx": i, "t_sec": t, "channel_idx": np.int32(j.channel_idx), "channel": f"ch{j.channel_idx}", "value": value})

    return jobs.repartition(F.col("recording_id"), F.col("channel_idx"), F.col("block")).mapInPandas(make, S.SAMPLES)


def register_board(spark: SparkSession) -> None:
    """Registers the streaming source ``synthetic_board``: options fs, channels, batch (samples of a micro-batch)."""
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options):
            self.fs, self.channels, self.batch = int(options.get("fs", 250)), int(options.get("channels", 8)), int(options.get("batch", 50))

        def initialOffset(self):
            return {"at": 0}

        def _rows(self, a, b):
            import datetime as dt
            import math as m

            zero = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
            for i in range(a, b):
                yield (i, i % 256, zero + dt.timedelta(seconds=i / self.fs), [50 * m.sin(2 * m.pi * (10 + c) * i / self.fs) for c in range(self.channels)])

        def read(self, start):
            end = start["at"] + self.batch
            return iter(list(self._rows(start["at"], end))), {"at": end}

        def readBetweenOffsets(self, start, end):
            return self._rows(start["at"], end["at"])

    class Board(DataSource):
        @classmethod
        def name(cls):
            return "synthetic_board"

        def schema(self):
            return "seq long, package int, ts timestamp, channels array<double>"

        def simpleStreamReader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Board)
