"""Spectra and what is read off them.

``transform`` is the relational form: windows joined with a table of sines and cosines and summed, for short windows (the table is
size x size/2 rows and is broadcast only below MOST_BINS).  ``densities`` gathers each window into one array and transforms whole
Arrow batches with an FFT, for windows of any length.  Both give (keys, window_idx, bin, freq, power).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from ..functions import kernels as K
from . import series

#: Rows of the table of sines and cosines up to which ``transform`` broadcasts it.
MOST_BINS = 1 << 17


def basis(spark, size: int) -> DataFrame:
    """(in_idx, bin, c, s): periodic Hann taper times cosine and sine."""
    n = F.col("in_idx")
    taper = 0.5 - 0.5 * F.cos(F.lit(2 * math.pi / size) * n)
    angle = F.lit(2 * math.pi / size) * ((n * F.col("bin")) % size)
    grid = spark.range(size).withColumnRenamed("id", "in_idx").crossJoin(spark.range(size // 2 + 1).withColumnRenamed("id", "bin"))
    return grid.select("in_idx", "bin", (taper * F.cos(angle)).alias("c"), (taper * F.sin(angle)).alias("s"))


def density_scale(size: int, fs: float) -> float:
    w = K.hann(size)
    return float(1.0 / (fs * (w * w).sum()))


def transform(windows: DataFrame, keys: list[str], size: int, fs: float) -> DataFrame:
    """Densities of windows given as rows (keys, window_idx, in_idx, value): mean removed, Hann taper, one-sided."""
    by = [*keys, "window_idx"]
    centred = series.remove_mean(windows, by, "value")
    table = basis(windows.sparkSession, size)
    if size * (size // 2 + 1) <= MOST_BINS:
        table = F.broadcast(table)
    sums = centred.join(table, "in_idx").groupBy(*by, "bin").agg(F.sum(F.col("value") * F.col("c")).alias("re"), F.sum(F.col("value") * F.col("s")).alias("im"))
    double = F.when((F.col("bin") == 0) | ((F.lit(size % 2) == 0) & (F.col("bin") == size // 2)), 1.0).otherwise(2.0)
    power = (F.col("re") ** 2 + F.col("im") ** 2) * double * F.lit(density_scale(size, fs))
    return sums.select(*by, "bin", (F.col("bin") * F.lit(fs / size)).alias("freq"), power.alias("power"))


def chunked(samples: DataFrame, keys: list[str], size: int, step: int, least: int = 4096) -> tuple[DataFrame, int]:
    """(keys, chunk, x: array of (i, value)) with every window of ``size`` samples in one chunk, and the windows of a chunk.

    A chunk holds the windows that start in ``least`` samples or so, and the samples that these need beyond: only that overlap is
    sent twice.
    """
    per = max(1, -(-max(size, least) // step))
    span = per * step
    i = F.col("sample_idx")
    own = (i / F.lit(span)).cast("long")
    before = F.when((i % span < size - step) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    rows = samples.where(i >= 0).select(*keys, F.explode(before).alias("chunk"), i.cast("long").alias("i"), F.col("value").cast("double").alias("value"))
    return rows.groupBy(*keys, "chunk").agg(F.collect_list(F.struct("i", "value")).alias("x")), per


def densities(samples: DataFrame, keys: list[str], size: int, step: int, fs: float) -> DataFrame:
    """Densities of the sliding windows of (keys, sample_idx, value); windows with missing or repeated samples are left out.

    Windows are views of chunks, so samples travel once; those of a slice of an Arrow batch go through one FFT call.
    """
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructType, _parse_datatype_string

    chunks, per = chunked(samples, keys, size, step)
    held = [*keys, "window_idx"]
    out = StructType([chunks.schema[c] for c in keys]).add("window_idx", LongType()).add("psd", _parse_datatype_string("array<double>"))
    most = max(1, (1 << 20) // (per * step + size))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                x = part.column("x")
                n = np.diff(x.offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), n)
                chunk = part.column("chunk").to_numpy()
                flat = x.flatten()
                place = flat.field("i").to_numpy() - chunk[row] * per * step
                width = max(int(place.max()) + 1, size)
                dense, seen = np.zeros((len(n), width)), np.zeros((len(n), width), np.int64)
                dense[row, place] = flat.field("value").to_numpy(zero_copy_only=False)
                np.add.at(seen, (row, place), 1)
                ok = np.lib.stride_tricks.sliding_window_view(seen == 1, size, axis=1)[:, ::step][:, :per].all(axis=2)
                r, w = np.nonzero(ok)
                if not len(r):
                    continue
                p = K.segment_psd(np.lib.stride_tricks.sliding_window_view(dense, size, axis=1)[r, w * step], fs)[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
                take = pa.array(r)
                yield pa.record_batch([*[part.column(c).take(take) for c in keys], pa.array(chunk[r] * per + w), lists], names=[*held, "psd"])

    psd = chunks.mapInArrow(run, out)
    psd = psd.select(*held, F.posexplode("psd").alias("bin", "power"))
    return psd.select(*held, F.col("bin").cast("long").alias("bin"), (F.col("bin") * F.lit(fs / size)).alias("freq"), "power")


def mean_density(psd: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin, freq, power): mean over everything else (windows, channels)."""
    return psd.groupBy(*keys, "bin", "freq").agg(F.avg("power").alias("power"))


def in_bands(psd: DataFrame) -> DataFrame:
    """Joins the band of each frequency, half open; frequencies in no band are dropped."""
    b = F.broadcast(S.bands(psd.sparkSession))  # five rows
    return psd.join(b, (F.col("freq") >= F.col("lo")) & (F.col("freq") < F.col("hi")))


def _shares() -> list:
    part = lambda lo, hi: F.sum(F.when((F.col("freq") >= lo) & (F.col("freq") < hi), F.col("power")).otherwise(0.0))
    return [(part(lo, hi) / (F.sum("power") + S.TINY)).alias(b) for b, (lo, hi) in S.BANDS.items()]


def _entropy():
    # -sum p ln p with p = power / total, brought to sums over the powers themselves
    total = F.sum("power") + S.TINY
    return ((F.ln(total) * F.sum("power") - F.sum(F.when(F.col("power") > 0, F.col("power") * F.ln("power")).otherwise(0.0))) / total).alias("entropy")


def relative_powers(psd: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, one column for each band): share of the whole power."""
    return psd.groupBy(*keys).agg(*_shares())


def entropy(psd: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entropy): Shannon entropy of the normalised density, in nats."""
    return psd.groupBy(*keys).agg(_entropy())


def powers_and_entropy(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Both in one pass over the densities."""
    return psd.groupBy(*keys).agg(*_shares(), _entropy())


def band_table(psd: DataFrame, keys: list[str], df: float) -> DataFrame:
    """(keys, band, abs_power, rel_percent, peak_freq, edge_freq): edge is where 95 % of the band's power is reached."""
    total = psd.groupBy(*keys).agg((F.sum("power") * df).alias("total"))
    w = W.partitionBy(*keys, "band").orderBy("freq")
    rows = in_bands(psd).withColumn("cum", F.sum("power").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("power").over(W.partitionBy(*keys, "band")))
    best = F.max(F.struct(F.col("power"), (-F.col("freq")).alias("f")))
    edge = F.coalesce(F.min(F.when(F.col("cum") >= 0.95 * F.greatest("all", F.lit(S.TINY)), F.col("freq"))), F.max("freq"))
    out = rows.groupBy(*keys, "band").agg((F.sum("power") * df).alias("abs_power"), (-best["f"]).alias("peak_freq"), edge.alias("edge_freq"))
    return out.join(total, keys).withColumn("rel_percent", F.col("abs_power") / (F.col("total") + S.TINY) * 100).drop("total")


def aperiodic(psd: DataFrame, keys: list[str], low: float = 3.0, high: float = 40.0) -> DataFrame:
    """(keys, slope, intercept, r_squared) of the line through log power over log frequency; slope with its sign turned."""
    rows = psd.where((F.col("freq") >= low) & (F.col("freq") <= high) & (F.col("power") > 0) & (F.col("freq") > 0))
    rows = rows.select(*keys, F.log10("freq").alias("x"), F.log10("power").alias("y"))
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    rest = F.col("syy") - F.col("a") * F.col("sxy")
    fine = F.col("n") >= 2
    return got.select(*keys, F.when(fine, -F.col("a")).otherwise(0.0).alias("slope"), F.when(fine, F.col("b")).otherwise(0.0).alias("intercept"), F.when(fine, 1 - rest / (F.col("syy") + S.TINY)).otherwise(0.0).alias("r_squared"))


def compare(table: DataFrame, condition: str, conditions: list) -> DataFrame:
    """Band x condition matrix of relative power, zero where one is missing."""
    return table.groupBy("band").pivot(condition, conditions).agg(F.first("rel_percent")).na.fill(0.0)


def spectrogram(psd: DataFrame, keys: list[str], size: int, step: int, fs: float, most_freq: float = 45.0) -> DataFrame:
    """(keys, window_idx, t_sec, bin, freq, db): mean over the other columns, in dB."""
    out = psd.where(F.col("freq") <= most_freq).groupBy(*keys, "window_idx", "bin", "freq").agg(F.avg("power").alias("power"))
    t = F.col("window_idx") * F.lit(step / fs) + F.lit(size / fs / 2)
    return out.select(*keys, "window_idx", t.alias("t_sec"), "bin", "freq", (10 * F.log10(F.col("power") + S.TINY)).alias("db"))


def log_axis(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Power at as many logarithmic frequencies as there are positive linear ones, by linear interpolation."""
    pos = psd.where("freq > 0")
    span = pos.groupBy(*keys).agg(F.min("freq").alias("f0"), F.max("freq").alias("f1"), F.count(F.lit(1)).alias("n"), F.max(F.col("freq") / F.col("bin")).alias("df"), F.min("bin").alias("b0"), F.max("bin").alias("b1"))
    grid = span.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    f = F.pow(F.lit(10.0), F.log10("f0") + (F.log10("f1") - F.log10("f0")) * F.col("k") / (F.col("n") - 1))
    grid = grid.withColumn("lf", f).withColumn("lb", F.least(F.greatest(F.floor(F.col("lf") / F.col("df") + 1e-9), F.col("b0")), F.col("b1")))
    low = pos.select(*keys, F.col("bin").alias("lb"), F.col("power").alias("p0"), F.col("freq").alias("g0"))
    high = pos.select(*keys, (F.col("bin") - 1).alias("lb"), F.col("power").alias("p1"))
    j = grid.join(low, [*keys, "lb"]).join(high, [*keys, "lb"], "left")
    p = F.col("p0") + (F.coalesce("p1", "p0") - F.col("p0")) * (F.col("lf") - F.col("g0")) / F.col("df")
    return j.select(*keys, "k", F.col("lf").alias("freq"), p.alias("power"))
