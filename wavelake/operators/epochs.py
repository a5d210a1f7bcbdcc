"""Event-locked epochs: anchors, extraction by equi-join, baseline, averages, components.

An epoch takes samples [anchor - pre, anchor + post).  Anchors are turned into the sample numbers they need, so the range join
with the samples is an equi-join on (recording, sample) that AQE can split; epochs may overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import series


def average_anchors(events: DataFrame, keys: list[str], event_id: str, fs: float, radius: float = 30.0, every: float = 10.0) -> DataFrame:
    """(keys, anchor, is_pseudo): a single event gives anchors every 10 s from 30 s before to 30 s after; sample numbers are rounded
    half to even."""
    hit = events.where(F.col("event_id") == event_id).withColumn("n", F.count(F.lit(1)).over(series.whole(keys)))
    steps = int(radius / every)
    spread = F.when(F.col("n") == 1, F.transform(F.sequence(F.lit(-steps), F.lit(steps)), lambda k: F.col("t_sec") + k * F.lit(every))).otherwise(F.array("t_sec"))
    return hit.select(*keys, F.explode(spread).alias("t"), (F.col("n") == 1).alias("is_pseudo")).select(*keys, F.rint(F.col("t") * fs).cast("long").alias("anchor"), "is_pseudo")


def spectral_anchors(events: DataFrame, lengths: DataFrame, keys: list[str], event_id: str, fs: float, pre: int, post: int) -> DataFrame:
    """(keys, anchor, is_pseudo): events whose epoch fits, truncated to samples; with fewer than two, anchors a quarter epoch apart
    within 2 s of the event, or of the middle of the data if there is none.  ``lengths``: (keys, n)."""
    size = pre + post
    hit = events.where(F.col("event_id") == event_id).select(*keys, F.floor(F.col("t_sec") * fs).cast("long").alias("a")).join(lengths, keys)
    hit = hit.where((F.col("a") >= pre) & (F.col("a") + post <= F.col("n"))).groupBy(*keys).agg(F.array_sort(F.collect_list("a")).alias("as"))
    every = lengths.join(hit, keys, "left").withColumn("k", F.coalesce(F.size("as"), F.lit(0)))
    middle = F.when(F.col("k") <= 0, F.expr("n div 2")).otherwise(F.element_at("as", 1))
    reach, step = min(int(2 * fs), size), max(size // 4, 1)
    offsets = F.filter(F.sequence(F.lit(-reach), F.lit(reach), F.lit(step)), lambda o: (F.col("mid") + o - pre >= 0) & (F.col("mid") + o + post <= F.col("n")))
    every = every.withColumn("mid", middle)
    anchors = F.when(F.col("k") >= 2, F.col("as")).otherwise(F.transform(offsets, lambda o: F.col("mid") + o))
    return every.select(*keys, F.explode(anchors).alias("anchor"), (F.col("k") < 2).alias("is_pseudo"))


def cut(samples: DataFrame, anchors: DataFrame, keys: list[str], pre: int, post: int) -> DataFrame:
    """(keys, epoch_idx, rel_idx, channel_idx, value): whole epochs only; rel_idx counts from the start of the epoch."""
    lengths = samples.groupBy(*keys).agg((F.max("sample_idx") + 1).alias("n"))
    a = anchors.join(lengths, keys).where((F.col("anchor") >= pre) & (F.col("anchor") + post <= F.col("n")))
    a = a.withColumn("epoch_idx", F.row_number().over(series.over(keys, "anchor")) - 1)
    need = a.select(*keys, F.col("epoch_idx").cast("long").alias("epoch_idx"), F.col("anchor"), F.explode(F.sequence(F.col("anchor") - pre, F.col("anchor") + post - 1)).alias("sample_idx"))
    j = need.join(samples, [*keys, "sample_idx"])
    return j.select(*keys, "epoch_idx", (F.col("sample_idx") - F.col("anchor") + pre).alias("rel_idx"), "channel_idx", "value")


def correct(epochs: DataFrame, keys: list[str], start: int, end: int) -> DataFrame:
    """Values less the mean of rel_idx in [start, end) of their epoch and channel; as they are if that is empty."""
    if end <= start:
        return epochs
    w = series.whole([*keys, "epoch_idx", "channel_idx"])
    base = F.avg(F.when((F.col("rel_idx") >= start) & (F.col("rel_idx") < end), F.col("value"))).over(w)
    return epochs.withColumn("value", F.col("value") - F.coalesce(base, F.lit(0.0)))


def average(epochs: DataFrame, keys: list[str]) -> DataFrame:
    return epochs.groupBy(*keys, "rel_idx", "channel_idx").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_averaged"))


def peak_to_peak(wave: DataFrame, keys: list[str]) -> DataFrame:
    return wave.groupBy(*keys, "channel_idx").agg((F.max("value") - F.min("value")).alias("peak_to_peak"))


def residual(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rmse) of all epochs against their average."""
    w = series.whole([*keys, "rel_idx", "channel_idx"])
    d = F.col("value") - F.avg("value").over(w)
    return epochs.select(*keys, (d * d).alias("d2")).groupBy(*keys).agg(F.sqrt(F.avg("d2")).alias("rmse"))


def lateralisation(wave: DataFrame, keys: list[str], left: int = 0, right: int = 1) -> DataFrame:
    side = lambda c: F.max(F.when(F.col("channel_idx") == c, F.col("value")))
    j = wave.groupBy(*keys, "rel_idx").agg(side(left).alias("l"), side(right).alias("r"))
    out = F.avg(F.abs(F.col("l") - F.col("r"))) / (F.avg(F.abs("l")) + F.avg(F.abs("r")) + S.TINY)
    return j.groupBy(*keys).agg(F.coalesce(out, F.lit(0.0)).alias("lateralization_index"))


def channel_pairs(wave: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rel_idx, channel_a, channel_b, diff) of every two channels."""
    a = wave.select(*keys, "rel_idx", F.col("channel_idx").alias("channel_a"), F.col("value").alias("va"))
    b = wave.select(*keys, "rel_idx", F.col("channel_idx").alias("channel_b"), F.col("value").alias("vb"))
    return a.join(b, [*keys, "rel_idx"]).where("channel_a < channel_b").select(*keys, "rel_idx", "channel_a", "channel_b", (F.col("va") - F.col("vb")).alias("diff"))


def difference_wave(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a - b at the times that both have."""
    on = [*keys, "rel_idx", "channel_idx"]
    return a.select(*on, F.col("value").alias("va")).join(b.select(*on, F.col("value").alias("vb")), on).select(*on, (F.col("va") - F.col("vb")).alias("diff"))


def components(wave: DataFrame, keys: list[str], fs: float, pre: int) -> DataFrame:
    """(keys, component, amplitude, latency_sec, significance): peaks of the mean over channels in each component's window."""
    spark = wave.sparkSession
    rows = [(n, round(a * fs), round(b * fs), 1.0 if pol == "positive" else -1.0) for n, (a, b, pol) in S.COMPONENTS.items()]
    table = spark.createDataFrame(rows, "component string, i0 long, i1 long, sign double")  # nine rows
    mean = wave.groupBy(*keys, "rel_idx").agg(F.avg("value").alias("value")).withColumn("i", F.col("rel_idx") - pre).where("i >= 0")
    seg = mean.join(F.broadcast(table), (F.col("i") >= F.col("i0")) & (F.col("i") < F.col("i1")))
    by = [*keys, "component"]
    smooth = series.quadratic_smooth(seg, by, "i", "value")
    got = series.peak(smooth, [*by, "sign"], "i", "smoothed", F.col("sign"))
    return got.select(*by, "amplitude", (F.col("peak_idx") / F.lit(float(fs))).alias("latency_sec"), "significance")
