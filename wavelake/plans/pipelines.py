"""Whole analyses of recordings: flow recovery, spectrum, event-locked averages, time-frequency and artifacts, and the batch over
many recordings.  Every step is relational over all recordings at once; a recording that fails gives a row with its error."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import kernels as K
from ..operators import artifacts as A
from ..operators import epochs as P
from ..operators import recovery as R
from ..operators import series as Q
from ..operators import spectral as X
from ..operators import timefreq as T
from ..sources.scratch import staged

REC = ["recording_id"]


def preprocess(samples: DataFrame, fs: float, lp: float = 45.0, hp: float = 1.0, notch: float | None = 50.0, limit: float = 100.0) -> DataFrame:
    """(recording_id, sample_idx, channel_idx, value, error, artifact): filtered, and points beyond the limit interpolated."""
    by = ["recording_id", "channel_idx"]
    clean = T.cleaned(samples, by, fs, lp, hp, notch).withColumn("artifact", F.abs("value") > limit)
    return Q.interpolate(clean, by, "sample_idx", "value", F.coalesce(F.col("artifact"), F.lit(False)))


def flow(samples: DataFrame, events: DataFrame, fs: float, smooth: int = 7, tolerance: float = 0.05, hold_sec: float = 30.0, **filters) -> DataFrame:
    """(recording_id, recovery_time, n_unrecovered, artifact_ratio, recovery_per_feature, attenuation, baseline_means, error)."""
    clean = staged(preprocess(samples, fs, **filters), "clean")
    feats = staged(R.features(clean.where("error IS NULL"), REC, fs, smooth=smooth), "features")
    long = R.long_form(feats, REC)
    phases = R.intervals(events, REC, "t_sec")
    base = R.baseline(long, phases, REC)
    rec = R.recovery(long, phases, base, REC, tolerance, hold_sec)
    att = R.attenuation(long, phases, base, REC)
    per = rec.join(att, [*REC, "indicator"]).join(base, [*REC, "indicator"])
    as_map = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("indicator", v))))
    got = per.groupBy(*REC).agg(as_map("recovery_sec").alias("recovery_per_feature"), as_map("attenuation").alias("attenuation"), as_map("base").alias("baseline_means"))
    share = clean.groupBy(*REC, "channel_idx").agg(F.avg(F.col("artifact").cast("double")).alias("r"), F.first("error", True).alias("e"))
    share = share.groupBy(*REC).agg(F.avg("r").alias("artifact_ratio"), F.first("e", True).alias("error"))
    return share.join(got.join(R.overall(rec, REC), REC), REC, "left")


def spectrum(samples: DataFrame, fs: float, nperseg: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Band table and aperiodic fit of each recording."""
    psd = X.mean_density(X.densities(samples, [*REC, "channel_idx"], nperseg, nperseg // 2, fs), REC)
    return X.band_table(psd, REC, fs / nperseg), X.aperiodic(psd, REC)


def event_average(samples: DataFrame, events: DataFrame, fs: float, event_id: str = "X0", pre_sec: float = 1.0, post_sec: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Average waveform and its components, after the baseline from the start of the epoch to 0.2 s before the event."""
    pre, post = int(pre_sec * fs), int(post_sec * fs)
    ep = P.cut(samples, P.average_anchors(events, REC, event_id, fs), REC, pre, post)
    wave = P.average(P.correct(ep, REC, 0, round((pre_sec - 0.2) * fs)), REC)
    return wave, P.components(wave, REC, fs, pre)


def time_frequency(samples: DataFrame, events: DataFrame, fs: float, event_id: str = "X0", pre_sec: float = 2.0, post_sec: float = 5.0, freqs=None, delayed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Perturbation in dB, and phase locking over epochs."""
    pre, post = int(pre_sec * fs), int(post_sec * fs)
    lengths = samples.groupBy(*REC).agg((F.max("sample_idx") + 1).alias("n"))
    ep = P.cut(samples, P.spectral_anchors(events, lengths, REC, event_id, fs, pre, post), REC, pre, post)
    coef = T.coefficients(ep, [*REC, "epoch_idx", "channel_idx"], "rel_idx", fs, freqs, delayed)
    return T.perturbation(T.epoch_power(coef, REC), REC, (0, round((pre_sec - 0.2) * fs))), T.phase_locking(coef, REC)


def topography(spark: SparkSession, values: dict[str, float], points: int = 30, weights: bool = False) -> DataFrame:
    """(x, y, z) over the scalp from one value for each electrode; the electrodes are a fixed list, solved on the driver.

    ``weights``: by inverse distances, as is done with fewer than three electrodes.
    """
    at = [POSITIONS[c] for c in values]
    grid = np.linspace(-1, 1, points)
    make = K.distance_surface if weights or len(at) < 3 else K.radial_surface
    z = make([p[0] for p in at], [p[1] for p in at], list(values.values()), grid)
    return spark.createDataFrame([(float(x), float(y), float(z[j, i])) for j, y in enumerate(grid) for i, x in enumerate(grid)], "x double, y double, z double")


def surfaces(values: DataFrame, keys: list[str], electrodes: list[str], points: int = 30, weights: bool = False) -> DataFrame:
    """(keys, x, y, z): the surface over the scalp of each key, from rows (keys, electrode, value) with one value for each electrode.

    A surface is linear in the values, so each point's share of every electrode is worked out once from their places alone; that table
    (points squared times electrodes, whatever the data) is joined with the values.  Keys that lack an electrode have no surface.
    """
    grid = np.linspace(-1, 1, points)
    px, py = zip(*[POSITIONS[e] for e in electrodes], strict=True)
    make = K.distance_surface if weights or len(electrodes) < 3 else K.radial_surface
    shares = [make(px, py, np.eye(len(electrodes))[k], grid) for k in range(len(electrodes))]
    rows = [(e, [float(v) for v in z.ravel()]) for e, z in zip(electrodes, shares, strict=True)]
    table = F.broadcast(values.sparkSession.createDataFrame(rows, "electrode string, share array<double>"))
    v = values.join(table, "electrode").select(*keys, "electrode", "value", F.posexplode("share").alias("cell", "share"))
    z = v.groupBy(*keys, "cell").agg(F.sum(F.col("share") * F.col("value")).alias("z"), F.countDistinct("electrode").alias("n")).where(F.col("n") == len(electrodes))
    at = lambda i: F.lit(-1.0) + i * (2.0 / (points - 1))
    return z.select(*keys, at(F.col("cell") % points).alias("x"), at(F.floor(F.col("cell") / points)).alias("y"), "z")


def _ring(r: float, degrees: float) -> tuple[float, float]:
    return r * math.sin(math.radians(degrees)), r * math.cos(math.radians(degrees))


# Places of electrodes on the unit disc, nose up.
POSITIONS = {
    "Fp1": (-0.3, 0.8), "Fp2": (0.3, 0.8), "Fpz": (0.0, 0.85), "C3": (-0.7, 0.0), "C4": (0.7, 0.0), "Pz": (0.0, -0.6), "O1": (-0.4, -0.8), "O2": (0.4, -0.8),
    "Fz": (0.0, 0.5), "F3": (-0.35, 0.45), "F4": (0.35, 0.45), "P3": (-0.5, -0.35), "P4": (0.5, -0.35), "T3": (-0.85, -0.1), "T4": (0.85, -0.1),
}
#: Others of the 10-20 system: outer ring at 0.9, inner electrodes half way.
POSITIONS |= {
    "F7": _ring(0.9, -54), "F8": _ring(0.9, 54), "T7": _ring(0.9, -90), "T8": _ring(0.9, 90), "P7": _ring(0.9, -126), "P8": _ring(0.9, 126), "Oz": _ring(0.9, 180),
    "Cz": (0.0, 0.0), "FCz": _ring(0.225, 0),
}


#: Fixed value: seconds that a recording without recovery counts as when it is compared.
NO_RECOVERY = 600.0

MODULES = ("flow", "spectrum", "event_average", "time_frequency", "artifact")


def batch(samples: DataFrame, events: DataFrame, fs: float, event_id: str = "X0") -> DataFrame:
    """(recording_id, module, status, error) of the five modules for every recording.

    A recording that a module makes nothing of (no event, too short, not to be filtered) is a failed row of that module and leaves the
    others alone.
    """
    recs = samples.select(*REC).distinct()
    f = flow(samples, events, fs).select(*REC, F.col("error"), F.lit(True).alias("made"))
    some = lambda df: df.select(*REC).distinct().select(*REC, F.lit(None).cast("string").alias("error"), F.lit(True).alias("made"))
    made = {
        "flow": f, "spectrum": some(spectrum(samples, fs)[0]), "event_average": some(event_average(samples, events, fs, event_id)[0]),
        "time_frequency": some(time_frequency(samples, events, fs, event_id)[0]), "artifact": some(A.signal_stats(samples, REC)),
    }
    out = None
    for name in MODULES:
        part = recs.join(made[name], REC, "left").select(*REC, F.lit(name).alias("module"), F.when(F.col("made").isNull(), "no result").otherwise(F.col("error")).alias("error"))
        out = part if out is None else out.unionByName(part)
    return out.select(*REC, "module", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error")


def report(flow_results: DataFrame, control: str | None = "AtoA") -> DataFrame:
    """(recording_id, line_no, line): Markdown lines of each recording: findings, its six indicators, conclusions and suggestions.

    ``control``: the recording whose recovery time the others are compared with; one that does not recover counts as NO_RECOVERY
    seconds there.  Indicators without an attenuation count as 0 in the means.
    """
    from ..functions import rules as L
    from ..sources.writers import markdown_row

    r = flow_results.where("baseline_means IS NOT NULL")
    base = r.where(F.col("recording_id") == control).select(F.coalesce("recovery_time", F.lit(0.0)).alias("control_time"))
    r = r.join(base.agg(F.first("control_time").alias("control_time")), how="cross")  # one row
    att, rt = F.col("attenuation"), F.col("recovery_time")
    of = lambda names: F.array_compact(F.array(*[att[n] for n in names]))
    flow_att, loss_att = of(S.FLOW_INDICATORS), of(S.LOSS_INDICATORS)
    mean = lambda names: sum((F.coalesce(att[n], F.lit(0.0)) for n in names), F.lit(0.0)) / len(names)
    long = lambda x: F.when(x > 0, x).otherwise(NO_RECOVERY)
    head = F.array(
        F.concat(F.lit("## "), F.col("recording_id")), F.concat(F.lit("Recovery: "), F.when(rt.isNotNull(), F.format_string("%.0f s, ", rt)).otherwise(""), L.recovery_class(rt)),
        F.format_string("Artifacts: %.1f %%", F.col("artifact_ratio") * 100), F.lit("| indicator | baseline | attenuation % | recovery s |"), F.lit("| --- | --- | --- | --- |"),
    )
    rows = F.array(*[
        markdown_row(F.lit(k), F.format_string("%.4f", F.coalesce(F.col("baseline_means")[k], F.lit(0.0))), F.format_string("%.1f", F.coalesce(att[k], F.lit(0.0))), F.when(F.col("recovery_per_feature")[k].isNotNull(), F.format_string("%.0f", F.col("recovery_per_feature")[k])).otherwise("-"))
        for k in S.FEATURES
    ])
    conclusions = F.array_compact(F.array(
        F.lit("### Conclusions"), F.concat(F.lit("- recovery is "), L.recovery_class(rt)), F.concat(F.lit("- flow indicators: "), L.attenuation_class(mean(S.FLOW_INDICATORS))),
        F.concat(F.lit("- load indicators: "), L.attenuation_class(mean(S.LOSS_INDICATORS), flow=False)),
        F.when((F.col("recording_id") != control) & F.col("control_time").isNotNull(), F.concat(F.lit("- recovery is "), L.against_control(long(rt) - long(F.col("control_time"))), F.lit(" than in the control"))),
    )) if control else F.array(F.lit("### Conclusions"), F.concat(F.lit("- recovery is "), L.recovery_class(rt)))
    advice = F.concat(F.array(F.lit("### Suggestions")), F.transform(L.suggestions(rt, flow_att, loss_att), lambda x: F.concat(F.lit("- "), x)))
    return r.select("recording_id", F.posexplode(F.concat(head, rows, conclusions, advice)).alias("line_no", "line"))


def study(spark: SparkSession, seconds: float = 1500.0, fs: int = 250, channels: int = 3, conditions: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples and events of one generated recording for each condition (all by default)."""
    from ..sources import synthetic

    table = [(c, d, s) for c, (d, s) in S.CONDITIONS.items() if conditions is None or c in conditions]
    recs = spark.createDataFrame([(c,) for c, _, _ in table], "recording_id string")
    return synthetic.recordings(spark, table, fs, seconds, channels), recs.crossJoin(F.broadcast(S.default_events(spark)))
