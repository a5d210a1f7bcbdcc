"""Queries of operators with numerical kernels; these have no SQL form and are tested against independent formulas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import kernels as K
from ..functions import learning
from ..operators import artifacts as A
from ..operators import statistics as X
from ..operators import timefreq as T
from .. import schema as S
from . import pipelines, signals
from .base import EPOCHS, RATE, SIZE, query


def _label_series(t):
    """All epochs of a label one after another, as one channel of a recording."""
    e = t.epochs().withColumn("n", F.dense_rank().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    return e.select(F.col("label").cast("string").alias("recording_id"), (F.col("n") * SIZE + F.col("sample_idx")).alias("sample_idx"), F.lit(0).alias("channel_idx"), "value")


@query("w16_zero_phase_filter")
def w16(t):
    return T.cleaned(_label_series(t), ["recording_id", "channel_idx"], RATE, 45.0, 1.0, 50.0).select("recording_id", "sample_idx", "value")


@query("w17_analytic_signal")
def w17(t):
    return T.phase_and_amplitude(_label_series(t), ["recording_id"], RATE)


@query("a20_phase_amplitude_coupling")
def a20(t):
    return T.coupling(T.phase_and_amplitude(_label_series(t), ["recording_id"], RATE), ["recording_id"])


def _epochs(t):
    """Each vector is one epoch of one channel, as it stands in the table."""
    x = F.array(F.col("embedding").cast("array<double>"))
    return t.table("embeddings").select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("epoch_idx"), x.alias("x"))


def _means(t):
    return T.mean_grids(_epochs(t), ["label"], RATE, K.log_grid(4, 45))


@query("w18_wavelet_power")
def w18(t):
    return _means(t).groupBy("label", "freq_idx", "freq").agg(F.avg("power").alias("power"))


@query("a17_perturbation")
def a17(t):
    return T.perturbation(_means(t), ["label"], (0, 15))


@query("a18_desynchronisation")
def a18(t):
    return T.desynchronisation(T.perturbation(_means(t), ["label"], (0, 15)), ["label"], 0.5)


@query("a19_phase_locking")
def a19(t):
    return _means(t).drop("power")


@query("a32_time_frequency_permutation")
def a32(t):
    return T.permuted(_epochs(t), ["label"], RATE, K.log_grid(4, 45), base=(0, 15))


@query("w19_resampled")
def w19(t):
    return T.resampled(_label_series(t), ["recording_id"], 128, 64)


@query("w20_independent_components")
def w20(t):
    n = F.dense_rank().over(W.partitionBy("recording_id").orderBy("vec_id")) - 1
    four = t.epochs().withColumn("recording_id", (F.col("label") % 2).cast("string")).withColumn("n", n)
    four = four.select("recording_id", (F.expr("sample_idx div 4") + F.col("n") * 16).alias("sample_idx"), (F.col("sample_idx") % 4).cast("int").alias("channel_idx"), "value")
    parts = A.decompose(four, ["recording_id"])
    return A.classified(parts, ["recording_id"], RATE, 64).select("recording_id", "component", "kind", "confidence", "spectral_slope")


@query("f05_scored_windows")
def f05(t):
    w = t.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return learning.focus(learning.scores(w, ["vec_id"], lambda m: 1 / (1 + (m * m).mean(axis=1))).withColumn("all", F.lit("all")), ["all"])


ELECTRODES = ["Fp1", "Fp2", "C3", "C4", "Pz", "O1", "O2", "Fz"]


def _eight(t, value):
    name = F.get(F.array(*[F.lit(e) for e in ELECTRODES]), (F.col("sample_idx") % 8).cast("int"))
    return t.epochs().groupBy(name.alias("electrode")).agg(F.avg(value).alias("value"))


@query("f07_topography")
def f07(t):
    """Eight electrodes, each the mean magnitude of every eighth sample of all epochs."""
    return pipelines.surfaces(_eight(t, F.abs("value")), [], ELECTRODES)


_PLACES = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(pipelines.POSITIONS[e] for e in ELECTRODES))


@query(
    "x13_distance_surface",
    f"""WITH {EPOCHS}, m AS (SELECT i % 8 AS c, avg(v) AS v FROM e GROUP BY 1), p AS (SELECT * FROM (VALUES {_PLACES}) t(c, px, py)), g AS (SELECT -1.0 + i * 2.0 / 29 AS x, -1.0 + j * 2.0 / 29 AS y FROM range(30) a(i), range(30) b(j)),
w AS (SELECT x, y, v, 1 / pow(greatest(sqrt(pow(x - px, 2) + pow(y - py, 2)), 1e-9), 2) AS w FROM g CROSS JOIN p JOIN m USING (c))
SELECT round(x, 6) AS x, round(y, 6) AS y, round(sum(v * w) / sum(w), 6) AS z FROM w GROUP BY w.x, w.y""",
)
def x13(t):
    return pipelines.surfaces(_eight(t, F.col("value")), [], ELECTRODES, weights=True)


@query("a36_whole_comparison")
def a36(t):
    """Prices of open orders against those of finished ones, by priority, paired in order of their keys."""
    o = t.table("orders").where("o_orderstatus IN ('O', 'F')").select(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("g"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").cast("double").alias("value"))
    return X.rigorous(o, ["metric"], "g", "O", "F", "i")


@query("x04_study_report")
def x04(t):
    """The report of a study whose flow results are summed up from orders: a recording for each priority."""
    o = t.table("orders").groupBy(F.col("o_orderpriority").alias("recording_id")).agg(F.avg("o_totalprice").alias("m"), F.stddev_pop("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    each = lambda f: F.map_from_arrays(F.array(*[F.lit(k) for k in S.FEATURES]), F.array(*[f(i) for i in range(len(S.FEATURES))]))
    flow = o.select(
        "recording_id", (F.col("m") / 1000).alias("recovery_time"), (F.col("n") % 10 / 100).alias("artifact_ratio"), each(lambda i: F.col("m") / (1 + i)).alias("baseline_means"),
        each(lambda i: F.col("s") / F.col("m") * 10 * (1 + i)).alias("attenuation"), each(lambda i: F.when(F.lit(i % 3 != 2), F.col("n") / (1.0 + i))).alias("recovery_per_feature"),
    )
    return pipelines.report(flow, "1-URGENT").select("recording_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("f06_predicted_windows")
def f06(t):
    """A model of the window labels from the features of all epochs, fitted, kept and loaded again."""
    from ..sources.scratch import folder

    feats = learning.features(signals.density(t), t.epochs(), ["vec_id"]).join(signals.a39(t).select("vec_id", "target"), "vec_id")
    path = folder(t.spark, "model")
    learning.save_model(learning.classifier(feats.repartition(4)), path)
    return learning.predicted(learning.load_model(path), feats).select("vec_id", "target", "prediction")


@query("p21_muted_components")
def p21(t):
    four = t.epochs().select(F.lit("r").alias("recording_id"), (F.expr("sample_idx div 4") + F.col("vec_id") * 16).alias("sample_idx"), (F.col("sample_idx") % 4).cast("int").alias("channel_idx"), "value")
    return A.without_components(four, A.decompose(four, ["recording_id"]), ["recording_id"], [0])
