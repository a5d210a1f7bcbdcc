"""Queries over windows, spectra, artifacts, epochs and flow metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from ..operators import artifacts as A
from ..operators import epochs as P
from ..operators import recovery as R
from ..operators import series as Q
from ..operators import spectral as X
from .base import BANDS_SQL, DENSITY, EPOCHS, RATE, SERIES, SIZE, Tables, query

U = ["user_id"]


def density(t: Tables):
    """Densities of all epochs: (vec_id, label, window_idx, bin, freq, power)."""
    rows = t.epochs().select("vec_id", "label", F.lit(0).alias("window_idx"), F.col("sample_idx").alias("in_idx"), "value")
    return X.transform(rows, ["vec_id", "label"], SIZE, RATE)


def label_density(t: Tables):
    return X.mean_density(density(t), ["label"])


# -- spectra ---------------------------------------------------------------------------------------------------------


@query("a01_mean_density", f"WITH {DENSITY} SELECT label, k AS bin, f AS freq, round(power, 6) AS power FROM m")
def a01(t):
    return label_density(t)


@query("a01_density_fft", f"WITH {DENSITY} SELECT label, k AS bin, f AS freq, round(power, 6) AS power FROM m")
def a01_fft(t):
    return X.mean_density(X.densities(t.epochs(), ["label", "vec_id"], SIZE, SIZE, RATE), ["label"])


@query(
    "a02_band_table",
    f"""WITH {DENSITY}, {BANDS_SQL},
r AS (SELECT m.*, band, sum(power) OVER (PARTITION BY label, band ORDER BY f) AS cum, sum(power) OVER (PARTITION BY label, band) AS tot FROM m JOIN bands ON f >= lo AND f < hi),
s AS (SELECT label, sum(power) * 2 AS total FROM m GROUP BY label)
SELECT label, band, round(sum(power) * 2, 6) AS abs_power, round(sum(power) * 2 / (any_value(total) + 1e-12) * 100, 6) AS rel_percent,
 arg_max(f, power) AS peak_freq, min(CASE WHEN cum >= 0.95 * tot THEN f END) AS edge_freq FROM r JOIN s USING (label) GROUP BY label, band""",
)
def a02(t):
    return X.band_table(label_density(t), ["label"], RATE / SIZE)


def _rel(extra: str = "") -> str:
    part = ", ".join(f"round(sum(CASE WHEN f >= {lo} AND f < {hi} THEN power ELSE 0 END) / (sum(power) + 1e-12), 6) AS {b}" for b, (lo, hi) in S.BANDS.items())
    return part + extra


@query("a03_relative_powers", f"WITH {DENSITY} SELECT vec_id, {_rel()} FROM p GROUP BY vec_id")
def a03(t):
    return X.relative_powers(density(t), ["vec_id"])


@query(
    "a04_spectral_entropy",
    f"WITH {DENSITY}, q AS (SELECT vec_id, power / (sum(power) OVER (PARTITION BY vec_id) + 1e-12) AS x FROM p) SELECT vec_id, round(-sum(CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END), 6) AS entropy FROM q GROUP BY vec_id",
)
def a04(t):
    return X.entropy(density(t), ["vec_id"])


_WINDOWED = """r AS (SELECT user_id, i, value AS v, max(i) OVER (PARTITION BY user_id) + 1 AS n FROM u),
x AS (SELECT user_id, w, i - w * {step} AS j, v FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((i - {size} + 1) / {step}) AS BIGINT)), least(i // {step}, (n - {size}) // {step}) + 1)) AS w FROM r WHERE n >= {size}))"""


@query(
    "a05_spectrogram",
    f"""WITH {SERIES}, {_WINDOWED.format(size=32, step=8)},
c AS (SELECT user_id, w, j, v - avg(v) OVER (PARTITION BY user_id, w) AS v FROM x),
g AS (SELECT c.*, k, 0.5 - 0.5 * cos(2 * pi() * j / 32) AS h, 2 * pi() * j * k / 32 AS a FROM c CROSS JOIN (SELECT unnest(range(12)) AS k)),
p AS (SELECT user_id, w, k, (pow(sum(v * h * cos(a)), 2) + pow(sum(v * h * sin(a)), 2)) * (CASE WHEN k = 0 THEN 1 ELSE 2 END) / (128 * sum(h * h)) AS power FROM g GROUP BY user_id, w, k)
SELECT user_id, w AS window_idx, w * 0.0625 + 0.125 AS t_sec, k AS bin, 4.0 * k AS freq, round(10 * log10(power + 1e-12), 4) AS db FROM p WHERE k > 0""",
    digits=4,
)
def a05(t):
    # without the mean, whose density is rounding error alone
    psd = X.densities(t.series(), U, 32, 8, RATE).where("bin > 0")
    return X.spectrogram(psd, U, 32, 8, RATE)


@query(
    "a05_log_axis",
    f"""WITH {DENSITY}, n AS (SELECT label, unnest(range(32)) AS k FROM (SELECT DISTINCT label FROM m)),
l AS (SELECT label, k, pow(10, log10(2.0) + (log10(64.0) - log10(2.0)) * k / 31) AS lf FROM n),
b AS (SELECT *, CAST(least(greatest(floor(lf / 2 + 1e-9), 1), 32) AS BIGINT) AS lb FROM l)
SELECT b.label, b.k, round(lf, 6) AS freq, round(x.power + (coalesce(y.power, x.power) - x.power) * (lf - x.f) / 2, 6) AS power
FROM b JOIN m x ON x.label = b.label AND x.k = lb LEFT JOIN m y ON y.label = b.label AND y.k = lb + 1""",
)
def a05_log(t):
    return X.log_axis(label_density(t), ["label"])


@query(
    "a06_aperiodic",
    f"""WITH {DENSITY}, r AS (SELECT label, log10(f) AS x, log10(power) AS y FROM m WHERE f BETWEEN 3 AND 40 AND power > 0)
SELECT label, round(-regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(1 - (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_syy(y, x) + 1e-12), 6) AS r_squared FROM r GROUP BY label""",
)
def a06(t):
    return X.aperiodic(label_density(t), ["label"])


_CONDITIONS = ", ".join(f'round(coalesce(max(CASE WHEN label = {k} THEN rel END), 0), 6) AS "{k}"' for k in range(10))


@query(
    "a07_band_matrix",
    f"""WITH {DENSITY}, {BANDS_SQL}, s AS (SELECT label, sum(power) AS total FROM m GROUP BY label),
r AS (SELECT label, band, sum(power) / (any_value(total) + 1e-12) * 100 AS rel FROM m JOIN bands ON f >= lo AND f < hi JOIN s USING (label) GROUP BY label, band)
SELECT band, {_CONDITIONS} FROM r GROUP BY band""",
)
def a07(t):
    return X.compare(X.band_table(label_density(t), ["label"], RATE / SIZE), "label", list(range(10)))


@query(
    "p03_bands_of_bins",
    f"WITH {BANDS_SQL}, k AS (SELECT o_orderkey % 66 + 0.0 AS freq, count(*) AS n FROM orders GROUP BY 1) SELECT freq, band, CASE WHEN freq BETWEEN 1 AND 45 THEN 'signal' WHEN freq > 45 THEN 'noise' ELSE 'drift' END AS side, n FROM k JOIN bands ON freq >= lo AND freq < hi",
)
def p03(t):
    """Orders as readings of a frequency."""
    k = t.table("orders").groupBy((F.col("o_orderkey") % 66 + F.lit(0.0)).alias("freq")).agg(F.count(F.lit(1)).alias("n"))
    side = F.when(F.col("freq").between(1, 45), "signal").when(F.col("freq") > 45, "noise").otherwise("drift")
    return X.in_bands(k).select("freq", "band", side.alias("side"), "n")


@query(
    "p22_log_grid",
    """WITH s AS (SELECT s_suppkey, CASE WHEN s_nationkey <= 0 THEN 1.0 ELSE CAST(s_nationkey AS DOUBLE) END AS lo, s_nationkey * 2.0 AS top FROM supplier), b AS (SELECT s_suppkey, lo, CASE WHEN top <= lo THEN lo + 1 ELSE top END AS hi FROM s)
SELECT s_suppkey, k AS freq_idx, round(pow(10, log10(lo) + (log10(hi) - log10(lo)) * k / 49), 6) AS freq FROM b CROSS JOIN (SELECT unnest(range(50)) AS k)""",
)
def p22(t):
    """Fifty frequencies in equal ratios between the bounds of each supplier."""
    low = F.when(F.col("s_nationkey") <= 0, 1.0).otherwise(F.col("s_nationkey").cast("double"))
    b = t.table("supplier").select("s_suppkey", low.alias("lo"), (F.col("s_nationkey") * 2.0).alias("top")).withColumn("hi", F.when(F.col("top") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("top")))
    k = b.withColumn("freq_idx", F.explode(F.sequence(F.lit(0), F.lit(49))))
    return k.select("s_suppkey", "freq_idx", F.pow(F.lit(10.0), F.log10("lo") + (F.log10("hi") - F.log10("lo")) * F.col("freq_idx") / 49).alias("freq"))


@query(
    "p23_wavelet_kernel",
    """WITH f AS (SELECT s_suppkey, 1.0 + s_suppkey % 45 AS f FROM supplier), t AS (SELECT (unnest(range(251)) - 125) / 250.0 AS t),
w AS (SELECT s_suppkey, t, exp(-t * t / (2 * pow(5 / (2 * pi() * f), 2))) AS g, 2 * pi() * f * t AS a FROM f CROSS JOIN t),
s AS (SELECT *, g / sqrt(sum(g * g) OVER (PARTITION BY s_suppkey) + 1e-12) AS x FROM w)
SELECT s_suppkey, round(t, 6) AS t, round(x * cos(a), 6) AS re, round(x * sin(a), 6) AS im FROM s""",
)
def p23(t):
    """The kernel of one frequency for each supplier."""
    import math

    f = t.table("supplier").select("s_suppkey", (F.lit(1.0) + F.col("s_suppkey") % 45).alias("f"))
    w = f.withColumn("t", F.explode(F.transform(F.sequence(F.lit(-125), F.lit(125)), lambda i: i / F.lit(250.0))))
    sigma = 5 / (2 * math.pi * F.col("f"))
    w = w.withColumn("g", F.exp(-F.col("t") * F.col("t") / (2 * sigma * sigma)))
    w = w.withColumn("x", F.col("g") / F.sqrt(F.sum(F.col("g") * F.col("g")).over(W.partitionBy("s_suppkey")) + S.TINY))
    a = 2 * math.pi * F.col("f") * F.col("t")
    return w.select("s_suppkey", "t", (F.col("x") * F.cos(a)).alias("re"), (F.col("x") * F.sin(a)).alias("im"))


# -- windows and order -----------------------------------------------------------------------------------------------


@query("w01_sliding_windows", f"WITH {SERIES}, {_WINDOWED.format(size=10, step=5)} SELECT user_id, w AS window_idx, count(*) AS n, round(avg(v), 6) AS mean, round(w * 0.05 + 0.05, 6) AS center FROM x GROUP BY user_id, w")
def w01(t):
    g = Q.sliding(t.series(), U, "sample_idx", 10, 5).groupBy("user_id", "window_idx").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.withColumn("center", Q.window_center(F.col("window_idx"), 10, 5, 100.0))


@query(
    "w02_tumbling_windows",
    f"WITH {SERIES}, r AS (SELECT *, i // 16 AS c, max(i) OVER (PARTITION BY user_id) + 1 AS n FROM u) SELECT user_id, c AS chunk_idx, count(*) AS n, round(sum(value), 6) AS total FROM r WHERE c < n // 16 GROUP BY user_id, c",
)
def w02(t):
    return Q.tumbling(t.series(), U, "sample_idx", 16).groupBy("user_id", "chunk_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("f01_chunks", f"WITH {SERIES} SELECT user_id, i // 60 AS chunk_idx, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM u GROUP BY user_id, i // 60")
def f01(t):
    return Q.tumbling(t.series(), U, "sample_idx", 60, partial=True).groupBy("user_id", "chunk_idx").agg(F.count(F.lit(1)).alias("n"), (F.max("value") - F.min("value")).alias("spread"))


@query("w03_moving_average", f"WITH {SERIES} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS smooth FROM u")
def w03(t):
    return Q.smooth(t.series(), U, "sample_idx", "value", 7, "smooth").select("event_id", "smooth")


@query(
    "w04_first_run",
    f"""WITH {SERIES}, m AS (SELECT user_id, avg(value) AS m FROM u GROUP BY user_id),
r AS (SELECT u.user_id, i, sum(CASE WHEN value BETWEEN m * 0.3 AND m * 1.7 THEN 1 ELSE 0 END) OVER (PARTITION BY u.user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS h FROM u JOIN m USING (user_id))
SELECT user_id, min(CASE WHEN h = 5 THEN i END) AS run_start FROM r GROUP BY user_id""",
)
def w04(t):
    s = t.series().withColumn("m", F.avg("value").over(W.partitionBy("user_id")))
    return Q.first_run(s, U, "sample_idx", F.col("value").between(F.col("m") * 0.3, F.col("m") * 1.7), 5)


@query(
    "w05_segments",
    f"""WITH {SERIES}, r AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM u WHERE value > 100),
s AS (SELECT user_id, min(i) AS "start", max(i) + 1 AS "end" FROM r GROUP BY user_id, g),
q AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n_segments, row_number() OVER (PARTITION BY user_id ORDER BY "start") AS k FROM s)
SELECT user_id, "start", "end", n_segments, n_segments > 10 AS truncated FROM q WHERE k <= 10""",
)
def w05(t):
    return Q.segments(t.series(), U, "sample_idx", F.col("value") > 100, most=10)


@query("w06_dilated_mask", f"WITH {SERIES} SELECT event_id, max(value > 200) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mask FROM u")
def w06(t):
    return Q.dilate(t.series().withColumn("mask", F.col("value") > 200), U, "sample_idx", "mask").select("event_id", "mask")


@query("w07_positive_steps", f"WITH {SERIES}, d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY i) AS d FROM u) SELECT user_id, round(avg(CASE WHEN d > 0 THEN d END), 6) AS step FROM d GROUP BY user_id")
def w07(t):
    return Q.difference(t.series(), U, "sample_idx", "value").groupBy("user_id").agg(F.avg(F.when(F.col("diff") > 0, F.col("diff"))).alias("step"))


@query("w08_cumulative_power", f"WITH {DENSITY} SELECT label, k AS bin, round(sum(power) OVER (PARTITION BY label ORDER BY k), 6) AS cumulative FROM m")
def w08(t):
    return label_density(t).select("label", "bin", F.sum("power").over(W.partitionBy("label").orderBy("bin")).alias("cumulative"))


@query(
    "w10_local_peaks",
    f"""WITH {EPOCHS}, r AS (SELECT vec_id, i, v, v > lag(v) OVER w AND v > lead(v) OVER w AS l FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
q AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY coalesce(l, false) DESC, v DESC, i) AS k, avg(v) OVER (PARTITION BY vec_id) AS m, stddev_pop(v) OVER (PARTITION BY vec_id) AS s FROM r)
SELECT vec_id, round(v, 6) AS amplitude, i AS peak_idx, round((v - m) / (s + 1e-12), 6) AS significance FROM q WHERE k = 1""",
)
def w10(t):
    return Q.peak(t.epochs(), ["vec_id"], "sample_idx", "value", F.lit(1.0))


@query(
    "w11_quadratic_smooth",
    f"""WITH {EPOCHS} SELECT vec_id, i AS sample_idx, round((CASE
 WHEN i = 0 THEN 31 * v + 9 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w - 5 * lead(v, 3) OVER w + 3 * lead(v, 4) OVER w
 WHEN i = 1 THEN 9 * lag(v, 1) OVER w + 13 * v + 12 * lead(v, 1) OVER w + 6 * lead(v, 2) OVER w - 5 * lead(v, 3) OVER w
 WHEN i = 62 THEN -5 * lag(v, 3) OVER w + 6 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 13 * v + 9 * lead(v, 1) OVER w
 WHEN i = 63 THEN 3 * lag(v, 4) OVER w - 5 * lag(v, 3) OVER w - 3 * lag(v, 2) OVER w + 9 * lag(v, 1) OVER w + 31 * v
 ELSE -3 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 17 * v + 12 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w END) / 35, 6) AS smoothed
FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY i)""",
)
def w11(t):
    return Q.quadratic_smooth(t.epochs(), ["vec_id"], "sample_idx", "value").select("vec_id", "sample_idx", "smoothed")


@query("w13_lost_packets", f"WITH {SERIES}, d AS (SELECT user_id, (((event_id % 256) - lag(event_id % 256) OVER (PARTITION BY user_id ORDER BY i) - 1) % 256 + 256) % 256 AS g FROM u) SELECT user_id, CAST(coalesce(sum(g), 0) AS BIGINT) AS lost FROM d GROUP BY user_id")
def w13(t):
    return Q.lost_packets(t.series().withColumn("package", F.col("event_id") % 256), U, "sample_idx", "package")


@query(
    "w14_flow_state",
    f"WITH {SERIES} SELECT event_id, coalesce(last_value(CASE WHEN value > 150 THEN 'entered' WHEN value < 10 THEN 'exited' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i), 'idle') AS state FROM u",
)
def w14(t):
    return Q.hysteresis(t.series(), U, "sample_idx", F.col("value") > 150, F.col("value") < 10).select("event_id", "state")


def _detail(taps: list[float], key: str, cte: str, src: str, v: str) -> str:
    conv = " + ".join(f"({c!r}) * coalesce(lag({v}, {k}) OVER w, 0)" for k, c in enumerate(taps))
    n = len(taps)
    return f"""{cte}, n AS (SELECT {key}, max(i) + 1 AS n FROM {src} GROUP BY {key}),
z AS (SELECT {key}, i, {v} FROM {src} UNION ALL SELECT {key}, unnest(range(n, n + {n - 1})) AS i, 0.0 FROM n),
d AS (SELECT {key}, i, {conv} AS d FROM z WINDOW w AS (PARTITION BY {key} ORDER BY i)),
dd AS (SELECT {key}, i // 2 AS detail_idx, d FROM d WHERE i % 2 = 1)"""


@query("w15_wavelet_detail", f"WITH {_detail(Q.DB4, 'vec_id', EPOCHS, 'e', 'v')} SELECT vec_id, detail_idx, round(d, 6) AS detail FROM dd")
def w15(t):
    return Q.wavelet_detail(t.epochs(), ["vec_id"], "sample_idx", "value")


@query("w15_haar_detail", f"WITH {_detail(Q.HAAR, 'user_id', SERIES, 'u', 'value')} SELECT user_id, detail_idx, round(d, 6) AS detail FROM dd")
def w15_haar(t):
    return Q.wavelet_detail(t.series(), U, "sample_idx", "value", Q.HAAR)


@query("w21_z_scores", f"WITH {EPOCHS} SELECT vec_id, i AS sample_idx, round((v - avg(v) OVER (PARTITION BY vec_id)) / (stddev_pop(v) OVER (PARTITION BY vec_id) + 1e-12), 6) AS z, round(v - avg(v) OVER (PARTITION BY vec_id), 6) AS centred FROM e")
def w21(t):
    z = Q.remove_mean(Q.z_score(t.epochs(), ["vec_id"], "value"), ["vec_id"], "value", "centred")
    return z.select("vec_id", "sample_idx", "z", "centred")


# -- joins on order --------------------------------------------------------------------------------------------------


@query(
    "j06_as_of_marker",
    "SELECT e.event_id, m.marker_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS marker_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) m ON e.user_id = m.user_id AND e.ts >= m.ts WHERE e.event_type <> 'signup'",
)
def j06(t):
    e = t.table("events").select("user_id", "ts", "event_id", "event_type")
    marks = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("marker_id"))
    return Q.as_of(e.where("event_type <> 'signup'"), marks, U, "ts", ["marker_id"]).select("event_id", "marker_id")


@query(
    "j06_first_window_from",
    f"WITH {SERIES} SELECT user_id, min(CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN i END) AS first_idx FROM u GROUP BY user_id",
)
def j06_step(t):
    return t.series().groupBy("user_id").agg(F.min(F.when(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"), F.col("sample_idx"))).alias("first_idx"))


@query(
    "j08_transform_core",
    f"WITH {EPOCHS} SELECT vec_id, k AS bin, round(sum(v * cos(2 * pi() * i * k / 64)), 6) AS re, round(sum(v * sin(2 * pi() * i * k / 64)), 6) AS im FROM e CROSS JOIN (SELECT unnest(range(1, 32)) AS k) GROUP BY vec_id, k",
)
def j08(t):
    import math

    bins = t.spark.range(SIZE).withColumnRenamed("id", "sample_idx").crossJoin(t.spark.range(1, 32).withColumnRenamed("id", "bin"))
    a = F.lit(2 * math.pi / SIZE) * ((F.col("sample_idx") * F.col("bin")) % SIZE)
    table = bins.select("sample_idx", "bin", F.cos(a).alias("c"), F.sin(a).alias("s"))  # 64 x 31 rows
    j = t.epochs().join(F.broadcast(table), "sample_idx")
    return j.groupBy("vec_id", "bin").agg(F.sum(F.col("value") * F.col("c")).alias("re"), F.sum(F.col("value") * F.col("s")).alias("im"))


@query(
    "j14_interpolated",
    f"""WITH {SERIES}, r AS (SELECT user_id, event_id, i, value, CASE WHEN value <= 100 THEN value END AS g, CASE WHEN value <= 100 THEN i END AS k FROM u),
s AS (SELECT *, last_value(g IGNORE NULLS) OVER a AS v0, last_value(k IGNORE NULLS) OVER a AS i0, first_value(g IGNORE NULLS) OVER b AS v1, first_value(k IGNORE NULLS) OVER b AS i1 FROM r
 WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN g IS NOT NULL THEN g WHEN v0 IS NULL AND v1 IS NULL THEN value WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 6) AS value FROM s""",
)
def j14(t):
    return Q.interpolate(t.series(), U, "sample_idx", "value", F.col("value") > 100).select("event_id", "value")


# -- masks, statistics and quality -----------------------------------------------------------------------------------


@query("p19_threshold_mask", f"WITH {EPOCHS} SELECT label, i AS sample_idx, bool_or(abs(v) > 2.5) AS mask FROM e GROUP BY label, i")
def p19(t):
    return A.threshold_mask(t.channels(), ["label"], 2.5)


_ZMASK = f"""{EPOCHS}, s AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS d FROM e GROUP BY vec_id),
z AS (SELECT label, i AS sample_idx, bool_or(abs((v - m) / (d + 1e-12)) > 2.8) AS mask FROM e JOIN s USING (vec_id) GROUP BY label, i)"""


@query("p20_z_mask", f"WITH {_ZMASK} SELECT * FROM z")
def p20(t):
    return A.z_mask(t.channels(), ["label"], 2.8)


@query("a08_artifact_ratio", f"WITH {EPOCHS}, r AS (SELECT label, vec_id, avg(CASE WHEN abs(v) > 2 THEN 1.0 ELSE 0.0 END) AS r FROM e GROUP BY label, vec_id) SELECT label, round(avg(r), 6) AS artifact_ratio FROM r GROUP BY label")
def a08(t):
    return A.channel_artifact_ratio(t.channels(), ["label"], 2.0)


@query(
    "a09_signal_stats",
    f"""WITH {EPOCHS}, m AS (SELECT *, v - avg(v) OVER (PARTITION BY vec_id) AS c FROM e)
SELECT label, vec_id AS channel_idx, round(max(abs(v)), 6) AS peak, round(sqrt(avg(v * v)), 6) AS rms, round(var_pop(v), 6) AS variance, round(avg(c * c * c * c) / pow(avg(c * c), 2) - 3, 6) AS kurtosis, round(avg(c * c * c) / pow(avg(c * c), 1.5), 6) AS skewness FROM m GROUP BY label, vec_id""",
)
def a09(t):
    return A.signal_stats(t.channels(), ["label"])


@query("a09_snr", f"WITH {DENSITY} SELECT vec_id, round(10 * log10(sum(CASE WHEN f BETWEEN 1 AND 45 THEN power ELSE 0 END) / (sum(CASE WHEN f > 45 THEN power ELSE 0 END) + 1e-12) + 1e-12), 6) AS snr_db FROM p GROUP BY vec_id")
def a09_snr(t):
    return A.snr_db(density(t), ["vec_id"])


_ROBUST = """d0 AS (SELECT *, median(d) OVER (PARTITION BY {k}) AS md FROM dd), d1 AS (SELECT *, median(abs(d - md)) OVER (PARTITION BY {k}) AS mad FROM d0)"""


@query("a10_robust_z", f"WITH {_detail(Q.HAAR, 'user_id', SERIES, 'u', 'value')}, {_ROBUST.format(k='user_id')} SELECT user_id, detail_idx, round(abs(d - md) / (mad * 1.4826 + 1e-12), 6) AS z FROM d1")
def a10(t):
    return Q.robust_z(Q.wavelet_detail(t.series(), U, "sample_idx", "value", Q.HAAR), U, "detail").select("user_id", "detail_idx", "z")




@query(
    "w15_wavelet_mask",
    f"""WITH {_detail(Q.DB4, 'vec_id', EPOCHS, 'e', 'v')}, {_ROBUST.format(k='vec_id')},
h AS (SELECT DISTINCT label, unnest([2 * detail_idx, 2 * detail_idx + 1, 2 * detail_idx + 2]) AS i FROM d1 JOIN (SELECT DISTINCT vec_id, label FROM e) USING (vec_id) WHERE abs(d - md) / (mad * 1.4826 + 1e-12) > 6)
SELECT g.label, g.i AS sample_idx, h.i IS NOT NULL AS mask FROM (SELECT DISTINCT label, i FROM e) g LEFT JOIN h ON g.label = h.label AND g.i = h.i""",
)
def w15_mask(t):
    return A.wavelet_mask(t.channels(), ["label"], 6.0)


@query(
    "a12_agreement",
    f"""WITH {_ZMASK}, t AS (SELECT label, i AS sample_idx, bool_or(abs(v) > 2.5) AS mask FROM e GROUP BY label, i)
SELECT label, round(CASE WHEN count_if(t.mask OR z.mask) = 0 THEN 1 ELSE count_if(t.mask AND z.mask)::DOUBLE / count_if(t.mask OR z.mask) END, 6) AS consistency FROM t JOIN z USING (label, sample_idx) GROUP BY label""",
)
def a12(t):
    return A.agreement([A.threshold_mask(t.channels(), ["label"], 2.5), A.z_mask(t.channels(), ["label"], 2.8)], ["label"])


@query(
    "a11_stability",
    f"WITH {EPOCHS}, r AS (SELECT label, vec_id, i // 16 AS c, sqrt(avg(v * v)) AS r FROM e GROUP BY label, vec_id, i // 16) SELECT label, round(stddev_pop(r) / (avg(r) + 1e-12), 6) AS cv FROM r GROUP BY label",
)
def a11_stability(t):
    return A.stability(t.channels(), ["label"], 16)


@query("a11_quality")
def a11(t):
    return A.quality(t.channels(), ["label"], 16, SIZE).drop("cv")


@query(
    "p17_validation",
    f"""WITH {EPOCHS}, r AS (SELECT label, count(DISTINCT i) AS n_samples, count(DISTINCT vec_id) AS n_channels, max(abs(v)) AS top FROM e GROUP BY label)
SELECT label, true AS valid, '' AS errors, array_to_string(list_filter([CASE WHEN n_channels > 32 THEN 'many channels' END, CASE WHEN n_samples / 128.0 < 10 THEN 'short' END, CASE WHEN top > 1e4 THEN 'large amplitude' END, CASE WHEN top < 1e-3 THEN 'small amplitude' END], lambda x: x IS NOT NULL), ';') AS warnings,
 n_samples, n_channels, round(n_samples / 128.0, 6) AS duration_sec FROM r""",
)
def p17(t):
    v = A.validation(t.channels(), ["label"], RATE)
    return v.withColumn("errors", F.array_join("errors", ";")).withColumn("warnings", F.array_join("warnings", ";"))


@query("a43_channel_preview", "SELECT user_id, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS sd FROM events GROUP BY user_id")
def a43(t):
    return t.table("events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("sd"))


@query(
    "a44_spatial_features",
    """WITH l AS (SELECT label, c % 8 AS ch, avg(abs(x)) AS x FROM (SELECT CAST(label AS BIGINT) AS label, unnest(range(len(embedding))) AS c, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, c % 8)
SELECT label, round(avg(CASE WHEN ch < 4 THEN x END) / (avg(CASE WHEN ch >= 4 THEN x END) + 1e-12), 6) AS front_back_ratio,
 round(abs(avg(CASE WHEN ch % 2 = 0 THEN x END) - avg(CASE WHEN ch % 2 = 1 THEN x END)) / (avg(CASE WHEN ch % 2 = 0 THEN x END) + avg(CASE WHEN ch % 2 = 1 THEN x END) + 1e-12), 6) AS lr_asymmetry,
 arg_max(ch, x) AS max_channel_index, round(max(x) / (avg(x) + 1e-12), 6) AS concentration FROM l GROUP BY label""",
)
def a44(t):
    load = t.epochs().groupBy("label", (F.col("sample_idx") % 8).alias("channel_idx")).agg(F.avg(F.abs("value")).alias("loading"))
    return A.spatial(load, ["label"])


@query(
    "a39_window_labels",
    f"""WITH {DENSITY}, b AS (SELECT vec_id, label, avg(CASE WHEN f >= 13 AND f < 30 THEN power END) / (avg(CASE WHEN f >= 8 AND f < 13 THEN power END) + 1e-8) AS r FROM p GROUP BY vec_id, label)
SELECT vec_id, round(r, 5) AS ratio, CASE WHEN r > median(r) OVER (PARTITION BY label) THEN 1 ELSE 0 END::BIGINT AS target FROM b""",
    digits=5,
)
def a39(t):
    mean = lambda lo, hi: F.avg(F.when((F.col("freq") >= lo) & (F.col("freq") < hi), F.col("power")))
    b = density(t).groupBy("vec_id", "label").agg((mean(13, 30) / (mean(8, 13) + 1e-8)).alias("ratio"))
    med = b.groupBy("label").agg(F.percentile("ratio", F.lit(0.5)).alias("med"))
    return b.join(med, "label").select("vec_id", "ratio", (F.col("ratio") > F.col("med")).cast("long").alias("target"))


_MEANS = ", ".join(f"avg(CASE WHEN f >= {lo} AND f < {hi} THEN power END) AS {b}" for b, (lo, hi) in S.BANDS.items())
_TOTAL = " + ".join(S.BANDS)


@query(
    "a40_learning_features",
    f"WITH {DENSITY}, b AS (SELECT vec_id, {_MEANS} FROM p GROUP BY vec_id), v AS (SELECT vec_id, var_pop(v) AS variance FROM e GROUP BY vec_id) SELECT vec_id, {', '.join(f'round({b} / ({_TOTAL} + 1e-8), 6) AS {b}' for b in S.BANDS)}, round(variance, 6) AS variance FROM b JOIN v USING (vec_id)",
)
def a40(t):
    from ..functions import learning

    return learning.features(density(t), t.epochs(), ["vec_id"])


# -- epochs ----------------------------------------------------------------------------------------------------------

_ANCHORS = f"""{SERIES}, m AS (SELECT user_id, event_type, i / 4.0 AS t_sec FROM u WHERE event_type = 'signup'),
l AS (SELECT user_id, max(i) + 1 AS n FROM u GROUP BY user_id), q AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM m),
a AS (SELECT user_id, CAST(round_even(unnest(CASE WHEN k = 1 THEN list_transform(range(-3, 4), lambda z: t_sec + z * 10.0) ELSE [t_sec] END) * 4, 0) AS BIGINT) AS anchor, k = 1 AS is_pseudo FROM q)"""
_CUT = f"""{_ANCHORS}, b AS (SELECT user_id, anchor, row_number() OVER (PARTITION BY user_id ORDER BY anchor) - 1 AS epoch_idx FROM a JOIN l USING (user_id) WHERE anchor >= 4 AND anchor + 8 <= n),
ep AS (SELECT b.user_id, epoch_idx, u.i - anchor + 4 AS rel_idx, value FROM b JOIN u ON b.user_id = u.user_id AND u.i >= anchor - 4 AND u.i < anchor + 8)"""


def _marks(t):
    return t.series().where("event_type = 'signup'").select("user_id", F.col("event_type").alias("event_id"), (F.col("sample_idx") / 4.0).alias("t_sec"))


def _epochs(t):
    return P.cut(t.one_channel(), P.average_anchors(_marks(t), U, "signup", 4.0), U, 4, 8)


@query("j05_anchors", f"WITH {_ANCHORS} SELECT user_id, anchor, is_pseudo FROM a")
def j05(t):
    return P.average_anchors(_marks(t), U, "signup", 4.0)


@query(
    "j05_spectral_anchors",
    f"""WITH {SERIES}, l AS (SELECT user_id, max(i) + 1 AS n FROM u GROUP BY user_id),
h AS (SELECT u.user_id, list_sort(list(i)) AS s FROM u JOIN l USING (user_id) WHERE event_type = 'error' AND i >= 20 AND i + 40 <= n GROUP BY u.user_id),
j AS (SELECT user_id, n, coalesce(len(s), 0) AS k, s, CASE WHEN s IS NULL THEN n // 2 ELSE s[1] END AS mid FROM l LEFT JOIN h USING (user_id))
SELECT user_id, unnest(CASE WHEN k >= 2 THEN s ELSE list_transform(list_filter(range(-8, 9, 15), lambda o: mid + o - 20 >= 0 AND mid + o + 40 <= n), lambda o: mid + o) END) AS anchor, k < 2 AS is_pseudo FROM j""",
)
def j05_spectral(t):
    ev = t.series().where("event_type = 'error'").select("user_id", F.col("event_type").alias("event_id"), (F.col("sample_idx") / 4.0).alias("t_sec"))
    n = t.series().groupBy("user_id").agg((F.max("sample_idx") + 1).alias("n"))
    return P.spectral_anchors(ev, n, U, "error", 4.0, 20, 40)


@query("j04_epochs", f"WITH {_CUT} SELECT user_id, epoch_idx, rel_idx, 0 AS channel_idx, value FROM ep")
def j04(t):
    return _epochs(t)


@query("a13_average", f"WITH {_CUT} SELECT user_id, rel_idx, 0 AS channel_idx, round(avg(value), 6) AS value, count(*) AS n_averaged FROM ep GROUP BY user_id, rel_idx")
def a13(t):
    return P.average(_epochs(t), U)


@query(
    "a14_baseline",
    f"WITH {EPOCHS} SELECT label, vec_id AS epoch_idx, i AS rel_idx, round(v - avg(CASE WHEN i < 16 THEN v END) OVER (PARTITION BY vec_id), 6) AS value FROM e",
)
def a14(t):
    e = t.epochs().select("label", F.col("vec_id").alias("epoch_idx"), F.col("sample_idx").alias("rel_idx"), F.lit(0).alias("channel_idx"), "value")
    return P.correct(e, ["label"], 0, 16).drop("channel_idx")


def _label_epochs(t):
    return t.epochs().select("label", F.col("vec_id").alias("epoch_idx"), F.col("sample_idx").alias("rel_idx"), F.lit(0).alias("channel_idx"), "value")


@query(
    "a15_peak_to_peak_rmse",
    f"""WITH {EPOCHS}, a AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i), p AS (SELECT label, max(m) - min(m) AS peak_to_peak FROM a GROUP BY label)
SELECT label, round(any_value(peak_to_peak), 6) AS peak_to_peak, round(sqrt(avg((v - m) * (v - m))), 6) AS rmse FROM e JOIN a USING (label, i) JOIN p USING (label) GROUP BY label""",
)
def a15(t):
    e = _label_epochs(t)
    return P.peak_to_peak(P.average(e, ["label"]), ["label"]).drop("channel_idx").join(P.residual(e, ["label"]), "label")


_PAIR = f"{EPOCHS}, c AS (SELECT label, vec_id % 3 AS ch, i, avg(v) AS v FROM e GROUP BY label, vec_id % 3, i)"


def _channel_waves(t):
    return t.epochs().groupBy("label", (F.col("vec_id") % 3).cast("int").alias("channel_idx"), F.col("sample_idx").alias("rel_idx")).agg(F.avg("value").alias("value"))


@query(
    "a16_lateralisation",
    f"WITH {_PAIR} SELECT x.label, round(avg(abs(x.v - y.v)) / (avg(abs(x.v)) + avg(abs(y.v)) + 1e-12), 6) AS lateralization_index FROM c x JOIN c y ON x.label = y.label AND x.i = y.i AND x.ch = 0 AND y.ch = 1 GROUP BY x.label",
)
def a16(t):
    return P.lateralisation(_channel_waves(t), ["label"])


@query("j09_channel_pairs", f"WITH {_PAIR} SELECT x.label, x.i AS rel_idx, x.ch AS channel_a, y.ch AS channel_b, round(x.v - y.v, 6) AS diff FROM c x JOIN c y ON x.label = y.label AND x.i = y.i AND x.ch < y.ch")
def j09(t):
    return P.channel_pairs(_channel_waves(t), ["label"])


@query(
    "j11_adjacent_difference_waves",
    f"WITH {EPOCHS}, a AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i), n AS (SELECT label, lead(label) OVER (ORDER BY label) AS nxt FROM (SELECT DISTINCT label FROM a)) SELECT x.label AS label_a, y.label AS label_b, x.i AS rel_idx, round(x.m - y.m, 6) AS diff FROM n JOIN a x ON x.label = n.label JOIN a y ON y.label = n.nxt AND y.i = x.i",
)
def j11(t):
    wave = P.average(_label_epochs(t), ["label"])
    nxt = wave.select("label").distinct().select(F.col("label"), F.lead("label").over(W.orderBy("label")).alias("label_b"))  # one row for each condition
    a = wave.join(nxt, "label").where("label_b IS NOT NULL").select(F.col("label").alias("label_a"), "label_b", "rel_idx", "channel_idx", "value")
    b = wave.select(F.col("label").alias("label_b"), "rel_idx", "channel_idx", "value")
    b = b.join(nxt.where("label_b IS NOT NULL").select(F.col("label").alias("label_a"), "label_b"), "label_b")
    return P.difference_wave(a, b, ["label_a", "label_b"]).drop("channel_idx")


@query(
    "w12_components",
    f"""WITH {EPOCHS}, a AS (SELECT label, i, avg(v) AS v FROM e GROUP BY label, i),
k AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {round(lo * 100)}, {round(hi * 100)}, {1.0 if p == 'positive' else -1.0})" for n, (lo, hi, p) in S.COMPONENTS.items())}) t(component, i0, i1, s)),
g AS (SELECT label, component, s, i, v, i - i0 AS j, i1 - i0 AS n FROM a JOIN k ON i >= i0 AND i < least(i1, 64)), g2 AS (SELECT *, count(*) OVER (PARTITION BY label, component) AS c FROM g),
f AS (SELECT *, (CASE WHEN c < 5 THEN 35 * v
 WHEN j = 0 THEN 31 * v + 9 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w - 5 * lead(v, 3) OVER w + 3 * lead(v, 4) OVER w
 WHEN j = 1 THEN 9 * lag(v, 1) OVER w + 13 * v + 12 * lead(v, 1) OVER w + 6 * lead(v, 2) OVER w - 5 * lead(v, 3) OVER w
 WHEN j = c - 2 THEN -5 * lag(v, 3) OVER w + 6 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 13 * v + 9 * lead(v, 1) OVER w
 WHEN j = c - 1 THEN 3 * lag(v, 4) OVER w - 5 * lag(v, 3) OVER w - 3 * lag(v, 2) OVER w + 9 * lag(v, 1) OVER w + 31 * v
 ELSE -3 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 17 * v + 12 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w END) / 35 AS y FROM g2 WINDOW w AS (PARTITION BY label, component ORDER BY i)),
r AS (SELECT *, s * y > s * lag(y) OVER w AND s * y > s * lead(y) OVER w AS l FROM f WINDOW w AS (PARTITION BY label, component ORDER BY i)),
q AS (SELECT *, row_number() OVER (PARTITION BY label, component ORDER BY coalesce(l, false) DESC, s * y DESC, i) AS nth, avg(y) OVER (PARTITION BY label, component) AS m, stddev_pop(y) OVER (PARTITION BY label, component) AS d FROM r)
SELECT label, component, round(y, 6) AS amplitude, round(i / 100.0, 6) AS latency_sec, round((y - m) / (d + 1e-12), 5) AS significance FROM q WHERE nth = 1""",
)
def w12(t):
    got = P.components(P.average(_label_epochs(t), ["label"]), ["label"], 100.0, 0)
    return got.withColumn("significance", F.round("significance", 5))


# -- flow metrics ----------------------------------------------------------------------------------------------------

_PHASES = f"""{SERIES}, ph AS (SELECT user_id,
 coalesce(arg_max(i / 1.0, i) FILTER (WHERE event_type = 'signup'), 300.0) AS f1, arg_max(i / 1.0, i) FILTER (WHERE event_type = 'purchase') AS f2, arg_max(i / 1.0, i) FILTER (WHERE event_type = 'error') AS x0,
 arg_max(i / 1.0, i) FILTER (WHERE event_type = 'missing') AS x1, arg_max(i / 1.0, i) FILTER (WHERE event_type = 'click') AS r0 FROM u GROUP BY user_id)"""
_NAMES = {"signup": "F1", "purchase": "F2", "error": "X0", "missing": "X1", "click": "R0"}


@query("p07_phases", f"WITH {_PHASES} SELECT user_id, f1 AS steady_start, coalesce(f2, x0, 540.0) AS steady_end, coalesce(x0, 540.0) AS switch_start, coalesce(x1, r0, 660.0) AS switch_end, coalesce(r0, 660.0) AS recovery_start FROM ph")
def p07(t):
    m = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    ev = t.series().select("user_id", m[F.col("event_type")].alias("event_id"), F.col("sample_idx").cast("double").alias("t_sec"), "sample_idx")
    return R.intervals(ev, U, "sample_idx")


_FEATS = f"""{SERIES}, f AS (SELECT user_id, i, i * 1.0 AS t_sec, value AS theta_alpha_ratio, value * value AS gamma_rel FROM u),
l AS (UNPIVOT f ON theta_alpha_ratio, gamma_rel INTO NAME indicator VALUE x),
b AS (SELECT user_id, indicator, coalesce(avg(CASE WHEN t_sec BETWEEN 5 AND 19 THEN x END), 0) AS base FROM l GROUP BY user_id, indicator)"""


def _flow(t):
    f = t.series().select("user_id", F.col("sample_idx").alias("window_idx"), F.col("sample_idx").cast("double").alias("t_sec"), F.col("value").alias("theta_alpha_ratio"), (F.col("value") * F.col("value")).alias("gamma_rel"))
    long = f.unpivot(["user_id", "window_idx", "t_sec"], ["theta_alpha_ratio", "gamma_rel"], "indicator", "x")
    phases = t.table("events").select("user_id").distinct().select("user_id", *[F.lit(float(v)).alias(n) for n, v in zip(R.PHASES, (5, 19, 20, 30, 30), strict=True)])
    return long, phases, R.baseline(long, phases, U)


@query("a21_baseline", f"WITH {_FEATS} SELECT user_id, indicator, round(base, 6) AS base FROM b")
def a21(t):
    return _flow(t)[2]


@query(
    "a22_attenuation",
    f"""WITH {_FEATS}, x AS (SELECT user_id, indicator, min(x) AS lo, max(x) AS hi FROM l WHERE t_sec BETWEEN 20 AND 30 GROUP BY user_id, indicator)
SELECT user_id, indicator, round(coalesce(CASE WHEN indicator = 'theta_alpha_ratio' THEN (base - lo) / (base + 1e-12) * 100 ELSE least((hi - base) / (base + 1e-12) * 100, 300) END, 0), 6) AS attenuation FROM b LEFT JOIN x USING (user_id, indicator)""",
)
def a22(t):
    long, phases, base = _flow(t)
    return R.attenuation(long, phases, base, U)


_RECOVERY = f"""{_FEATS}, r AS (SELECT l.user_id, indicator, row_number() OVER (PARTITION BY l.user_id, indicator ORDER BY i) - 1 AS pos, x BETWEEN base * 0.1 AND base * 1.9 AS g FROM l JOIN b USING (user_id, indicator) WHERE t_sec >= 30),
w AS (SELECT *, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, indicator ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS h FROM r),
rec AS (SELECT b.user_id, b.indicator, min(CASE WHEN h = 4 THEN pos END) + 4.0 AS recovery_sec FROM b LEFT JOIN w ON b.user_id = w.user_id AND b.indicator = w.indicator GROUP BY b.user_id, b.indicator)"""


@query("w04_recovery_time", f"WITH {_RECOVERY} SELECT * FROM rec")
def w04_recovery(t):
    long, phases, base = _flow(t)
    return R.recovery(long, phases, base, U, tolerance=0.9, hold_sec=4.0)


@query("a23_overall_recovery", f"WITH {_RECOVERY} SELECT user_id, max(recovery_sec) AS recovery_time, count(*) FILTER (WHERE recovery_sec IS NULL) AS n_unrecovered FROM rec GROUP BY user_id")
def a23(t):
    long, phases, base = _flow(t)
    return R.overall(R.recovery(long, phases, base, U, tolerance=0.9, hold_sec=4.0), U)


@query("p09_normalised", f"WITH {_FEATS} SELECT user_id, indicator, i AS window_idx, t_sec, round(CASE WHEN base > 0 THEN x / base ELSE x END, 5) AS x FROM l JOIN b USING (user_id, indicator)", digits=5)
def p09(t):
    long, _, base = _flow(t)
    return R.normalised(long, base, U)


@query(
    "p08_indicators",
    f"WITH {DENSITY}, r AS (SELECT vec_id, {_rel().replace('round(', '(').replace(', 6)', ')')} FROM p GROUP BY vec_id) SELECT vec_id, round(theta / (alpha + 1e-12), 6) AS theta_alpha_ratio, round((theta + beta) / (alpha + 1e-12), 6) AS cog_load FROM r",
)
def p08(t):
    r = X.relative_powers(density(t), ["vec_id"])
    a = F.col("alpha") + S.TINY
    return r.select("vec_id", (F.col("theta") / a).alias("theta_alpha_ratio"), ((F.col("theta") + F.col("beta")) / a).alias("cog_load"))


@query(
    "flow_features",
    f"""WITH {DENSITY}, {BANDS_SQL}, t AS (SELECT label, sum(power) AS total FROM m GROUP BY label)
SELECT label, band, round(sum(power) / (any_value(total) + 1e-12), 6) AS share FROM m JOIN bands ON f >= lo AND f < hi JOIN t USING (label) GROUP BY label, band""",
)
def flow_features(t):
    m = label_density(t)
    total = m.groupBy("label").agg(F.sum("power").alias("total"))
    return X.in_bands(m).join(total, "label").groupBy("label", "band").agg((F.sum("power") / (F.first("total") + S.TINY)).alias("share"))
