"""Queries over groups, catalogs, rules, events, files and streams."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import rules as L
from ..operators import series as Q
from ..operators import statistics as X
from ..sources import readers, writers
from ..streaming import live
from .base import EPOCHS, SERIES, Tables, query

U = ["user_id"]

# -- statistics ------------------------------------------------------------------------------------------------------

_A = "SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings"


def _pairs(t):
    e = t.table("embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return X.pair_up(e.withColumn("value", F.col("x")), e.withColumn("value", F.col("y")), ["label"], "vec_id")


@query("j10_paired_by_position", f"SELECT label, pos, round(a, 6) AS a, round(b, 6) AS b FROM ({_A})")
def j10(t):
    return _pairs(t)


@query(
    "a26_paired_t",
    f"""WITH p AS ({_A}) SELECT label, count(*) AS n, round(avg(a - b), 6) AS mean_diff, round(stddev_samp(a - b), 6) AS std_diff, round(avg(a - b) / stddev_samp(a - b) * sqrt(count(*)), 6) AS t_stat, count(*) - 1 AS df, round(avg(a - b) / stddev_samp(a - b), 6) AS d FROM p GROUP BY label""",
)
def a26(t):
    return X.paired_t(_pairs(t), ["label"])


@query("a26_paired_t_p")
def a26_p(t):
    return X.with_p(X.paired_t(_pairs(t), ["label"]))


@query(
    "a27_signed_rank",
    f"""WITH p AS ({_A}), d AS (SELECT label, round(a - b, 1) AS d FROM p), nz AS (SELECT label, d, count(*) OVER (PARTITION BY label, abs(d)) AS t, rank() OVER (PARTITION BY label ORDER BY abs(d)) AS r FROM d WHERE d <> 0),
z AS (SELECT label, bool_or(d = 0) AS zeros FROM d GROUP BY label)
SELECT label, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r + (t - 1) / 2 ELSE 0 END), sum(CASE WHEN d < 0 THEN r + (t - 1) / 2 ELSE 0 END)) AS w, CAST(sum(t * t - 1) AS DOUBLE) AS ties, any_value(zeros) AS zeros FROM nz JOIN z USING (label) GROUP BY label""",
)
def a27(t):
    p = _pairs(t).select("label", "pos", F.round(F.col("a") - F.col("b"), 1).alias("a"), F.lit(0.0).alias("b"))
    return X.signed_rank(p, ["label"])


@query("a29_pearson", f"WITH p AS ({_A}) SELECT label, count(*) AS n, round(corr(a, b), 6) AS r, round(corr(a, b) * sqrt((count(*) - 2) / (1 - corr(a, b) * corr(a, b))), 6) AS t_stat FROM p GROUP BY label")
def a29(t):
    return X.pearson(_pairs(t), ["label"])


@query(
    "a25_pooled_effect",
    """WITH g AS (SELECT l_linestatus AS status, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'R') AS n_b, avg(l_quantity) FILTER (WHERE l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') AS mb,
 coalesce(var_samp(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS va, coalesce(var_samp(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS vb FROM lineitem GROUP BY l_linestatus),
s AS (SELECT *, sqrt((greatest(n_a - 1, 0) * va + greatest(n_b - 1, 0) * vb) / greatest(n_a + n_b - 2, 1)) AS pooled_std, coalesce(ma - mb, 0) AS mean_diff FROM g),
d AS (SELECT *, CASE WHEN pooled_std > 1e-12 THEN mean_diff / pooled_std ELSE 0 END AS d FROM s)
SELECT status, n_a, n_b, round(mean_diff, 6) AS mean_diff, round(pooled_std, 6) AS pooled_std, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM d""",
)
def a25(t):
    v = t.table("lineitem").select(F.col("l_linestatus").alias("status"), "l_returnflag", F.col("l_quantity").alias("value"))
    return X.pooled_d(v, ["status"], "l_returnflag", "A", "R")


@query(
    "a28_repeated_anova",
    """WITH c AS (SELECT l_returnflag AS flag, l_suppkey AS s, l_linestatus AS k, avg(l_quantity) AS x FROM lineitem GROUP BY ALL),
m AS (SELECT *, avg(x) OVER (PARTITION BY flag) AS g, avg(x) OVER (PARTITION BY flag, k) AS ck, avg(x) OVER (PARTITION BY flag, s) AS cs FROM c),
t AS (SELECT flag, count(DISTINCT s) AS n, count(DISTINCT k) AS k, sum((ck - g) * (ck - g)) AS ss_between, sum((x - ck) * (x - ck)) AS ss_within, sum((cs - g) * (cs - g)) AS ss_subject FROM m GROUP BY flag),
e AS (SELECT *, ss_within - ss_subject AS ss_error FROM t)
SELECT flag, n, k, round(ss_between, 4) AS ss_between, round(ss_within, 4) AS ss_within, round(ss_subject, 4) AS ss_subject, round(ss_error, 4) AS ss_error,
 round(CASE WHEN n >= 2 AND k >= 2 THEN ss_between / (k - 1) / (ss_error / ((n - 1) * (k - 1) + 1e-12) + 1e-12) ELSE 0 END, 4) AS f_stat,
 round(CASE WHEN n >= 2 AND k >= 2 THEN ss_between / (ss_between + ss_within + 1e-12) ELSE 0 END, 4) AS eta2, round(CASE WHEN n >= 2 AND k >= 2 THEN ss_between / greatest(ss_between + ss_error, 1e-12) ELSE 0 END, 4) AS partial_eta2 FROM e""",
    digits=4,
)
def a28(t):
    v = t.table("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("subject"), F.col("l_linestatus").alias("condition"), F.col("l_quantity").alias("value"))
    return X.repeated_anova(v, ["flag"], "subject", "condition")


@query("a28_repeated_anova_p")
def a28_p(t):
    return X.anova_p(a28(t))


_TESTS = "t AS (SELECT o_custkey AS test_id, least(min(o_totalprice) / 490001.7, 1.0) AS p_value FROM orders GROUP BY o_custkey)"


def _tests(t):
    return t.table("orders").groupBy(F.col("o_custkey").alias("test_id")).agg(F.least(F.min("o_totalprice") / 490001.7, F.lit(1.0)).alias("p_value"))


@query(
    "w09_false_discovery",
    f"""WITH {_TESTS}, r AS (SELECT *, test_id % 50 AS family FROM t), k AS (SELECT *, p_value * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p_value, test_id) AS q FROM r),
a AS (SELECT *, least(min(q) OVER (PARTITION BY family ORDER BY p_value, test_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS adj FROM k)
SELECT family, test_id, round(p_value, 6) AS p_value, round(adj, 6) AS adjusted_p, adj < 0.05 AS significant FROM a""",
)
def w09(t):
    return X.benjamini_hochberg(_tests(t).withColumn("family", F.col("test_id") % 50), ["family"]).select("family", "test_id", "p_value", "adjusted_p", "significant")


@query("w09_bonferroni", f"WITH {_TESTS}, n AS (SELECT *, test_id % 50 AS family, count(*) OVER (PARTITION BY test_id % 50) AS n FROM t) SELECT family, test_id, round(p_value, 6) AS p_value, round(least(p_value * n, 1.0), 6) AS adjusted_p, round(0.05 / n, 6) AS threshold, p_value < 0.05 / n AS significant FROM n")
def w09_b(t):
    return X.bonferroni(_tests(t).withColumn("family", F.col("test_id") % 50), ["family"]).select("family", "test_id", "p_value", "adjusted_p", "threshold", "significant")


@query(
    "a24_cross_subject",
    "SELECT o_orderpriority AS metric, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS sem, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY o_orderpriority",
    digits=4,
)
def a24(t):
    return X.summary(t.table("orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value")), ["metric"])


@query("a30_interval")
def a30(t):
    return X.with_interval(a24(t))


@query(
    "a34_profile",
    """WITH g AS (SELECT o_orderpriority AS condition, avg(o_totalprice) AS recovery, count(*) * 1.0 AS loss, 1.0 AS flat FROM orders GROUP BY 1)
SELECT condition, round(1 - (recovery - min(recovery) OVER ()) / (max(recovery) OVER () - min(recovery) OVER ()), 6) AS recovery, round((loss - min(loss) OVER ()) / (max(loss) OVER () - min(loss) OVER ()), 6) AS loss, 1.0 AS flat FROM g""",
)
def a34(t):
    g = t.table("orders").groupBy(F.col("o_orderpriority").alias("condition")).agg(F.avg("o_totalprice").alias("recovery"), F.count(F.lit(1)).cast("double").alias("loss"), F.lit(1.0).alias("flat"))
    return X.profile(g, "condition", {"recovery": True, "loss": False, "flat": True})


@query(
    "a37_condition_pairs",
    """WITH v AS (SELECT o_orderpriority AS c, o_custkey AS s, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2), p AS (SELECT a.c AS condition_a, b.c AS condition_b, a.x - b.x AS d FROM v a JOIN v b ON a.s = b.s AND a.c < b.c)
SELECT condition_a, condition_b, count(*) AS n, round(avg(d), 4) AS mean_diff, round(coalesce(stddev_samp(d), 0), 4) AS std_diff, round(CASE WHEN count(*) > 1 THEN avg(d) / stddev_samp(d) * sqrt(count(*)) ELSE 0 END, 4) AS t_stat, count(*) - 1 AS df, round(CASE WHEN count(*) > 1 THEN avg(d) / stddev_samp(d) ELSE 0 END, 4) AS d FROM p GROUP BY 1, 2""",
    digits=4,
)
def a37(t):
    v = t.table("orders").groupBy(F.col("o_orderpriority").alias("c"), F.col("o_custkey").alias("s")).agg(F.avg("o_totalprice").alias("value"))
    return X.paired_t(X.pairs_of(v, "c", "s"), ["condition_a", "condition_b"])


def _vector_mean():
    return F.expr("aggregate(embedding, 0D, (a, x) -> a + x) / size(embedding)")


@query("a31_permutation")
def a31(t):
    v = t.table("embeddings").select((F.col("label") % 2).alias("g"), F.lit("all").alias("metric"), _vector_mean().alias("value"))
    return X.permutation_test(v, ["metric"], "g", 0, 1)


@query("a33_bootstrap")
def a33(t):
    v = t.table("embeddings").select(F.col("label").cast("long").alias("label"), _vector_mean().alias("value"))
    return X.bootstrap(v, ["label"])


@query(
    "a38_confusion",
    """WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn FROM labels),
m AS (SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / (tp + fp) AS prec, tp / (tp + fn) AS rec FROM c)
SELECT 'all' AS split, tp, fp, tn, fn, round(accuracy, 6) AS accuracy, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(2 * prec * rec / (prec + rec), 6) AS f1 FROM m""",
)
def a38(t):
    return X.confusion(t.table("labels").select(F.lit("all").alias("split"), "quality", (1 - F.col("toxic")).alias("guess")), ["split"], "quality", "guess")


@query("u01_pooled", "SELECT g, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT 'pooled' AS g, l_quantity AS x FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'pooled', l_quantity FROM lineitem WHERE l_returnflag = 'R') GROUP BY g")
def u01(t):
    one = lambda f: t.table("lineitem").where(F.col("l_returnflag") == f).select(F.lit("pooled").alias("g"), F.col("l_quantity").alias("x"))
    return one("A").unionByName(one("R")).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


@query("u02_mask_overlap", f"WITH {SERIES} SELECT user_id, count(*) FILTER (WHERE value > 50 AND event_type = 'click') AS both, count(*) FILTER (WHERE value > 50 OR event_type = 'click') AS either FROM u GROUP BY user_id")
def u02(t):
    a, b = F.col("value") > 50, F.col("event_type") == "click"
    return t.table("events").groupBy("user_id").agg(F.count_if(a & b).alias("both"), F.count_if(a | b).alias("either"))


# -- catalog ---------------------------------------------------------------------------------------------------------


def _catalog(t):
    return t.table("customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_name").alias("code"), F.col("c_mktsegment").alias("segment")), t.table("orders").select(
        F.col("o_orderkey").alias("experiment_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("condition"), F.col("o_orderdate").alias("created_at")
    )


@query("j01_experiments_of_subjects", "SELECT o_orderkey AS experiment_id, c_custkey AS subject_id, c_name AS code, o_orderpriority AS condition, o_orderdate AS created_at FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def j01(t):
    s, e = _catalog(t)
    return e.join(s.where("segment = 'BUILDING'").drop("segment"), "subject_id").select("experiment_id", "subject_id", "code", "condition", "created_at")


@query("j02_orphans_after_delete", "SELECT o_orderkey AS experiment_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j02(t):
    s, e = _catalog(t)
    return e.join(s.where("segment = 'BUILDING'"), "subject_id", "left_anti").select("experiment_id")


@query("j15_subjects_with_experiments", "SELECT c_custkey AS subject_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j15(t):
    s, e = _catalog(t)
    return s.join(e, "subject_id", "left_semi").select("subject_id")


@query("j03_lookup_with_default", "SELECT c_custkey AS subject_id, coalesce(count(o_orderkey), 0) AS experiments, coalesce(max(o_totalprice), 0) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j03(t):
    g = t.table("orders").groupBy(F.col("o_custkey").alias("subject_id")).agg(F.count(F.lit(1)).alias("experiments"), F.max("o_totalprice").alias("most"))
    return _catalog(t)[0].select("subject_id").join(g, "subject_id", "left").select("subject_id", F.coalesce("experiments", F.lit(0)).alias("experiments"), F.coalesce("most", F.lit(0.0)).alias("most"))


@query("t01_latest_experiments", "SELECT subject_id, experiment_id, nth FROM (SELECT o_custkey AS subject_id, o_orderkey AS experiment_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) WHERE nth <= 3")
def t01(t):
    w = W.partitionBy("subject_id").orderBy(F.desc("created_at"), F.desc("experiment_id"))
    return _catalog(t)[1].withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("subject_id", "experiment_id", "nth")


@query("s21_migrated_catalog", "SELECT o_orderkey AS id, NULL::VARCHAR AS eeg_path, 'upload' AS source, 'pending' AS analysis_status FROM orders")
def s21(t):
    return writers.migrated(_catalog(t)[1].select(F.col("experiment_id").alias("id"))).select("id", "eeg_path", "source", "analysis_status")


@query(
    "a42_batch_rollup",
    """SELECT o_custkey AS subject, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN 'ok' END), 'missing') AS flow, coalesce(max(CASE WHEN o_orderstatus = 'O' THEN 'ok' END), 'missing') AS spectrum, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN 'ok' END), 'missing') AS artifact FROM orders GROUP BY o_custkey""",
)
def a42(t):
    m = F.create_map(*[F.lit(x) for x in ("F", "flow", "O", "spectrum", "P", "artifact")])
    o = t.table("orders").select(F.col("o_custkey").alias("subject"), m[F.col("o_orderstatus")].alias("module"), F.lit("ok").alias("status"))
    return o.groupBy("subject").pivot("module", ["flow", "spectrum", "artifact"]).agg(F.first("status")).na.fill("missing")


@query("x05_stamped_names", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y%m%d_%H%M%S') || '_rec_' || event_type || '.csv' AS name FROM events")
def x05(t):
    from ..sources import writers

    e = t.table("events")
    return e.select("event_id", writers.stamp(F.col("ts")).alias("stamp"), writers.stamped_name(F.concat(F.lit("in/rec "), "event_type", F.lit(".csv")), F.col("ts")).alias("name"))


@query("u03_missing_columns", "SELECT p_partkey, array_to_string(list_sort(list_filter([0, 1, 2, 3, 4], lambda x: x NOT IN (p_size % 5, p_size % 3))), ',') AS missing FROM part")
def u03(t):
    """Of five wanted columns those that a part's table lacks."""
    have = F.array(F.col("p_size") % 5, F.col("p_size") % 3)
    missing = F.array_sort(F.array_except(F.array(*[F.lit(i) for i in range(5)]), have.cast("array<int>")))
    return t.table("part").select("p_partkey", F.array_join(missing.cast("array<string>"), ",").alias("missing"))


@query("u04_needed_columns", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat([0, p_size % 5], [p_size % 7, 3]))), ',') AS needed FROM part")
def u04(t):
    need = F.array_sort(F.array_union(F.array(F.lit(0), F.col("p_size") % 5), F.array(F.col("p_size") % 7, F.lit(3))))
    return t.table("part").select("p_partkey", F.array_join(need.cast("array<string>"), ",").alias("needed"))


# -- scalar rules ----------------------------------------------------------------------------------------------------


@query(
    "p11_interpretation",
    """WITH r AS (SELECT event_id, value AS rt, value / 5 - 20 AS att FROM events) SELECT event_id,
 CASE WHEN rt IS NULL THEN 'not recovered' WHEN rt < 60 THEN 'quick' WHEN rt < 180 THEN 'moderate' WHEN rt < 360 THEN 'slow' ELSE 'very slow' END AS recovery,
 (CASE WHEN att >= 0 THEN 'drop' ELSE 'shift' END) || ' ' || (CASE WHEN abs(att) > 40 THEN 'marked' WHEN abs(att) > 20 THEN 'moderate' ELSE 'slight' END) AS attenuation FROM r""",
)
def p11(t):
    e = t.table("events").select("event_id", F.col("value").alias("rt"), (F.col("value") / 5 - 20).alias("att"))
    return e.select("event_id", L.recovery_class(F.col("rt")).alias("recovery"), L.attenuation_class(F.col("att")).alias("attenuation"))


@query(
    "p12_conclusions",
    """WITH r AS (SELECT event_id, value AS rt, [value / 10, -value / 20] AS flow, [value / 12] AS loss, value - 100 AS diff FROM events)
SELECT event_id, CASE WHEN diff > 60 THEN 'longer' WHEN diff > 0 THEN 'slightly longer' ELSE 'no longer' END AS against_control,
 coalesce(nullif(array_to_string(list_filter([CASE WHEN rt > 180 THEN 'buffer' END, CASE WHEN abs(flow[1]) > 40 OR abs(flow[2]) > 40 THEN 'fewer switches' END, CASE WHEN abs(loss[1]) > 40 THEN 'rest' END], lambda x: x IS NOT NULL), ','), ''), 'keep pace') AS suggestions FROM r""",
)
def p12(t):
    v = F.col("value")
    return t.table("events").select("event_id", L.against_control(v - 100).alias("against_control"), F.array_join(L.suggestions(v, F.array(v / 10, -v / 20), F.array(v / 12)), ",").alias("suggestions"))


@query(
    "p13_labels",
    """SELECT p_partkey, CASE WHEN p_size / 50.0 < 0.2 THEN 'negligible' WHEN p_size / 50.0 < 0.5 THEN 'small' WHEN p_size / 50.0 < 0.8 THEN 'medium' ELSE 'large' END AS effect,
 CASE WHEN p_size / 250.0 < 0.01 THEN 'negligible' WHEN p_size / 250.0 < 0.06 THEN 'small' WHEN p_size / 250.0 < 0.14 THEN 'medium' ELSE 'large' END AS eta,
 CASE WHEN p_size * 2 >= 85 THEN 'A' WHEN p_size * 2 >= 70 THEN 'B' WHEN p_size * 2 >= 50 THEN 'C' ELSE 'D' END AS grade,
 CASE WHEN p_size / 50.0 < 0.3 THEN 'low' WHEN p_size / 50.0 < 0.7 THEN 'medium' ELSE 'high' END AS focus, CASE WHEN p_size / 50.0 >= 0.7 THEN 'good' WHEN p_size / 50.0 >= 0.55 THEN 'fair' ELSE 'poor' END AS training FROM part""",
)
def p13(t):
    from ..operators.artifacts import grade

    s = F.col("p_size")
    return t.table("part").select("p_partkey", X.effect_label(s / 50).alias("effect"), X.eta_label(s / 250).alias("eta"), grade(s * 2).alias("grade"), L.focus_hint(s / 50).alias("focus"), L.training_status(s / 50).alias("training"))


@query(
    "p05_filter_presets",
    """WITH p AS (SELECT * FROM (VALUES ('eeg', 1.0, 45.0, 50.0), ('emg', 20.0, 250.0, 50.0), ('ecg', 0.5, 40.0, 50.0)) t(preset, hp, lp, notch)), c AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'eeg' WHEN 1 THEN 'emg' WHEN 2 THEN 'ecg' ELSE 'other' END AS preset, CASE WHEN c_custkey % 3 = 0 THEN 30.0 END AS lp FROM customer)
SELECT c_custkey, CAST(coalesce(p.hp, 1.0) AS DOUBLE) AS hp, CAST(coalesce(c.lp, p.lp, 45.0) AS DOUBLE) AS lp, CAST(coalesce(p.notch, 50.0) AS DOUBLE) AS notch FROM c LEFT JOIN p USING (preset)""",
)
def p05(t):
    k = F.pmod(F.col("c_nationkey"), F.lit(4))
    c = t.table("customer").select("c_custkey", F.when(k == 0, "eeg").when(k == 1, "emg").when(k == 2, "ecg").otherwise("other").alias("preset"), F.when(F.col("c_custkey") % 3 == 0, 30.0).alias("lp"), F.lit(None).cast("double").alias("hp"), F.lit(None).cast("double").alias("notch"))
    return L.filter_settings(c, ["c_custkey"])


@query("p06_condition_settings", "WITH c AS (SELECT * FROM (VALUES ('AtoA', 0.0, 42), ('AtoB', 1.0, 100), ('AtoC', 1.6, 200), ('BtoC', 1.3, 300)) t(condition, disruption, seed)), e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'AtoA' WHEN 1 THEN 'AtoB' WHEN 2 THEN 'AtoC' WHEN 3 THEN 'BtoC' ELSE 'none' END AS condition FROM events) SELECT event_id, CAST(coalesce(disruption, 0) AS DOUBLE) AS disruption, CAST(coalesce(seed, 42) AS BIGINT) AS seed FROM e LEFT JOIN c USING (condition)")
def p06(t):
    names = F.array(*[F.lit(x) for x in ("AtoA", "AtoB", "AtoC", "BtoC", "none")])
    return L.condition_settings(t.table("events").select("event_id", F.get(names, (F.col("event_id") % 5).cast("int")).alias("condition")))


@query("p01_channel_slice", f"WITH {EPOCHS} SELECT label, count(*) AS n, round(sum(v), 5) AS total FROM e WHERE i < 8 GROUP BY label", digits=5)
def p01(t):
    return t.epochs().where("sample_idx < 8").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("p02_event_filter", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def p02(t):
    return t.table("events").where("event_type = 'purchase'").select("event_id", "user_id", "value")


@query("p04_time_mask", "SELECT user_id, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10' GROUP BY user_id")
def p04(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.table("events").where(F.col("ts").between(at("2024-01-05"), at("2024-01-10"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("p10_decibels", "SELECT event_id, round(10 * log10(value + 1e-12), 6) AS db, round(10 * log10(greatest(value, 1e-12) / greatest(100.0, 1e-12)), 6) AS relative_db FROM events")
def p10(t):
    return t.table("events").select("event_id", L.decibels(F.col("value")).alias("db"), L.relative_decibels(F.col("value"), F.lit(100.0)).alias("relative_db"))


@query("p18_memory_estimate", "SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 * 8 * 8 AS bytes, round(p_size * 64000 / 1048576.0, 6) AS mb FROM part")
def p18(t):
    return t.table("part").select("p_partkey", L.memory(F.col("p_size") * 1000, F.lit(8), "float64").alias("bytes")).withColumn("mb", F.col("bytes") / 1048576)


@query("x10_rounding", "SELECT event_id, CAST(round_even(value * 2.5, 0) AS BIGINT) AS half_even, CAST(ceil(value) AS BIGINT) AS up, CAST(floor(value) AS BIGINT) AS down, round(atan2(value, 100.0), 6) AS angle FROM events")
def x10(t):
    v = F.col("value")
    return t.table("events").select("event_id", F.rint(v * 2.5).cast("long").alias("half_even"), F.ceil(v).cast("long").alias("up"), F.floor(v).cast("long").alias("down"), F.atan2(v, F.lit(100.0)).alias("angle"))


# -- display ---------------------------------------------------------------------------------------------------------


@query("t04_stride", f"WITH {SERIES}, n AS (SELECT *, max(i) OVER (PARTITION BY user_id) + 1 AS n FROM u) SELECT event_id FROM n WHERE i % greatest(CAST(ceil(n / 20.0) AS BIGINT), 1) = 0")
def t04(t):
    return Q.every_nth(t.series(), U, "sample_idx", 20).select("event_id")


@query("t05_floor_stride", f"WITH {SERIES}, n AS (SELECT *, max(i) OVER (PARTITION BY user_id) + 1 AS n FROM u) SELECT event_id FROM n WHERE i % greatest(n // 20, 1) = 0")
def t05(t):
    return Q.every_nth(t.series(), U, "sample_idx", 20, "floor").select("event_id")


@query("t06_even_places", f"WITH {EPOCHS}, g AS (SELECT DISTINCT CAST(floor(k * 63 / 29.0 + 1e-9) AS BIGINT) AS i FROM (SELECT unnest(range(30)) AS k)) SELECT vec_id, i AS sample_idx, round(v, 6) AS value FROM e JOIN g USING (i)")
def t06(t):
    return Q.even_places(t.epochs(), "sample_idx", 64, 30).select("vec_id", "sample_idx", "value")


@query("t08_last_points", f"WITH {SERIES} SELECT event_id FROM (SELECT *, max(i) OVER (PARTITION BY user_id) - i AS back FROM u) WHERE back < 10")
def t08(t):
    w = W.partitionBy("user_id").orderBy(F.desc("sample_idx"))
    return t.series().withColumn("nth", F.row_number().over(w)).where("nth <= 10").select("event_id")


@query("s16_preview", f"WITH {SERIES} SELECT user_id, i AS sample_idx, value FROM u WHERE i < 5")
def s16(t):
    return writers.preview(t.series(), 5).select("user_id", "sample_idx", "value")


# -- text and messages -----------------------------------------------------------------------------------------------


@query("x07_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def x07(t):
    return t.table("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("x08_map_entries", "SELECT event_id, unnest(['value', 'k']) AS key, round(unnest([value, CAST(json_extract(props, '$.k') AS DOUBLE)]), 6) AS x FROM events")
def x08(t):
    m = F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.from_json("props", "k double")["k"])
    return t.table("events").select("event_id", F.explode(m).alias("key", "x"))


@query("x03_report_rows", "SELECT c_custkey, '| ' || c_name || ' | ' || printf('%.2f', c_acctbal) || ' | ' || c_mktsegment || ' |' AS line FROM customer")
def x03(t):
    return t.table("customer").select("c_custkey", writers.markdown_row(F.col("c_name"), F.format_string("%.2f", "c_acctbal"), F.col("c_mktsegment")).alias("line"))


@query("s18_json_rows", "SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}' AS json FROM customer")
def s18(t):
    c = t.table("customer")
    return c.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("json"))


@query("x06_relative_time", f"WITH {SERIES} SELECT event_id, round((epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY user_id ORDER BY i))) / 1000000.0, 6) AS t_sec FROM u")
def x06(t):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.series().select("event_id", ((us - F.first(us).over(W.partitionBy("user_id").orderBy("sample_idx"))) / 1000000).alias("t_sec"))


@query("s24_name_groups", "SELECT c_custkey, coalesce(nullif(regexp_extract(c_name, '#0*([0-9])', 1), ''), 'other') AS grp FROM customer")
def s24(t):
    return t.table("customer").select("c_custkey", F.coalesce(F.nullif(F.regexp_extract("c_name", "#0*([0-9])", 1), F.lit("")), F.lit("other")).alias("grp"))


@query("s13_markers", f"WITH {SERIES} SELECT user_id, i AS sample_idx, 'marker_' || CAST(CAST(value AS INT) % 4 AS VARCHAR) AS event_id FROM (SELECT user_id, i, floor(value) AS value FROM u) WHERE CAST(value AS INT) % 4 <> 0")
def s13(t):
    v = F.floor("value").cast("int") % 4
    return t.series().where(v != 0).select("user_id", "sample_idx", F.concat(F.lit("marker_"), v.cast("string")).alias("event_id"))


@query(
    "s14_resolved_events",
    """WITH g AS (SELECT user_id, event_type, ts, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS pri FROM events), b AS (SELECT *, min(pri) OVER (PARTITION BY user_id) AS best FROM g) SELECT user_id, event_type, ts FROM b WHERE pri = best""",
)
def s14(t):
    e = t.table("events").select("user_id", "event_type", "ts", F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2).alias("pri"))
    return e.withColumn("best", F.min("pri").over(W.partitionBy("user_id"))).where("pri = best").select("user_id", "event_type", "ts")


@query("j12_assignments", "SELECT c_name AS filename, o_orderkey AS assignment FROM customer JOIN orders ON c_custkey = o_custkey")
def j12(t):
    files, jobs = t.table("customer").select(F.col("c_custkey").alias("f"), F.col("c_name").alias("filename")), t.table("orders").select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("assignment"))
    return files.join(jobs, "f").select("filename", "assignment")


@query(
    "s01_file_formats",
    """WITH l AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '%OpenBCI ' || event_type WHEN 1 THEN '0,1,2,3,4,5,6,7,8,' || user_id WHEN 2 THEN 'time,' || event_type
WHEN 3 THEN replace('0.5 1 2 3 4 5 6 7 8 9 ', ' ', chr(9)) || user_id WHEN 4 THEN replace('Index EXG0 Timestamp Marker ', ' ', chr(9)) || event_type ELSE '1,2,3,' || event_type || ',5,6,7,8,9,10' END AS line FROM events),
f AS (SELECT id, line, string_split(line, CASE WHEN contains(line, chr(9)) THEN chr(9) ELSE ',' END) AS c FROM l)
SELECT id, CASE WHEN starts_with(line, '%OpenBCI') THEN 'odf' WHEN NOT starts_with(line, '%') AND len(c) >= 10 AND len(list_filter(c, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) = 0 THEN 'board' WHEN contains(line, chr(9)) AND list_contains(list_transform(c, lambda x: lower(x)), 'index') AND list_contains(list_transform(c, lambda x: lower(x)), 'marker') THEN 'session' ELSE 'plain' END AS format, CASE WHEN contains(line, chr(9)) THEN 'tab' ELSE 'comma' END AS separator FROM f""",
)
def s01(t):
    """First lines of files of six kinds, one made of each event."""
    kind, user, i = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id") % 6
    line = (
        F.when(i == 0, F.concat(F.lit("%OpenBCI "), kind)).when(i == 1, F.concat(F.lit("0,1,2,3,4,5,6,7,8,"), user)).when(i == 2, F.concat(F.lit("time,"), kind))
        .when(i == 3, F.concat(F.lit("0.5\t1\t2\t3\t4\t5\t6\t7\t8\t9\t"), user)).when(i == 4, F.concat(F.lit("Index\tEXG0\tTimestamp\tMarker\t"), kind)).otherwise(F.concat(F.lit("1,2,3,"), kind, F.lit(",5,6,7,8,9,10")))
    )
    df = t.table("events").select(F.col("event_id").alias("id"), line.alias("line"))
    return df.select("id", readers.file_format(F.col("line")).alias("format"), F.when(readers.separator(F.col("line")) == "\t", "tab").otherwise("comma").alias("separator"))


@query(
    "s08_board_map",
    "SELECT p_partkey, p_size % 16 + 15 AS n_cols, coalesce(board, 'unknown') AS board, n_exg, board_fs FROM part LEFT JOIN (VALUES (24, 'cyton', 8, 250), (28, 'daisy', 16, 125), (18, 'ganglion', 4, 200), (15, 'ganglion', 4, 200), (22, 'cyton', 8, 250), (30, 'daisy', 16, 125)) t(k, board, n_exg, board_fs) ON p_size % 16 + 15 = k",
)
def s08(t):
    """The board of files with 15 to 30 columns, one for each part."""
    files = t.table("part").select("p_partkey", (F.col("p_size") % 16 + 15).cast("int").alias("n_cols"))
    got = files.join(F.broadcast(readers.board_map(t.spark)), "n_cols", "left")  # six rows
    return got.select("p_partkey", "n_cols", F.coalesce("board", F.lit("unknown")).alias("board"), "n_exg", "board_fs")


# -- streams ---------------------------------------------------------------------------------------------------------


def _streamed(t: Tables, build, keep: list[str] | None = None):
    """Runs the events table through a streaming query to its end and gives what it appended."""
    from ..sources.scratch import folder

    spark = t.spark
    src = spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    out = folder(spark, "stream")
    q = build(src).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(*keep or ["*"])


@query(
    "r03_sliding_windows",
    "WITH w AS (SELECT event_type, value, unnest(range(0, 24, 6)) AS k, time_bucket(INTERVAL 6 HOURS, ts) AS b FROM events) SELECT event_type, b - to_hours(CAST(k AS BIGINT)) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2",
)
def r03(t):
    e = t.table("events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return live.windowed(e, ["event_type"], size="24 hours", every="6 hours").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean")


@query("r04_filled_grid", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), t AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2) SELECT t.event_type, CAST(d.day AS VARCHAR) AS day, round(coalesce(v, 0), 6) AS v FROM t CROSS JOIN d LEFT JOIN c ON c.event_type = t.event_type AND c.day = d.day")
def r04(t):
    e = t.table("events").select("event_type", F.to_date("ts").alias("day"), "value")
    grid = e.select("day").distinct().crossJoin(e.select("event_type").distinct())
    return grid.join(e.groupBy("event_type", "day").agg(F.sum("value").alias("v")), ["event_type", "day"], "left").select("event_type", F.col("day").cast("string").alias("day"), F.coalesce("v", F.lit(0.0)).alias("v"))


@query(
    "r05_sessions",
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""",
)
def r05(t):
    e = t.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return live.sessions(e, ["user_id"], "12 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    "r05_fan_out",
    """WITH l AS (SELECT user_id % 40 AS room, event_id, CASE event_type WHEN 'purchase' THEN 'frame' WHEN 'signup' THEN 'join' WHEN 'error' THEN 'leave' END AS kind, user_id FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
c AS (SELECT room, user_id, event_id, kind, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM l WHERE kind <> 'frame'),
s AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM c WHERE kind <> coalesce(before, 'leave'))
SELECT f.room, CAST(s.user_id AS VARCHAR) AS client, f.event_id AS "offset", s.event_id AS since FROM l f JOIN s ON f.room = s.room AND f.kind = 'frame' AND s.kind = 'join' AND f.event_id > s.event_id AND f.event_id < coalesce(s.until, 1e15)""",
)
def r05_fan_out(t):
    """Purchases as frames of forty rooms, sign-ups as joining, errors as leaving."""
    from ..streaming import fanout

    def build(src):
        kind = F.when(F.col("event_type") == "purchase", "frame").when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "leave")
        return fanout.spans(src.select((F.col("user_id") % 40).alias("room"), "event_id", kind.alias("kind"), "user_id"), "room", "event_id", "kind", "user_id")

    return fanout.sent(_streamed(t, build), "room")  # the stream stores frames and spans; they become rows where they are read


@query(
    "r08_streamed_flow_state",
    f"WITH {SERIES} SELECT user_id, event_id, coalesce(last_value(CASE WHEN value > 150 THEN 'entered' WHEN value < 10 THEN 'exited' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'idle') AS state FROM u",
)
def r08(t):
    def build(src):
        return live.flow_state(src.select("user_id", "event_id", (F.col("value") > 150).alias("enter"), (F.col("value") < 10).alias("leave")), "user_id", "event_id")

    return _streamed(t, build, ["user_id", "event_id", "state"])


@query("r09_latest_by_room", "SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def r09(t):
    return live.latest(t.table("events"), "user_id", "event_id", ["value", "event_type"])


@query("r10_recorder_markers", f"WITH {SERIES}, s AS (SELECT event_id, coalesce(last_value(CASE WHEN value > 150 THEN 3 WHEN value < 10 THEN 4 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i), 0) AS marker FROM u) SELECT event_id, CAST(marker AS BIGINT) AS marker FROM s")
def r10(t):
    s = Q.hysteresis(t.series(), U, "sample_idx", F.col("value") > 150, F.col("value") < 10)
    return live.recorder_rows(s).select("event_id", "marker")


@query("r11_batch_status", "SELECT o_custkey AS recording, count(*) AS files, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(count(*) FILTER (WHERE o_orderstatus <> 'P') / count(*), 6) AS progress FROM orders GROUP BY o_custkey")
def r11(t):
    bad = F.col("o_orderstatus") == "P"
    return t.table("orders").groupBy(F.col("o_custkey").alias("recording")).agg(F.count(F.lit(1)).alias("files"), F.count_if(bad).alias("failed"), (F.count_if(~bad) / F.count(F.lit(1))).alias("progress"))


# -- exports ---------------------------------------------------------------------------------------------------------


@query(
    "s15_wide_table",
    f"WITH {EPOCHS} SELECT CAST(vec_id AS VARCHAR) AS recording_id, round(CAST((i // 2) / 128.0 AS DOUBLE), 6) AS time, round(max(CASE WHEN i % 2 = 0 THEN v END), 6) AS c0, round(max(CASE WHEN i % 2 = 1 THEN v END), 6) AS c1 FROM e GROUP BY vec_id, i // 2",
)
def s15(t):
    k = F.expr("sample_idx div 2")
    s = t.epochs().select(F.col("vec_id").cast("string").alias("recording_id"), k.alias("sample_idx"), (k / 128.0).alias("t_sec"), F.concat(F.lit("c"), (F.col("sample_idx") % 2).cast("string")).alias("channel"), "value")
    return writers.wide(s, ["c0", "c1"])


@query(
    "s17_detail_export",
    "SELECT o_orderpriority AS condition, o_orderstatus AS indicator, round(avg(o_totalprice), 3) AS baseline, round(min(o_totalprice), 3) AS attenuation, round(max(o_totalprice), 3) AS recovery FROM orders GROUP BY 1, 2",
    digits=3,
)
def s17(t):
    o = t.table("orders").groupBy(F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("k")).agg(F.avg("o_totalprice").alias("b"), F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("r"))
    as_map = lambda v: F.map_from_entries(F.collect_list(F.struct("k", v)))
    results = o.groupBy("condition").agg(as_map("b").alias("baseline_means"), as_map("a").alias("attenuation"), as_map("r").alias("recovery_per_feature"))
    return writers.detail_export(results)


@query("a41_focus", 'SELECT user_id, round(avg(value / 500), 6) AS "avg", round(1 - stddev_pop(value / 500), 6) AS stability FROM events GROUP BY user_id')
def a41(t):
    from ..functions import learning

    return learning.focus(t.table("events").select("user_id", (F.col("value") / 500).alias("score")), U)


@query(
    "s02_board_rows",
    f"""WITH {SERIES}, l AS (SELECT event_id, i, CAST(i AS VARCHAR) || ',' || CAST(value AS VARCHAR) || ',' || (CASE WHEN event_id % 7 = 0 THEN '-' ELSE '1' END) AS line FROM u), c AS (SELECT event_id, list_transform(string_split(line, ','), lambda x: TRY_CAST(x AS DOUBLE)) AS nums FROM l)
SELECT event_id, nums[2] AS x FROM c WHERE len(list_filter(nums, lambda x: x IS NULL)) = 0""",
)
def s02(t):
    line = F.concat_ws(",", F.col("sample_idx").cast("string"), F.col("value").cast("string"), F.when(F.col("event_id") % 7 == 0, "-").otherwise("1"))
    nums = t.series().select("event_id", readers.numbers(line).alias("nums"))
    return nums.where(F.forall("nums", lambda x: x.isNotNull())).select("event_id", F.get("nums", F.lit(1)).alias("x"))


@query(
    "w07_rate_from_median_step",
    f"WITH {SERIES}, d AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY i))) / 1e11 AS dt FROM u) SELECT user_id, CAST(round_even(1 / median(dt), 0) AS BIGINT) AS fs FROM d GROUP BY user_id",
)
def w07_rate(t):
    s = t.series().select("user_id", "sample_idx", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e11).alias("t"))
    return Q.rate_from_median_step(s, U, "sample_idx", "t")
