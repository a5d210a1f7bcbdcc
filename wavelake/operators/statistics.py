"""Comparisons of groups and conditions as aggregates; p values through ``functions.distributions``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schema as S
from ..functions import distributions as D
from . import series
from .resampling import bootstrap, numbered, permutation_test

TINY = S.TINY


def effect_label(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def eta_label(e: Column) -> Column:
    return F.when(e < 0.01, "negligible").when(e < 0.06, "small").when(e < 0.14, "medium").otherwise("large")


def pair_up(a: DataFrame, b: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """(keys, pos, a, b): the n-th value of one group with the n-th of the other, as far as both go."""
    one = lambda df, n: numbered(df.select(*keys, F.col(order).alias("_o"), F.col(value).alias(n)), keys, ["_o", n], f"pairs-{n}").drop("_o")
    return one(a, "a").join(one(b, "b"), [*keys, "pos"]).withColumn("pos", F.col("pos") + 1)


def paired_t(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean_diff, std_diff, t_stat, df, d): neutral values with fewer than two pairs or no spread."""
    d = F.col("a") - F.col("b")
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    fine = (F.col("n") >= 2) & (F.col("s") > 0)
    return g.select(
        *keys, "n", F.when(F.col("n") >= 2, F.col("m")).otherwise(0.0).alias("mean_diff"), F.coalesce("s", F.lit(0.0)).alias("std_diff"),
        F.when(fine, F.col("m") / F.expr("IF(s > 0, s, 1)") * F.sqrt(F.col("n").cast("double"))).otherwise(0.0).alias("t_stat"),
        (F.col("n") - 1).alias("df"), F.when((F.col("n") >= 2) & (F.col("s") > TINY), F.col("m") / F.expr("IF(s > 0, s, 1)")).otherwise(0.0).alias("d"),
    )


def with_p(t: DataFrame) -> DataFrame:
    """Adds p_value (two-sided) and the 95 % interval of the mean difference."""
    t = t.withColumn("p_value", F.when(F.col("df") < 1, 1.0).otherwise(D.t_p(F.col("t_stat"), F.col("df").cast("double"))))
    half = D.t_ppf(F.lit(0.975), F.col("df").cast("double")) * F.col("std_diff") / F.sqrt(F.col("n").cast("double"))
    return t.withColumn("ci_low", F.col("mean_diff") - half).withColumn("ci_high", F.col("mean_diff") + half)


def pooled_d(values: DataFrame, keys: list[str], group: str, a, b, value: str = "value") -> DataFrame:
    """(keys, n_a, n_b, mean_diff, pooled_std, d, label) of two independent groups."""
    pick = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    t = values.groupBy(*keys).agg(
        pick(a, F.count).alias("n_a"), pick(b, F.count).alias("n_b"), pick(a, F.avg).alias("ma"), pick(b, F.avg).alias("mb"),
        F.coalesce(pick(a, F.var_samp), F.lit(0.0)).alias("va"), F.coalesce(pick(b, F.var_samp), F.lit(0.0)).alias("vb"),
    )
    na, nb = F.col("n_a"), F.col("n_b")
    t = t.withColumn("pooled_std", F.sqrt((F.greatest(na - 1, F.lit(0)) * F.col("va") + F.greatest(nb - 1, F.lit(0)) * F.col("vb")) / F.greatest(na + nb - 2, F.lit(1))))
    t = t.withColumn("mean_diff", F.coalesce(F.col("ma") - F.col("mb"), F.lit(0.0))).withColumn("d", F.when(F.col("pooled_std") > TINY, F.try_divide("mean_diff", "pooled_std")).otherwise(0.0))
    return t.select(*keys, "n_a", "n_b", "mean_diff", "pooled_std", "d", effect_label(F.col("d")).alias("label"))


def repeated_anova(values: DataFrame, keys: list[str], subject: str, condition: str, value: str = "value") -> DataFrame:
    """(keys, n, k, ss_between, ss_within, ss_subject, ss_error, f_stat, eta2, partial_eta2) of complete subject x condition cells."""
    by = lambda *c: W.partitionBy(*keys, *c)
    cell = values.groupBy(*keys, subject, condition).agg(F.avg(value).alias("x"))
    m = cell.select(*keys, subject, condition, "x", F.avg("x").over(by()).alias("g"), F.avg("x").over(by(condition)).alias("c"), F.avg("x").over(by(subject)).alias("s"))
    sq = lambda x: F.sum(x * x)
    t = m.groupBy(*keys).agg(
        F.countDistinct(subject).alias("n"), F.countDistinct(condition).alias("k"), sq(F.col("c") - F.col("g")).alias("ss_between"),
        sq(F.col("x") - F.col("c")).alias("ss_within"), sq(F.col("s") - F.col("g")).alias("ss_subject"),
    )
    t = t.withColumn("ss_error", F.col("ss_within") - F.col("ss_subject"))
    ms = F.col("ss_error") / ((F.col("n") - 1) * (F.col("k") - 1) + TINY)
    fine = (F.col("n") >= 2) & (F.col("k") >= 2)
    f = F.when(fine, F.try_divide(F.col("ss_between"), (F.col("k") - 1).cast("double")) / (ms + TINY)).otherwise(0.0)
    return (
        t.withColumn("f_stat", f).withColumn("eta2", F.when(fine, F.col("ss_between") / (F.col("ss_between") + F.col("ss_within") + TINY)).otherwise(0.0))
        .withColumn("partial_eta2", F.when(fine, F.col("ss_between") / F.greatest(F.col("ss_between") + F.col("ss_error"), F.lit(TINY))).otherwise(0.0))
    )


def anova_p(t: DataFrame) -> DataFrame:
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    return t.withColumn("p_value", F.when((k < 2) | (n < 2), 1.0).otherwise(D.f_p(F.col("f_stat"), F.greatest(k - 1, F.lit(1.0)), F.greatest((n - 1) * (k - 1), F.lit(1.0)))))


def pearson(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, r, t_stat); r is 0 with fewer than three pairs or no spread."""
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"))
    g = g.withColumn("r", F.when((F.col("n") >= 3) & F.col("r").isNotNull() & ~F.isnan("r"), F.col("r")).otherwise(0.0))
    return g.withColumn("t_stat", F.col("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(TINY))))


def signed_rank(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, w, ties, zeros): smaller sum of ranks of the non-zero differences, mean ranks for ties."""
    d = pairs.select(*keys, (F.col("a") - F.col("b")).alias("d"))
    zeros = d.groupBy(*keys).agg(F.count_if(F.col("d") == 0).alias("zeros"))
    nz = d.where("d <> 0").withColumn("x", F.abs("d"))
    w, tie = W.partitionBy(*keys).orderBy("x"), W.partitionBy(*keys, "x")
    nz = nz.withColumn("t", F.count(F.lit(1)).over(tie)).withColumn("rank", F.rank().over(w) + (F.col("t") - 1) / 2)
    g = nz.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("down"),
        F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"),
    )
    return g.join(zeros, keys).select(*keys, "n", F.least("up", "down").alias("w"), "ties", (F.col("zeros") > 0).alias("zeros"))


def benjamini_hochberg(tests: DataFrame, keys: list[str], p: str = "p_value", order: str = "test_id", alpha: float = 0.05, buckets: int = 1024) -> DataFrame:
    """Adds adjusted_p and significant over the tests of each key.

    The tests of a key are dealt out by ``buckets`` equal ranges of p, so that not even the tests of a whole table meet in one
    task; ranks and later minima of a bucket come from a table of one row for each bucket.  A null p ranks first and stays null.
    """
    by = [*keys, "_b"]
    t = tests.withColumn("_b", F.coalesce(F.least(F.floor(F.col(p) * buckets), F.lit(buckets - 1)), F.lit(-1)))
    over_keys = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # at most buckets + 1 rows
    n = t.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_all", F.sum("_n").over(over_keys)).withColumn("_before", F.sum("_n").over(over_keys.orderBy("_b")) - F.col("_n")).drop("_n")
    part = W.partitionBy(*by)
    up = part.orderBy(p, order)
    t = t.join(n, by).withColumn("_raw", F.col(p) * F.col("_all") / (F.col("_before") + F.row_number().over(up)))
    least = t.groupBy(*by).agg(F.min("_raw").alias("_least"))
    later = over_keys.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    least = least.withColumn("_later", F.min("_least").over(later)).drop("_least")
    down = part.orderBy(F.desc(p), F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    t = t.join(least, by).withColumn("adjusted_p", F.when(F.col(p).isNotNull(), F.least(F.min("_raw").over(down), F.col("_later"), F.lit(1.0))))
    return t.drop("_b", "_all", "_before", "_raw", "_later").withColumn("significant", F.col("adjusted_p") < alpha)


def bonferroni(tests: DataFrame, keys: list[str], p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Adds adjusted_p, threshold and significant; tests are counted by an aggregate, so those of a whole table stay where they are."""
    tests, by = (tests, keys) if keys else (tests.withColumn("_all", F.lit(0)), ["_all"])
    t = tests.join(tests.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), by)
    n = F.col("_n")
    return t.withColumn("adjusted_p", F.least(F.col(p) * n, F.lit(1.0))).withColumn("threshold", F.lit(alpha) / n).withColumn("significant", F.col(p) < F.lit(alpha) / n).drop("_n", "_all")


def summary(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, mean, std, sem, min, max); std and sem are 0 for one value."""
    g = values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    sd = F.when(F.col("n") > 1, F.col("sd")).otherwise(0.0)
    return g.select(*keys, "n", "mean", sd.alias("std"), (sd / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double"))).alias("sem"), "min", "max")


def with_interval(t: DataFrame, level: float = 0.95) -> DataFrame:
    half = F.when(F.col("n") > 1, D.t_ppf(F.lit(0.5 + level / 2), (F.col("n") - 1).cast("double")) * F.col("sem")).otherwise(0.0)
    return t.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def rigorous(values: DataFrame, keys: list[str], group: str, a, b, order: str, value: str = "value", n: int = 1000, seed: int = 0) -> DataFrame:
    """One row for each key: description of both groups, paired t test, effect size, permutation test, bootstrap interval of the mean
    difference, and a sentence.  Values that are null or not a number are left out; pairs are the n-th values by ``order``."""
    v = values.where(F.col(group).isin(a, b) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    told = with_interval(summary(v, [*keys, group], value))
    side = lambda g, s: told.where(F.col(group) == g).select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("n", "mean", "std", "sem", "ci_low", "ci_high")])
    pairs = pair_up(v.where(F.col(group) == a), v.where(F.col(group) == b), keys, order, value)
    t = with_p(paired_t(pairs, keys)).select(*keys, "t_stat", "df", F.col("p_value").alias("t_p"), "mean_diff", "ci_low", "ci_high", "d", effect_label(F.col("d")).alias("label"))
    perm = permutation_test(v, keys, group, a, b, value, n, seed).select(*keys, F.col("p_value").alias("permutation_p"))
    boot = bootstrap(pairs.select(*keys, (F.col("a") - F.col("b")).alias("value")), keys, "value", n, seed=seed).select(*keys, F.col("ci_low").alias("boot_low"), F.col("ci_high").alias("boot_high"))
    out = side(a, "a").join(side(b, "b"), keys).join(t, keys).join(perm, keys).join(boot, keys)
    word = lambda p: F.when(F.col(p) < 0.05, "significant").otherwise("not significant")
    text = F.format_string(
        "A %.2f ± %.2f (n=%d), B %.2f ± %.2f (n=%d). Paired t=%.3f, p=%.4f (%s), df=%d. Difference %.2f [%.2f, %.2f], d=%.3f (%s). Permutation p=%.4f (%s, %d). Bootstrap [%.2f, %.2f].",
        "mean_a", "std_a", "n_a", "mean_b", "std_b", "n_b", "t_stat", "t_p", word("t_p"), "df", "mean_diff", "ci_low", "ci_high", "d", "label", "permutation_p", word("permutation_p"), F.lit(n), "boot_low", "boot_high",
    )
    return out.withColumn("summary", text)


def profile(values: DataFrame, condition: str, axes: dict[str, bool]) -> DataFrame:
    """One row for each condition, axes scaled to 0..1 over conditions (True: turned round); 1 where all are equal."""
    w = W.partitionBy(F.lit(0))  # one row for each condition
    cols = []
    for c, turned in axes.items():
        low, high = F.min(c).over(w), F.max(c).over(w)
        x = F.try_divide(F.col(c) - low, high - low)
        cols.append(F.coalesce((1 - x) if turned else x, F.lit(1.0)).alias(c))
    return values.select(condition, *cols)


def confusion(rows: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """(keys, tp, fp, tn, fn, accuracy, precision, recall, f1); 0 where a measure is undefined."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    c = rows.groupBy(*keys).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(~t & ~g).alias("tn"), F.count_if(t & ~g).alias("fn"))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumn("accuracy", part(tp + tn, tp + fp + tn + fn)).withColumn("precision", part(tp, tp + fp)).withColumn("recall", part(tp, tp + fn))
    return c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def pairs_of(values: DataFrame, condition: str, subject: str, value: str = "value") -> DataFrame:
    """(condition_a, condition_b, a, b) of every two conditions, by subject."""
    one = lambda s: values.select(F.col(condition).alias(f"condition_{s}"), F.col(subject).alias("_s"), F.col(value).alias(s))
    return one("a").join(one("b"), "_s").where("condition_a < condition_b").drop("_s")
