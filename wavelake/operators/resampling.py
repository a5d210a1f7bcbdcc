"""Permutation tests and bootstraps by counts.

The rows of a key are numbered by value (a range sort; ranges are tasks) and stand in blocks of BLOCK.  How many rows each draw takes
from a block is known in the block from seeds alone (``functions.draws``), so a block sees its rows once and gives one array with a
number for each draw; arrays are added up.  Rows are shuffled twice whatever the number of draws, and a hot key is many blocks.
The result depends on the rows and the seed alone, not on files or tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType
from pyspark.sql.window import Window as W

from ..functions import draws as D
from ..sources.scratch import staged

BLOCK = 2048
#: Sums within this share of the spread of the values count as equal.
NEAR = 1e-11
SPREADS = {"stddev_samp": 1, "stddev_pop": 0}


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """``rows`` with ``pos`` (long, from 0 in each key) in the order of ``order``, and their number in the key if ``total`` names it;
    rows that are alike in the order are told apart as they come."""
    by = [*keys, *order, "_tie"]
    # where the rows come from is read twice; which of two like rows comes first does not matter
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    ranged = staged(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), name)
    runs = ranged.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held"))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # one row for each key and task
    runs = runs.withColumn("_before", F.sum("_held").over(w.orderBy("_task")) - F.col("_held")).withColumn("_all", F.sum("_held").over(w))
    same = F.lit(True)
    for c in [*keys, "_task"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return ranged.alias("l").join(runs.alias("r"), same).select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), *([F.col("_all").alias(total)] if total else []))


def order_statistics(values: DataFrame, keys: list[str], q: dict[str, float], value: str = "value") -> DataFrame:
    """(keys, one double for each name of ``q``): exact quantiles, between neighbours in proportion, of keys of any size.

    Values are numbered by a range sort and the two places of each quantile are picked out, so no key is held in one task.  Nulls and
    values that are no numbers are left out; a key without any gives nulls.
    """
    v = F.col(value).cast("double")
    rows = values.select(*keys, F.when(~F.isnan(v), v).alias("_v"))
    placed = numbered(rows.where("_v IS NOT NULL"), keys, ["_v"], "order-rows", "_n")
    picks = []
    for name, share in q.items():
        at = (F.col("_n") - 1) * F.lit(float(share))
        low = F.floor(at)
        weight = F.when(F.col("pos") == low, 1 - (at - low)).when((F.col("pos") == low + 1) & (at > low), at - low)
        picks.append(F.sum(weight * F.col("_v")).alias(name))
    near = F.lit(False)
    for share in q.values():
        near = near | F.col("pos").between(F.floor((F.col("_n") - 1) * F.lit(float(share))), F.floor((F.col("_n") - 1) * F.lit(float(share))) + 1)
    found = placed.where(near).groupBy(*keys).agg(*picks)
    return _joined(rows.groupBy(*keys).agg(F.count("_v").alias("_held")), found, keys, "left").drop("_held")


def robust_scale(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, median, mad): the median, and the median distance from it times 1.4826, of keys of any size."""
    middle = staged(order_statistics(values, keys, {"median": 0.5}, value), "medians")
    away = _joined(values.select(*keys, F.col(value).cast("double").alias("_x")), middle, keys).select(*keys, F.abs(F.col("_x") - F.col("median")).alias("_x"))
    return _joined(middle, order_statistics(away, keys, {"mad": 0.5}, "_x"), keys).withColumn("mad", F.col("mad") * 1.4826)


def _summed(blocks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, k, columns): arrays of the blocks added up, number by number."""
    rows = blocks.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("k", "_z"))
    return rows.groupBy(*keys, "k").agg(*[F.sum(F.col("_z")[c]).alias(c) for c in columns])


def _by_blocks(rows: DataFrame, keys: list[str], columns: list[str], made, block: int) -> DataFrame:
    """One row for each (keys, block) with arrays ``columns``: ``made(x, block, n, extra, seed)`` of its values in order."""
    import pyarrow as pa

    rows = rows.withColumn("_block", F.expr(f"pos div {block}"))
    schema = StructType([rows.schema[c] for c in keys])
    for c in columns:
        schema = schema.add(c, ArrayType(DoubleType()))

    def run(table):
        table = table.sort_by("pos")
        one = {c: table.column(c)[0].as_py() for c in ("_block", "_n", "_extra", "_seed")}
        got = made(table.column("_x").to_numpy(), one["_block"], one["_n"], one["_extra"], one["_seed"])
        return pa.table([*[table.column(c).slice(0, 1) for c in keys], *[pa.array([v], pa.list_(pa.float64())) for v in got]], names=schema.names)

    return rows.groupBy(*keys, "_block").applyInArrow(run, schema)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def permutation_test(
    values: DataFrame, keys: list[str], group: str, a, b, value: str = "value", n: int = 1000, seed: int = 0, alternative: str = "two-sided", block: int = BLOCK
) -> DataFrame:
    """(keys, observed_diff, p_value, significant): n random splits of the pooled values into groups of the same sizes.

    Nulls and values that are no numbers are left out; with nothing left in one of the groups the difference is 0 and p is 1.
    """
    v = F.col(value).cast("double")
    pooled = values.where(F.col(group).isin(a, b)).select(*keys, F.when(~F.isnan(v), v).alias("_v"), (F.col(group) == a).alias("_a"))
    known = F.col("_v").isNotNull()
    seen = staged(
        pooled.groupBy(*keys).agg(
            F.count_if(F.col("_a") & known).alias("n_a"), F.count_if(~F.col("_a") & known).alias("n_b"), F.avg("_v").alias("mid"), F.stddev_pop("_v").alias("spread"),
            F.avg(F.when(F.col("_a"), F.col("_v"))).alias("mean_a"), F.avg(F.when(~F.col("_a"), F.col("_v"))).alias("mean_b"),
        ),
        "permutation-groups",
    )
    both = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    rows = _joined(numbered(pooled.where(known).select(*keys, "_v"), keys, ["_v"], "permutation-rows"), seen.where(both), keys)
    rows = rows.select(*keys, "pos", (F.col("_v") - F.col("mid")).alias("_x"), (F.col("n_a") + F.col("n_b")).alias("_n"), F.col("n_a").alias("_extra"), F.xxhash64(F.lit(seed), *keys).alias("_seed"))

    def made(x, at, total, n_a, key_seed):
        need, _ = D.shares(key_seed, n, total, n_a, block, at, False)
        return [D.subset_sums(D.block_generator(key_seed, at), x, need)]

    null = _joined(_summed(_by_blocks(rows, keys, ["d"], made, block), keys, ["d"]), seen, keys)
    diff = F.col("d") / F.col("n_a") + F.col("d") / F.col("n_b")  # deviations of both groups add up to nothing
    seen_diff, near = F.col("mean_a") - F.col("mean_b"), F.col("spread") * NEAR + 1e-12
    hit = {"greater": diff >= seen_diff - near, "less": diff <= seen_diff + near}.get(alternative, F.abs(diff) >= F.abs(seen_diff) - near)
    hits = null.groupBy(*keys).agg(F.count_if(hit).alias("_hits"))
    p = F.when(both, (F.col("_hits") + 1) / F.lit(n + 1.0)).otherwise(1.0)
    got = _joined(seen, hits, keys, "left")
    return got.select(*keys, F.when(both, seen_diff).otherwise(0.0).alias("observed_diff"), p.alias("p_value"), (p < 0.05).alias("significant"))


def bootstrap(values: DataFrame, keys: list[str], value: str = "value", n: int = 1000, level: float = 95.0, seed: int = 0, statistic="mean", block: int = BLOCK) -> DataFrame:
    """(keys, mean, ci_low, ci_high, bias): ``statistic`` of the values, its percentile interval over n draws with replacement, and the
    mean of the draws less that of the values.

    ``statistic``: "mean", "stddev_samp", "stddev_pop", "median", a number q of (0, 1) for that quantile (between neighbours in
    proportion), or any aggregate (a function of a column), for which each draw's rows are put together: rows times n are shuffled.
    Nulls and values that are no numbers are left out; a key without any gives nulls.
    """
    v = F.col(value).cast("double")
    rows = values.select(*keys, F.when(~F.isnan(v), v).alias("_v"))
    q = {"median": 0.5}.get(statistic, statistic) if not callable(statistic) else None
    own = {"mean": F.avg, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop}.get(statistic, statistic if callable(statistic) else lambda c: F.percentile(c, F.lit(q)))
    seen = staged(rows.groupBy(*keys).agg(F.count("_v").alias("size"), F.avg("_v").alias("mid"), own("_v").alias("mean")), "bootstrap-groups")
    placed = _joined(numbered(rows.where("_v IS NOT NULL"), keys, ["_v"], "bootstrap-rows"), seen.select(*keys, "size", "mid"), keys)
    placed = placed.select(*keys, "pos", (F.col("_v") - F.col("mid")).alias("_x"), F.col("size").alias("_n"), F.lit(0).alias("_extra"), F.xxhash64(F.lit(seed), *keys).alias("_seed"))

    def moments(x, at, total, _, key_seed):
        need, _ = D.shares(key_seed, n, total, total, block, at, True)
        s, s2 = np.zeros(n), np.zeros(n)
        for low, high, places, per in D.resamples(D.block_generator(key_seed, at), len(x), need):
            of = np.repeat(np.arange(high - low), per)
            s[low:high] = np.bincount(of, x[places], high - low)
            s2[low:high] = np.bincount(of, x[places] ** 2, high - low)
        return [s, s2]

    def ordered(x, at, total, _, key_seed):
        need, before = D.shares(key_seed, n, total, total, block, at, True)
        out = np.zeros(n)
        place = (total - 1) * q
        ranks = [(int(np.floor(place)), 1 - (place - np.floor(place))), (int(np.floor(place)) + 1, place - np.floor(place))]
        for low, high, places, per in D.resamples(D.block_generator(key_seed, at), len(x), need):
            cut = np.concatenate([[0], np.cumsum(per)])
            for k in range(low, high):
                inside = [(r - before[k], w) for r, w in ranks if w > 0 and before[k] <= r < before[k] + need[k]]
                if inside:
                    own_places = np.sort(places[cut[k - low] : cut[k - low + 1]])
                    out[k] = sum(w * x[own_places[r]] for r, w in inside)
        return [out]

    if callable(statistic):
        def gathered(x, at, total, _, key_seed):  # how often each row is in each draw, one draw after another
            need, _ = D.shares(key_seed, n, total, total, block, at, True)
            times = np.zeros((n, len(x)))
            for low, high, places, per in D.resamples(D.block_generator(key_seed, at), len(x), need):
                times[low:high] = np.bincount(np.repeat(np.arange(high - low), per) * len(x) + places, minlength=(high - low) * len(x)).reshape(-1, len(x))
            return [np.repeat(np.tile(x, n), times.ravel().astype(int)), np.repeat(np.repeat(np.arange(n), len(x)), times.ravel().astype(int)).astype(float)]

        parts = _by_blocks(placed, keys, ["x", "k"], gathered, block)
        each = _joined(parts.select(*keys, F.explode(F.arrays_zip("x", "k")).alias("_z")), seen.select(*keys, "mid"), keys)
        stats = each.select(*keys, F.col("_z")["k"].alias("k"), (F.col("_z")["x"] + F.col("mid")).alias("_v")).groupBy(*keys, "k").agg(own("_v").alias("s"))
    elif statistic == "mean" or statistic in SPREADS:
        stats = _joined(_summed(_by_blocks(placed, keys, ["s", "s2"], moments, block), keys, ["s", "s2"]), seen.select(*keys, "size", "mid"), keys)
        m = F.col("s") / F.col("size")
        around = F.greatest(F.col("s2") - F.col("s") * m, F.lit(0.0))
        less = SPREADS.get(statistic, 0)
        stats = stats.withColumn("s", F.col("mid") + m if statistic == "mean" else F.when(F.col("size") > less, F.sqrt(around / F.expr(f"greatest(size - {less}, 1)"))))
    else:
        stats = _joined(_summed(_by_blocks(placed, keys, ["s"], ordered, block), keys, ["s"]), seen.select(*keys, "mid"), keys).withColumn("s", F.col("s") + F.col("mid"))
    tail = (100 - level) / 200
    got = stats.groupBy(*keys).agg(F.percentile("s", F.lit(tail)).alias("ci_low"), F.percentile("s", F.lit(1 - tail)).alias("ci_high"), F.avg("s").alias("_m"))
    return _joined(seen.select(*keys, "mean"), got, keys, "left").select(*keys, "mean", "ci_low", "ci_high", (F.col("_m") - F.col("mean")).alias("bias"))
