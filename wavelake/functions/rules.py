"""Scalar rules: lookups with defaults, classes of numbers, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def decibels(x: Column) -> Column:
    return 10 * F.log10(x + S.TINY)


def relative_decibels(x: Column, base: Column) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(S.TINY)) / F.greatest(base, F.lit(S.TINY)))


def recovery_class(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "not recovered").when(seconds < 60, "quick").when(seconds < 180, "moderate").when(seconds < 360, "slow").otherwise("very slow")


def attenuation_class(percent: Column, flow: bool = True) -> Column:
    """Direction and size of a mean attenuation; loss indicators have no direction."""
    size = F.when(F.abs(percent) > 40, "marked").when(F.abs(percent) > 20, "moderate").otherwise("slight")
    return F.concat(F.when(percent >= 0, "drop").otherwise("shift"), F.lit(" "), size) if flow else F.concat(F.lit("rise "), size)


def against_control(diff: Column) -> Column:
    return F.when(diff > 60, "longer").when(diff > 0, "slightly longer").otherwise("no longer")


def suggestions(recovery: Column, flow: Column, loss: Column) -> Column:
    """Array of suggestions from the recovery time and the arrays of attenuations."""
    large = lambda a: F.exists(a, lambda x: F.abs(x) > 40)
    found = F.array_compact(F.array(F.when(recovery > 180, "buffer"), F.when(large(flow), "fewer switches"), F.when(large(loss), "rest")))
    return F.when(F.size(found) == 0, F.array(F.lit("keep pace"))).otherwise(found)


def focus_hint(score: Column) -> Column:
    return F.when(score < 0.3, "low").when(score < 0.7, "medium").otherwise("high")


def training_status(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.7, "good").when(accuracy >= 0.55, "fair").otherwise("poor")


def filter_settings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hp, lp, notch): given values first, then those of the preset, then those for EEG."""
    table = rows.sparkSession.createDataFrame([(k, *v) for k, v in S.FILTER_PRESETS.items()], "preset string, p_hp double, p_lp double, p_notch double")
    j = rows.join(F.broadcast(table), "preset", "left")  # three rows
    pick = lambda c, d: F.coalesce(c, f"p_{c}", F.lit(d)).alias(c)
    hp, lp, notch = S.FILTER_PRESETS["eeg"]
    return j.select(*keys, pick("hp", hp), pick("lp", lp), pick("notch", notch))


def condition_settings(rows: DataFrame) -> DataFrame:
    """Adds disruption and seed of a condition, 0 and 42 for others."""
    table = rows.sparkSession.createDataFrame([(k, *v) for k, v in S.CONDITIONS.items()], "condition string, disruption double, seed long")
    j = rows.join(F.broadcast(table), "condition", "left")  # four rows
    return j.withColumn("disruption", F.coalesce("disruption", F.lit(0.0))).withColumn("seed", F.coalesce("seed", F.lit(42))).drop("condition")


# Bytes of a number.
ITEM_BYTES = {"float64": 8, "float32": 4, "float16": 2, "int64": 8, "int32": 4, "int16": 2, "int8": 1, "complex128": 16, "complex64": 8}


def memory(samples: Column, channels: Column, kind: str = "float64") -> Column:
    return samples.cast("long") * channels.cast("long") * F.lit(ITEM_BYTES.get(kind, 8))
