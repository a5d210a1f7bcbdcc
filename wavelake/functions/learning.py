"""Features, windows and interfaces of learned models over windows of signals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S

Scorer = Callable[[np.ndarray], np.ndarray]


def features(psd: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, one share for each band of the sum of the five mean powers, variance)."""
    mean = lambda lo, hi: F.avg(F.when((F.col("freq") >= lo) & (F.col("freq") < hi), F.col("power")))
    b = psd.groupBy(*keys).agg(*[mean(*r).alias(n) for n, r in S.BANDS.items()])
    total = sum((F.col(n) for n in S.BANDS), F.lit(0.0)) + 1e-8
    b = b.select(*keys, *[(F.col(n) / total).alias(n) for n in S.BANDS])
    return b.join(samples.groupBy(*keys).agg(F.var_pop("value").alias("variance")), keys)


def scores(windows: DataFrame, keys: list[str], scorer: Scorer | None = None) -> DataFrame:
    """(keys, score) of windows with an array ``x``: a scorer takes a matrix of windows; one that it fails on has no score.

    Without a scorer every score is null.
    """
    if scorer is None:
        return windows.select(*keys, F.lit(None).cast("double").alias("score"))

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        def one(v):
            try:
                return float(scorer(np.stack([v]))[0])
            except Exception:
                return None

        try:
            return pd.Series(np.asarray(scorer(np.stack(x.to_list())), float))
        except Exception:
            return pd.Series([one(v) for v in x], dtype=float)

    return windows.select(*keys, apply("x").alias("score"))


def focus(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, avg, stability): mean of the scores and one minus their deviation, 0 without scores."""
    g = scored.groupBy(*keys).agg(F.avg("score").alias("a"), F.stddev_pop("score").alias("s"))
    return g.select(*keys, F.coalesce("a", F.lit(0.0)).alias("avg"), F.coalesce(1 - F.col("s"), F.lit(0.0)).alias("stability"))


def classifier(train: DataFrame, label: str = "target", columns: list[str] | None = None, rounds: int = 50, progress: Callable[[dict], None] | None = None):
    """Logistic regression on the features: a stand-in for a convolutional network, which needs libraries this engine does without.

    ``progress`` is called with the round and the loss of every round once the model is fitted.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    columns = columns or [*S.BANDS, "variance"]
    steps = [VectorAssembler(inputCols=columns, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="features", withMean=True), LogisticRegression(labelCol=label, maxIter=rounds)]
    model = Pipeline(stages=steps).fit(train)
    if progress:
        for k, loss in enumerate(model.stages[-1].summary.objectiveHistory):
            progress({"round": k, "loss": float(loss)})
    return model


def predicted(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction`` (int) and ``probability`` (of class 1)."""
    from pyspark.ml.functions import vector_to_array

    got = model.transform(rows).withColumn("_p", F.element_at(vector_to_array("probability"), 2))
    return got.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), F.col("_p").alias("probability"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
