"""Calibrated judges (R1, R2, A2): scores turned into probabilities.

A naive Bayes judge adds up evidence as if words were independent, so its
probabilities pile up at 0 and 1 and a threshold says little. An isotonic fit
on labelled rows that the judge was not fitted on gives each score the share
of positive rows near it: the best rising step function, found by Spark ML's
pool-adjacent-violators, which pools inside partitions first.
"""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FEATURE, _LABEL, _WEIGHT, _OUT = "_score", "_label", "_weight", "_calibrated"
# ties among scores that differ in the last digits by the order of a sum
DIGITS = 9


def fit_calibration(scored: DataFrame, score: str, label: str) -> IsotonicRegressionModel | None:
    """Fit on (score, label 0/1) rows. Null scores and labels are left out; equal
    scores (to nine digits) are one point that weighs as many rows. None without any row."""
    rows = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.round(score, DIGITS).alias(_FEATURE)).agg(
        F.avg(F.col(label).cast("double")).alias(_LABEL), F.count(F.lit(1)).cast("double").alias(_WEIGHT))
    if not rows.limit(1).count():
        return None
    return IsotonicRegression(featuresCol=_FEATURE, labelCol=_LABEL, weightCol=_WEIGHT, predictionCol=_OUT).fit(rows)


def calibrated(df: DataFrame, score: str, model: IsotonicRegressionModel | None, out: str = "p") -> DataFrame:
    """The rows with ``out``, the probability that belongs to the score; scores
    between two fitted ones are interpolated, a null score gives null. Without a
    model the score stays as it is."""
    if model is None:
        return df.withColumn(out, F.col(score).cast("double"))
    known = df.where(F.col(score).isNotNull()).withColumn(_FEATURE, F.round(score, DIGITS))
    made = model.transform(known).withColumn(out, F.col(_OUT)).drop(_FEATURE, _OUT)
    return made.unionByName(df.where(F.col(score).isNull()).withColumn(out, F.lit(None).cast("double")))


def brier_score(df: DataFrame, p: str, label: str) -> DataFrame:
    """(n, brier): the mean squared distance of probability and label."""
    both = F.col(p).isNotNull() & F.col(label).isNotNull()
    return df.where(both).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label))).alias("brier"))
