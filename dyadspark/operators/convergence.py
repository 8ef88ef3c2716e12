"""When a Monte-Carlo fit has converged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions.rng import draw
from dyadspark.operators.covariance import matrix
from dyadspark.spec import FitResult


def f_quantile(spark: SparkSession, p: float, d1: float, d2: float) -> float:
    return float(spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(d1), float(d2)).inverseCumulativeProbability(p))


def mahalanobis(gap: np.ndarray, inverse: np.ndarray) -> float:
    return float(np.sqrt(max(0.0, gap @ inverse @ gap)))


def hotelling(spark: SparkSession, observed: np.ndarray, mean: np.ndarray, cov: np.ndarray, count: int, confidence: float = 0.5) -> FitResult:
    """The F statistic of Hotelling's test that the model's mean is the observed one, against its 1 - confidence quantile."""
    q = len(observed)
    if not np.any(cov):
        return FitResult(False, float("nan"), None)
    d2 = mahalanobis(mean - observed, np.linalg.pinv(cov)) ** 2
    statistic = (count - q) / (q * (count - 1)) * count * d2
    threshold = f_quantile(spark, 1 - confidence, q, count - q)
    return FitResult(statistic <= threshold, statistic, threshold)


def zero_gradient(gradients: list[np.ndarray], window: int = 10, threshold: float = 1e-3) -> FitResult:
    """The norm of the mean of the last gradients."""
    norm = float(np.linalg.norm(np.mean(gradients[-window:], axis=0)))
    return FitResult(norm <= threshold, norm, threshold)


def resample(features: DataFrame, count: int, reps: int, size: int, seed: int) -> DataFrame:
    """rep, k, f_idx, value: size draws with replacement for each rep. features: t, f_idx, value."""
    picks = features.sparkSession.range(reps * size).select(F.floor(F.col("id") / size).alias("rep"), (F.col("id") % size).alias("k")).withColumn("t", F.floor(draw(seed, F.col("rep"), F.col("k")) * count / 4294967296).cast("long"))
    return picks.join(features.select("t", "f_idx", "value"), "t").select("rep", "k", "f_idx", "value")


def _quantile_test(distances: list[float], quantile: float, threshold: float) -> FitResult:
    if any(not np.isfinite(d) for d in distances):
        return FitResult(False, float("nan"), threshold)
    value = float(np.quantile(distances, quantile))
    return FitResult(value < threshold, value, threshold)


def _rep_means(sample: DataFrame, q: int, reps: int) -> np.ndarray:
    out = np.zeros((reps, q))
    for r in sample.groupBy("rep", "f_idx").agg(F.avg("value").alias("m")).collect():
        out[r["rep"], r["f_idx"]] = r["m"]
    return out


def observed_bootstrap(observed: np.ndarray, boot: DataFrame, features: DataFrame, count: int, reps: int = 100, size: int = 1000, quantile: float = 0.95, threshold: float = 1.0, seed: int = 0) -> FitResult:
    """Distances of resampled model means from the observed statistics, under the observed graph's bootstrap covariance.

    boot: rep, f_idx, value from Collection.bootstrap().
    """
    q = len(observed)
    a, b = boot.alias("a"), boot.alias("b")
    cov = matrix(a.join(b, "rep").groupBy(F.col("a.f_idx").alias("f"), F.col("b.f_idx").alias("g")).agg(F.covar_pop("a.value", "b.value").alias("cov")), "cov", q)
    if not np.any(cov):
        raise ValueError("the bootstrap of the observed graph does not vary")
    inverse = np.linalg.pinv(cov)
    return _quantile_test([mahalanobis(m - observed, inverse) for m in _rep_means(resample(features, count, reps, size, seed), q, reps)], quantile, threshold)


def model_bootstrap(observed: np.ndarray, features: DataFrame, count: int, reps: int = 100, size: int = 1000, quantile: float = 0.95, threshold: float = 1.0, seed: int = 0) -> FitResult:
    """As observed_bootstrap(), with the covariance of each resample; one that does not vary is infinitely far."""
    q = len(observed)
    sample = resample(features, count, reps, size, seed)
    means = _rep_means(sample, q, reps)
    a, b = sample.alias("a"), sample.alias("b")
    covs = np.zeros((reps, q, q))
    for r in a.join(b, ["rep", "k"]).groupBy("rep", F.col("a.f_idx").alias("f"), F.col("b.f_idx").alias("g")).agg(F.covar_pop("a.value", "b.value").alias("c")).collect():
        covs[r["rep"], r["f"], r["g"]] = r["c"]
    distances = [mahalanobis(m - observed, np.linalg.pinv(c)) if np.any(c) else float("inf") for m, c in zip(means, covs, strict=True)]
    return _quantile_test(distances, quantile, threshold)
