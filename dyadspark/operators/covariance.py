"""Covariances of chain features. chain: t (0, 1, ...), f_idx, value; every feature at every t."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.spec import Covariance


def _centred(chain: DataFrame) -> DataFrame:
    means = chain.groupBy("f_idx").agg(F.avg("value").alias("m"))
    return chain.join(F.broadcast(means), "f_idx").select("t", F.col("f_idx").alias("f"), (F.col("value") - F.col("m")).alias("d"))


def matrix(rows: DataFrame, value: str, q: int) -> np.ndarray:
    """f, g, value as a matrix; it has one row for each two features."""
    out = np.zeros((q, q))
    for r in rows.collect():
        out[r["f"], r["g"]] = r[value]
    return out


def naive(chain: DataFrame) -> DataFrame:
    """f, g, cov: population covariance."""
    a, b = chain.alias("a"), chain.alias("b")
    return a.join(b, "t").groupBy(F.col("a.f_idx").alias("f"), F.col("b.f_idx").alias("g")).agg(F.covar_pop("a.value", "b.value").alias("cov"))


def batches_for(count: int, batches: int) -> int:
    """The first number of batches from the given one on that divides the sample."""
    while count % batches:
        batches += 1
    return batches


def batch(chain: DataFrame, count: int, batches: int) -> DataFrame:
    """f, g, cov: batch size times the mean product of the batch means' deviations."""
    size = count // batches_for(count, batches)
    d = _centred(chain).groupBy(F.floor(F.col("t") / size).alias("batch"), "f").agg(F.avg("d").alias("d"))
    a, b = d.alias("a"), d.alias("b")
    return a.join(b, "batch").groupBy("a.f", F.col("b.f").alias("g")).agg((size * F.avg(F.col("a.d") * F.col("b.d"))).alias("cov"))


def autocovariance(chain: DataFrame, lag: int) -> DataFrame:
    """f, g, cov: mean over the whole sample of d(t) d(t + lag)'."""
    d = _centred(chain)
    total = chain.select("t").distinct().agg(F.count("*").alias("k"))
    a, b = d.alias("a"), d.alias("b")
    rows = a.join(b, F.col("b.t") == F.col("a.t") + lag).groupBy("a.f", F.col("b.f").alias("g")).agg(F.sum(F.col("a.d") * F.col("b.d")).alias("s"))
    return rows.join(F.broadcast(total)).select("f", "g", (F.col("s") / F.col("k")).alias("cov"))


def autocovariances(chain: DataFrame, count: int, q: int) -> np.ndarray:
    """All lags in one job: lag x q x q."""
    d = _centred(chain)
    a, b = d.alias("a"), d.alias("b")
    rows = a.join(b, F.col("b.t") >= F.col("a.t")).groupBy((F.col("b.t") - F.col("a.t")).alias("lag"), "a.f", F.col("b.f").alias("g")).agg((F.sum(F.col("a.d") * F.col("b.d")) / count).alias("c")).collect()
    out = np.zeros((count, q, q))
    for r in rows:
        out[r["lag"], r["f"], r["g"]] = r["c"]
    return out


def initial_sequence(gammas: np.ndarray) -> np.ndarray:
    """Multivariate initial sequence: -gamma0 + 2 sum of symmetrised pairs, while the determinant grows.

    It begins at the first partial sum that is positive definite, and never asks for lags that the
    sample does not have. ValueError if no partial sum is.
    """
    pairs = len(gammas) // 2
    total, best, last = -gammas[0], None, -np.inf
    for k in range(pairs):
        both = gammas[2 * k] + gammas[2 * k + 1]
        total = total + (both + both.T)
        if best is None:
            if np.linalg.eigvalsh(total).min() > 0:
                best, last = total, np.linalg.det(total)
        else:
            now = np.linalg.det(total)
            if now <= last:
                break
            best, last = total, now
    if best is None:
        raise ValueError("no partial sum is positive definite; take a longer sample")
    return best


def covariance(chain: DataFrame, count: int, q: int, method: str = Covariance.NAIVE, batches: int = 25) -> np.ndarray:
    if method == Covariance.NAIVE:
        return matrix(naive(chain), "cov", q)
    if method == Covariance.BATCH:
        return matrix(batch(chain, count, batches), "cov", q)
    if method == Covariance.INITIAL_SEQUENCE:
        if count % 2:
            raise ValueError("an even sample is needed")
        return initial_sequence(autocovariances(chain, count, q))
    raise ValueError(f"unknown covariance method {method}")
