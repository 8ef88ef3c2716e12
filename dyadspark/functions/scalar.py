"""Scalar expressions of the models."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), without overflow at either end."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clip(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def log_likelihood(y: Column, p: Column, base: float = math.e, eps: float = EPS) -> Column:
    q = clip(p, eps)
    return (y * F.log(q) + (1 - y) * F.log(1 - q)) / F.lit(math.log(base))


def log_likelihood_from_score(y: Column, x: Column) -> Column:
    """The same from the linear score, not clipped: -log(1 + exp(-x)) + (y - 1) x."""
    return -(F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))) + (y - 1) * x


def bernoulli_entropy(p: Column, eps: float = EPS) -> Column:
    """In bits."""
    q = clip(p, eps)
    return -q * F.log2(q) - (1 - q) * F.log2(1 - q)


def entropy(ps: list[Column], eps: float = EPS) -> Column:
    """Of a distribution over several states, in bits."""
    total = F.lit(0.0)
    for p in ps:
        q = F.greatest(p, F.lit(eps))
        total = total - p * F.log2(q)
    return total


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    return [p / whole for p in parts]


def reduce(column: Column, how: str) -> Column:
    return {"sum": F.sum, "mean": F.avg}[how](column)


def convex_minorant(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the greatest convex function below the points, by x."""
    hull: list[tuple[float, float]] = []
    for x, y in sorted(points):
        while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (x - hull[-2][0]) >= (y - hull[-2][1]) * (hull[-1][0] - hull[-2][0]):
            hull.pop()
        if hull and hull[-1][0] == x:
            continue
        hull.append((x, y))
    return hull


def minorant_at(points: list[tuple[float, float]]) -> list[float]:
    """Its values at the points' own x, in order."""
    hull, out, k = convex_minorant(points), [], 0
    for x, _ in sorted(points):
        while k + 1 < len(hull) and hull[k + 1][0] < x:
            k += 1
        if k + 1 < len(hull):
            (a, fa), (b, fb) = hull[k], hull[k + 1]
            out.append(fa + (fb - fa) * (x - a) / (b - a))
        else:
            out.append(hull[k][1])
    return out
