"""Likelihood, entropy, diagnostics and densities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.functions.scalar import EPS, bernoulli_entropy, entropy, log_likelihood
from dyadspark.spec import Graph, Reduction

QUANTILES = (0.025, 0.25, 0.5, 0.75, 0.975)


def _reduced(rows: DataFrame, name: str, how: str) -> DataFrame:
    """rows as they are for none; else one row of the sum or mean of the column."""
    if how == Reduction.NONE:
        return rows
    return rows.agg((F.sum(name) if how == Reduction.SUM else F.avg(name)).alias(name))


def dyad_log_likelihood(predicted: DataFrame, how: str = Reduction.SUM, base: float = math.e, weighted: bool = False) -> DataFrame:
    """log_likelihood over dyads with y and p."""
    value = log_likelihood(F.col("y"), F.col("p"), base)
    return _reduced(predicted.withColumn("log_likelihood", value * F.col("w") if weighted else value), "log_likelihood", how)


def pair_log_likelihood(predicted: DataFrame, how: str = Reduction.SUM, base: float = math.e) -> DataFrame:
    """log_likelihood over pairs with y0 .. y3 and p0 .. p3."""
    value = F.lit(0.0)
    for s in range(4):
        value = value + F.col(f"y{s}") * F.log(F.greatest(F.col(f"p{s}"), F.lit(EPS)))
    return _reduced(predicted.withColumn("log_likelihood", value / F.lit(math.log(base))), "log_likelihood", how)


def dyad_entropy(predicted: DataFrame, how: str = Reduction.SUM, eps: float = EPS) -> DataFrame:
    """entropy in bits over dyads with p; dyads without p don't count."""
    return _reduced(predicted.where("p IS NOT NULL").withColumn("entropy", bernoulli_entropy(F.col("p"), eps)), "entropy", how)


def pair_entropy(predicted: DataFrame, how: str = Reduction.SUM, eps: float = EPS) -> DataFrame:
    """entropy in bits over pairs with p0 .. p3."""
    return _reduced(predicted.withColumn("entropy", entropy([F.col(f"p{s}") for s in range(4)], eps)), "entropy", how)


def diagnostics(chain: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """By feature: mean and population deviation, quantiles and trace of its values over a chain.

    chain: t, f_idx, value. With observed (f_idx, value), quantiles and trace are differences from it;
    mean and deviation are not.
    """
    stats = chain.groupBy("f_idx").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", F.array(*[F.lit(q) for q in QUANTILES])).alias("quantiles"), F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda e: e["value"]).alias("trace"))
    if observed is None:
        return stats
    shift = stats.join(observed.select("f_idx", F.col("value").alias("at")), "f_idx")
    return shift.select("f_idx", "mean", "std", F.transform("quantiles", lambda q: q - F.col("at")).alias("quantiles"), F.transform("trace", lambda v: v - F.col("at")).alias("trace"))


def type_pair_density(graph: Graph) -> DataFrame:
    """t1, t2, edges, possible, density for ordered pairs of types; 0 where no edge is possible."""
    kinds = graph.nodes.groupBy("type").agg(F.count("*").alias("size"))
    a, b = kinds.alias("a"), kinds.alias("b")
    possible = a.join(F.broadcast(b)).select(F.col("a.type").alias("t1"), F.col("b.type").alias("t2"), F.when(F.col("a.type") == F.col("b.type"), F.col("a.size") * (F.col("a.size") - 1)).otherwise(F.col("a.size") * F.col("b.size")).alias("possible"))
    ends = graph.nodes.select("node", "type")
    found = graph.edges.where("graph_id = 0").join(ends.select(F.col("node").alias("src"), F.col("type").alias("t1")), "src").join(ends.select(F.col("node").alias("dst"), F.col("type").alias("t2")), "dst").groupBy("t1", "t2").agg(F.count("*").alias("edges"))
    joined = possible.join(found, ["t1", "t2"], "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))
    return joined.select("t1", "t2", "edges", "possible", F.coalesce(F.try_divide(F.col("edges"), F.col("possible")), F.lit(0.0)).alias("density"))


def concordance(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Lin's concordance correlation coefficient of two columns."""
    gap = F.avg(x) - F.avg(y)
    return rows.agg((2 * F.covar_pop(x, y) / (F.var_pop(x) + F.var_pop(y) + gap * gap)).alias("ccc"))
