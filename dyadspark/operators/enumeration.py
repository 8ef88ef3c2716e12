"""Exact results by going through all graphs of a few nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions.dyads import graphs_from_codes
from dyadspark.operators.collection import Collection

LIMIT = {True: 5, False: 7}


def all_graphs(spark: SparkSession, n: int, directed: bool = True) -> DataFrame:
    """graph_id, src, dst of all graphs, the code of a graph as its id."""
    if n > LIMIT[directed]:
        raise ValueError(f"at most {LIMIT[directed]} nodes")
    total = n * (n - 1) // (1 if directed else 2)
    return graphs_from_codes(spark, spark.range(1 << total).select(F.col("id").alias("graph_id"), F.col("id").alias("code")), n, directed)


def weights(model: Collection, theta: list[float]) -> DataFrame:
    """graph_id and score theta' g of all graphs on the model's nodes."""
    spark, n, directed = model.graph.nodes.sparkSession, model.graph.n, model.graph.directed
    total = n * (n - 1) // (1 if directed else 2)
    stats = model.sample_statistics(model.graph.but(edges=all_graphs(spark, n, directed)))
    table = F.array(*[F.lit(float(t)) for t in theta])
    scored = stats.groupBy("graph_id").agg(F.sum(F.col("value") * F.element_at(table, F.col("f_idx") + 1)).alias("score"))
    every = spark.range(1 << total).select(F.col("id").alias("graph_id"))
    return every.join(scored, "graph_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def log_partition(model: Collection, theta: list[float]) -> DataFrame:
    """log_z."""
    return weights(model, theta).agg(F.log(F.sum(F.exp("score"))).alias("log_z"))


def expected(model: Collection, theta: list[float]) -> DataFrame:
    """f_idx, name, value: expectations of the statistics."""
    graph = model.graph.but(edges=all_graphs(model.graph.nodes.sparkSession, model.graph.n, model.graph.directed))
    w = weights(model, theta)
    z = w.agg(F.sum(F.exp("score")).alias("z"))
    return model.sample_statistics(graph).join(w, "graph_id").groupBy("f_idx", "name").agg(F.sum(F.col("value") * F.exp("score")).alias("s")).join(F.broadcast(z)).select("f_idx", "name", (F.col("s") / F.col("z")).alias("value"))


def exact_sample(model: Collection, theta: list[float], count: int, seed: int) -> DataFrame:
    """sample_id, graph_id: graphs drawn by their probability."""
    import numpy as np

    rows = weights(model, theta).orderBy("graph_id").collect()  # at most 2**20, by LIMIT
    p = np.exp([r["score"] for r in rows])
    picks = np.random.default_rng(seed).choice(len(rows), size=count, p=p / p.sum())
    return model.graph.nodes.sparkSession.createDataFrame([(k, int(g)) for k, g in enumerate(picks)], "sample_id long, graph_id long")
