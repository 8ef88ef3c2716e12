"""Several metrics as one model: their features, statistics, change scores and designs."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions.dyads import grid, labelled, with_graphs
from dyadspark.functions.rng import bernoulli, draw
from dyadspark.operators.metrics import Metric, Reciprocity
from dyadspark.spec import Graph, Scheme


@dataclass(frozen=True)
class Kinds:
    """Dyads by the kinds of their source and target. nodes: node, a, b; rows: a, b, x; counts: a, b, targets (nodes of b)."""

    nodes: DataFrame
    rows: DataFrame
    counts: DataFrame


@dataclass
class Collection:
    """Metrics in order. Features are numbered through all metrics, ignored ones left out."""

    metrics: list[Metric]
    graph: Graph
    _features: list[tuple[int, int, str]] | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        seen = Counter((type(m), getattr(m, "directed", None), m.prefix) for m in self.metrics)
        if any(n > 1 and key[2] is not None for key, n in seen.items()):
            raise ValueError("two metrics of one class need different names")
        for m in self.metrics:
            if m.directed is not None and m.directed != self.graph.directed:
                raise ValueError(f"{m.title} is for {'directed' if m.directed else 'undirected'} graphs")
            if self.graph.mask is not None and not (m.supports_mask and m.dyad_independent):
                raise ValueError(f"{m.title} does not work with a mask")

    # features

    def names(self) -> list[str]:
        """Names of the features that count. Metrics alike without names of their own are numbered."""
        return [name for _, _, name in self.features()]

    def _labels(self) -> list[list[str]]:
        twins = Counter((type(m), m.prefix) for m in self.metrics)
        at: Counter = Counter()
        out = []
        for m in self.metrics:
            labels = m.labels(self.graph)
            if twins[type(m), m.prefix] > 1:
                at[type(m)] += 1
                labels = [f"{x}__{at[type(m)]}" for x in labels]
            out.append(labels)
        return out

    def features(self) -> list[tuple[int, int, str]]:
        """(metric, local index, name) by feature index."""
        if self._features is None:
            self._features = [(k, j, name) for k, (m, labels) in enumerate(zip(self.metrics, self._labels(), strict=True)) for j, name in enumerate(labels) if j not in m.ignored]
        return self._features

    def ignored(self) -> list[str]:
        return [name for m, labels in zip(self.metrics, self._labels(), strict=True) for j, name in enumerate(labels) if j in m.ignored]

    def feature_of(self, index: int) -> tuple[Metric, int]:
        k, j, _ = self.features()[index]
        return self.metrics[k], j

    def remove(self, index: int) -> None:
        """Ignore a feature; a metric without any is dropped."""
        metric, j = self.feature_of(index)
        metric.ignored.add(j)
        self._features = None
        if len(metric.ignored) >= metric.width(self.graph):
            self.metrics = [m for m in self.metrics if m is not metric]

    def feature_table(self) -> DataFrame:
        """f_idx, name, metric, local_idx."""
        return self.graph.nodes.sparkSession.createDataFrame([(f, name, k, j) for f, (k, j, name) in enumerate(self.features())], "f_idx int, name string, metric int, local_idx int")

    def _numbered(self, parts: list[DataFrame]) -> DataFrame:
        """Long rows of each metric with f_idx in place of local_idx; rows of ignored features go."""
        whole = None
        table = self.feature_table()
        for k, part in enumerate(parts):
            mine = table.where(F.col("metric") == k).select("local_idx", "f_idx")
            rows = part.join(F.broadcast(mine), "local_idx").drop("local_idx")
            whole = rows if whole is None else whole.unionByName(rows)
        return whole

    # statistics

    def sample_statistics(self, graph: Graph | None = None) -> DataFrame:
        """graph_id, f_idx, name, value for every graph and feature."""
        graph = graph or self.graph
        if graph.n != self.graph.n:
            raise ValueError(f"the model has {self.graph.n} nodes, the graphs have {graph.n}")
        found = self._numbered([m.values(graph) for m in self.metrics])
        ids = graph.nodes.sparkSession.range(graph.graphs).select(F.col("id").alias("graph_id"))
        every = ids.join(F.broadcast(self.feature_table().select("f_idx", "name")))
        return every.join(found, ["graph_id", "f_idx"], "left").select("graph_id", "f_idx", "name", F.coalesce("value", F.lit(0.0)).alias("value"))

    def statistics(self, graph: Graph | None = None) -> list[float]:
        rows = self.sample_statistics(graph).where("graph_id = 0").orderBy("f_idx").collect()
        return [r["value"] for r in rows]

    # dyads

    def design(self, cells: DataFrame | None = None, graph: Graph | None = None) -> DataFrame:
        """Sparse design: src, dst, f_idx, v."""
        graph = graph or self.graph
        return self._numbered([m.full_design(graph) if cells is None else m.design(graph, cells) for m in self.metrics])

    def change_scores(self, cells: DataFrame | None = None, graph: Graph | None = None) -> DataFrame:
        """What flipping each dyad of the first graph does: src, dst, f_idx, change; zeros are left out."""
        graph = graph or self.graph
        on = Metric.observed(graph).withColumn("y", F.lit(True))
        rows = self.design(cells, graph).join(on, ["src", "dst"], "left")
        return rows.select("src", "dst", "f_idx", F.when(F.col("y"), -F.col("v")).otherwise(F.col("v")).alias("change"))

    def design_rows(self, cells: DataFrame | None = None, graph: Graph | None = None) -> DataFrame:
        """src, dst, dyad_idx, x (sparse, by feature), y (share of graphs), w."""
        graph = graph or self.graph
        cells = labelled(graph, cells)
        x = self.design(cells.select("src", "dst"), graph).groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct(F.col("f_idx").alias("f"), "v"))).alias("x"))
        rows = cells.join(x, ["src", "dst"], "left")
        if graph.weights is not None:
            rows = rows.join(graph.weights, ["src", "dst"], "left")
        else:
            rows = rows.withColumn("w", F.lit(None).cast("double"))
        return rows.select("src", "dst", "dyad_idx", F.coalesce("x", F.array().cast("array<struct<f:int,v:double>>")).alias("x"), "y", F.coalesce("w", F.lit(1.0)).alias("w"))

    def kind_rows(self, ends: bool = False) -> DataFrame | Kinds | None:
        """design_rows() of directed graphs for compress(), a row for each kind of dyads instead of each dyad.

        x comes from one dyad of the kind, y is the mean of their labels, w their number. None if the metrics tell dyads
        apart by more than their ends, or if kinds are hardly fewer. With ends the parts: see Kinds.
        """
        graph, told = self.graph, [m.ends() for m in self.metrics]
        if not graph.directed or graph.mask is not None or graph.weights is not None or None in told:
            return None
        spark, n = graph.nodes.sparkSession, graph.n
        by = [sorted({c for t in told for c in t[k]}) for k in (0, 1)]
        if "node" in by[0] and "node" in by[1] or n < 2:
            return None
        nodes = spark.range(n).select(F.col("id").cast("int").alias("node"))
        if {*by[0], *by[1]} - {"node"}:
            nodes = nodes.join(graph.nodes.select("node", "type", "attr", "pos"), "node", "left")
        sides, sizes = [], []
        for k, (columns, name) in enumerate(zip(by, "ab", strict=True)):
            if "node" in columns:
                nodes, found, size = nodes.withColumn(name, F.col("node")), nodes.select(*[F.col("node").alias(f"{name}{s}") for s in ("", "_low", "_high")], F.lit(1).cast("long").alias(f"{name}_size")), n
            elif not columns:
                nodes, found, size = nodes.withColumn(name, F.lit(0)), spark.range(1).select(F.lit(0).alias(name), F.lit(0).alias(f"{name}_low"), F.lit(n - 1).alias(f"{name}_high"), F.lit(n).cast("long").alias(f"{name}_size")), 1
            else:
                whole = nodes.groupBy(*columns).agg(F.min("node").alias(f"{name}_low"), F.max("node").alias(f"{name}_high"), F.count("*").alias(f"{name}_size")).withColumn(name, F.col(f"{name}_low"))
                keys = whole.select(*[F.col(c).alias(f"k_{c}") for c in columns], name)
                nodes = nodes.join(keys, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in columns]).drop(*[f"k_{c}" for c in columns])
                found, size = whole.drop(*columns), whole.count()
            sides.append(found)
            sizes.append(size)
        if 2 * sizes[0] * sizes[1] > n * (n - 1):
            return None
        nodes = nodes.select("node", "a", "b")
        small = sizes.index(min(sizes))
        pairs = sides[1 - small].crossJoin(F.broadcast(sides[small]))
        # nodes that are of both kinds have no dyad with themselves
        loops = nodes.groupBy("a", "b").agg(F.count("*").alias("loops"))
        pairs = pairs.join(loops, ["a", "b"], "left").withColumn("w", F.col("a_size") * F.col("b_size") - F.coalesce("loops", F.lit(0))).where("w > 0")
        straight, other = F.col("a_low") != F.col("b_low"), F.col("a_low") != F.col("b_high")
        pairs = pairs.select("a", "b", "w", F.col("b_size").alias("targets"), F.when(straight | other, F.col("a_low")).otherwise(F.col("a_high")).alias("src"), F.when(straight, F.col("b_low")).when(other, F.col("b_high")).otherwise(F.col("b_low")).alias("dst"))
        x = self.design(pairs.select("src", "dst")).groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct(F.col("f_idx").alias("f"), "v"))).alias("x"))
        rows = pairs.join(x, ["src", "dst"], "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<f:int,v:double>>")))
        if ends:
            return Kinds(nodes, rows.select("a", "b", "x"), pairs.select("a", "b", "targets"))
        seen = graph.edges.join(nodes.select(F.col("node").alias("src"), "a"), "src").join(nodes.select(F.col("node").alias("dst"), "b"), "dst")
        on = seen.groupBy("a", "b").agg((F.count("*") / graph.graphs).alias("on"))
        return rows.join(on, ["a", "b"], "left").select("x", (F.coalesce("on", F.lit(0.0)) / F.col("w")).alias("y"), F.col("w").cast("double").alias("w"))

    def pair_design(self) -> DataFrame:
        """The four states of each pair i < j, as seen from the empty graph: src, dst, state, f_idx, v.

        State 1 adds what i to j does, state 2 what j to i does, state 3 both, and what they do together.
        """
        spark, graph = self.graph.nodes.sparkSession, self.graph
        empty = graph.but(edges=graph.edges.limit(0), mask=None)
        pairs = grid(spark, graph.n, directed=False).select("src", "dst")
        back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        both = graph.but(edges=back.select(F.lit(0).cast("long").alias("graph_id"), "src", "dst"), mask=None)
        up = self.design(pairs, empty).withColumn("states", F.array(F.lit(1), F.lit(3)))
        down = self._numbered([m.design(both.but(edges=empty.edges), back) for m in self.metrics]).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "f_idx", "v").withColumn("states", F.array(F.lit(2), F.lit(3)))
        parts = up.unionByName(down.select(*up.columns))
        mutual = [m for m in self.metrics if isinstance(m, Reciprocity)]
        if mutual:
            # with j to i on, i to j completes the pair
            joint = self._numbered([m.design(both, pairs) if isinstance(m, Reciprocity) else m.design(empty, pairs.limit(0)) for m in self.metrics])
            parts = parts.unionByName(joint.withColumn("states", F.array(F.lit(3))).select(*up.columns))
        return parts.select("src", "dst", F.explode("states").alias("state"), "f_idx", "v").groupBy("src", "dst", "state", "f_idx").agg(F.sum("v").alias("v"))

    # choices

    def scheme(self) -> Scheme:
        dependent = [m for m in self.metrics if not m.dyad_independent]
        if not dependent:
            return Scheme.MPLE
        return Scheme.MPLE_RECIPROCITY if all(isinstance(m, Reciprocity) for m in dependent) else Scheme.MCMLE

    def fix_collinearity(self, samples: int = 1000, seed: int = 0, ratio: float = 5e-6, nonzero: float = 0.1, involved: float = 1e-4) -> list[str]:
        """Remove features that are linear in others, judged on random graphs; the names that went.

        The uncentred Gram matrix of the statistics is summed in Spark; its eigenvectors near zero are
        the dependencies. The feature in most of them goes first, the lowest of equals, from metrics
        that have several; where none has, a whole metric goes.
        """
        gone: list[str] = []
        whole = self.gram(samples, seed)
        place = {(id(self.metrics[k]), j): f for f, (k, j, _) in enumerate(self.features())}
        while True:
            # the Gram matrix of fewer features is part of that of all
            kept = [place[id(self.metrics[k]), j] for k, j, _ in self.features()]
            q = len(kept)
            values, vectors = np.linalg.eigh(whole[np.ix_(kept, kept)])
            large = np.abs(values)[np.abs(values) > nonzero]
            if not len(large):
                return gone
            dependent = np.flatnonzero(values < ratio * large.min())
            if not len(dependent):
                return gone
            share = (np.abs(vectors[:, dependent]) > involved).mean(axis=1)
            widths = Counter(k for k, _, _ in self.features())
            wide = [f for f in range(q) if share[f] > 0 and widths[self.features()[f][0]] > 1]
            pick = min(wide or [f for f in range(q) if share[f] > 0], key=lambda f: (-share[f], f))
            gone.append(self.names()[pick])
            self.remove(pick)

    def gram(self, samples: int, seed: int) -> np.ndarray:
        """Sum over random graphs of the outer product of their statistics."""
        random = random_graphs(self.graph.nodes.sparkSession, self.graph.n, self.graph.directed, samples, 0.5, seed)
        stats = self.sample_statistics(self.graph.but(edges=random, count=samples)).select("graph_id", F.col("f_idx").alias("f"), "value").where("value <> 0")
        q = len(self.features())
        rows = stats.alias("a").join(stats.alias("b"), "graph_id").groupBy("a.f", F.col("b.f").alias("g")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("s")).collect()
        out = np.zeros((q, q))
        for r in rows:
            out[r["f"], r["g"]] = r["s"]
        return out

    # bootstrap

    def bootstrap(self, reps: int = 1000, seed: int = 0, halves: DataFrame | None = None) -> DataFrame:
        """rep, f_idx, value: statistics of random halves of the first graph, scaled to the whole."""
        for m in self.metrics:
            if not m.supports_bootstrap:
                raise NotImplementedError(f"{m.title} has no bootstrap")
        halves = halves if halves is not None else split_nodes(self.graph, reps, seed)
        found = self._numbered([m.bootstrap(halves, self.graph) for m in self.metrics])
        every = halves.select("rep").distinct().join(F.broadcast(self.feature_table().select("f_idx")))
        return every.join(found, ["rep", "f_idx"], "left").select("rep", "f_idx", F.coalesce("value", F.lit(0.0)).alias("value"))


def random_graphs(spark: SparkSession, n: int, directed: bool, count: int, p: float, seed: int) -> DataFrame:
    """Edges of graphs whose dyads are on with probability p, each for itself."""
    cells = with_graphs(grid(spark, n, directed).select("src", "dst"), count)
    return cells.where(bernoulli(p, seed, F.col("graph_id"), F.col("src"), F.col("dst"))).select("graph_id", "src", "dst")


def split_nodes(graph: Graph, reps: int, seed: int) -> DataFrame:
    """rep, node, half: random halves of the nodes, the first no smaller than the second."""
    from pyspark.sql import Window

    spark = graph.nodes.sparkSession
    cells = with_graphs(spark.range(graph.n).select(F.col("id").cast("int").alias("node")), reps).withColumnRenamed("graph_id", "rep")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(draw(seed, F.col("rep"), F.col("node")), "node"))
    return cells.select("rep", "node", F.when(place <= (graph.n + 1) // 2, 0).otherwise(1).alias("half"))
