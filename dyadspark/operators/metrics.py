"""Statistics of graphs, and what each dyad adds to them.

A metric has local features 0, 1, ...; its values and its design rows are long tables. A design row
(src, dst, local_idx, v) says by how much the feature grows when that dyad is switched on, the
dyad itself taken as off; rows of zero are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadspark.functions.dyads import dyad_index, dyads
from dyadspark.operators.paths import common_neighbours, triangles
from dyadspark.spec import Graph


class Metric:
    """Base of all metrics, built in or the user's: give values() and, for change scores, design()."""

    title = "metric"
    directed: bool | None = None
    dyad_independent = True
    supports_mask = True
    supports_bootstrap = False
    #: The columns of nodes, of the source and of the target, that alone decide a dyad's design row; None if others do.
    told_by: tuple[tuple[str, ...], tuple[str, ...]] | None = None

    @classmethod
    def ends(cls) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
        """told_by, unless a subclass has since changed what decides."""
        for c in cls.__mro__:
            if "told_by" in vars(c):
                return c.told_by
            if {"design", "full_design", "weight", "placed", "_ends", "sides"} & vars(c).keys():
                return None
        return None

    def __init__(self, name: str | None = None, ignore: tuple[int, ...] = ()):
        self.prefix, self.ignored = name, set(ignore)

    def labels(self, graph: Graph) -> list[str]:
        """A name for each local feature, ignored ones included."""
        head = f"{self.prefix}_" if self.prefix else ""
        width = self.width(graph)
        return [f"{head}{self.title}"] if width == 1 and not self.is_vector else [f"{head}{self.title}_{k + 1}" for k in range(width)]

    is_vector = False

    def width(self, graph: Graph) -> int:
        return 1

    def values(self, graph: Graph) -> DataFrame:
        """graph_id, local_idx, value; zeros may be left out."""
        raise NotImplementedError

    def design(self, graph: Graph, cells: DataFrame) -> DataFrame:
        """src, dst, local_idx, v over the dyads in cells, in the first graph.

        Unless a metric knows better: its values with each dyad on, less those with it off. That
        takes two graphs for each dyad, so metrics for large graphs should say how they change.
        """
        kept = graph.edges.where("graph_id = 0").select(F.col("src").alias("s"), F.col("dst").alias("d"))
        cells = cells.select("src", "dst", dyad_index(F.col("src"), F.col("dst"), graph.n, graph.directed).alias("k"))
        others = cells.join(F.broadcast(kept), (F.col("s") != F.col("src")) | (F.col("d") != F.col("dst"))).select(F.explode(F.array(2 * F.col("k"), 2 * F.col("k") + 1)).alias("graph_id"), F.col("s").alias("src"), F.col("d").alias("dst"))
        toggled = others.unionByName(cells.select((2 * F.col("k") + 1).alias("graph_id"), "src", "dst"))
        found = self.values(graph.but(edges=toggled)).select(F.shiftright("graph_id", 1).alias("k"), "local_idx", F.when(F.col("graph_id") % 2 == 1, F.col("value")).otherwise(-F.col("value")).alias("v"))
        change = found.groupBy("k", "local_idx").agg(F.sum("v").alias("v")).where("v <> 0")
        return cells.join(change, "k").select("src", "dst", "local_idx", "v")

    def full_design(self, graph: Graph) -> DataFrame:
        """design() over all dyads of the graph. Metrics that few dyads change give these without the grid."""
        return self.design(graph, dyads(graph))

    def chain_change(self, y: np.ndarray, i: int, j: int) -> dict[int, float]:
        """v by local_idx, as in design(), of the dyad (i, j) in the graph with matrix y.

        Chains call it for metrics whose dyads depend on each other, in the workers: it may read
        plain attributes of the metric, and no DataFrame.
        """
        raise NotImplementedError(f"no chain for {self.title}: it does not say chain_change()")

    def bootstrap(self, halves: DataFrame, graph: Graph) -> DataFrame:
        """rep, local_idx, value scaled to the whole graph. halves: rep, node, half."""
        raise NotImplementedError(f"{self.title} has no bootstrap")

    @staticmethod
    def observed(graph: Graph) -> DataFrame:
        """The edges of the first graph."""
        return graph.edges.where("graph_id = 0").select("src", "dst")


def _one(rows: DataFrame, value: Column) -> DataFrame:
    return rows.groupBy("graph_id").agg(value.cast("double").alias("value")).select("graph_id", F.lit(0).alias("local_idx"), "value")


def _half_edges(graph: Graph, halves: DataFrame, which: Column | None = None) -> DataFrame:
    """rep, src, dst, half of edges whose ends lie in one half."""
    a, b = halves.alias("a"), halves.alias("b")
    joined = Metric.observed(graph).join(a, F.col("src") == F.col("a.node")).join(b, (F.col("dst") == F.col("b.node")) & (F.col("a.rep") == F.col("b.rep")) & (F.col("a.half") == F.col("b.half")))
    rows = joined.select("a.rep", "src", "dst", "a.half")
    return rows if which is None else rows.where(which)


class Edges(Metric):
    """How many edges there are."""

    supports_bootstrap = True
    told_by = ((), ())

    def __init__(self, directed: bool = True, **options):
        super().__init__(**options)
        self.directed = directed
        self.title = "num_edges_directed" if directed else "num_edges_undirected"

    def values(self, graph):
        return _one(graph.masked_edges(), F.count("*"))

    def design(self, graph, cells):
        return cells.select("src", "dst", F.lit(0).alias("local_idx"), F.lit(1.0).alias("v"))

    def bootstrap(self, halves, graph):
        n, first = graph.n, (graph.n + 1) // 2
        scale = (n * (n - 1)) / (first * (first - 1))
        counts = _half_edges(graph, halves, F.col("half") == 0).groupBy("rep").agg((F.count("*") * scale).alias("value"))
        return counts.select("rep", F.lit(0).alias("local_idx"), "value")


class _NodeVector(Metric):
    is_vector = True
    supports_bootstrap = True
    sides: tuple[str, ...] = ()

    def width(self, graph):
        return graph.n

    def _ends(self, rows: DataFrame) -> DataFrame:
        keep = [c for c in rows.columns if c not in {"src", "dst"}]
        return rows.select(*keep, "src", "dst", F.explode(F.array(*self.sides)).alias("local_idx"))

    def values(self, graph):
        return self._ends(graph.masked_edges()).groupBy("graph_id", "local_idx").agg(F.count("*").cast("double").alias("value"))

    def design(self, graph, cells):
        return self._ends(cells.select("src", "dst")).select("src", "dst", "local_idx", F.lit(1.0).alias("v"))

    def bootstrap(self, halves, graph):
        n = graph.n
        size = F.when(F.col("half") == 0, (n + 1) // 2).otherwise(n // 2)
        counted = self._ends(_half_edges(graph, halves)).groupBy("rep", "half", "local_idx").agg(F.count("*").alias("c"))
        return counted.select("rep", "local_idx", (F.col("c") * (n - 1) / (size - 1)).alias("value"))


class InDegree(_NodeVector):
    title, sides, directed = "indegree", ("dst",), True
    told_by = ((), ("node",))


class OutDegree(_NodeVector):
    title, sides, directed = "outdegree", ("src",), True
    told_by = (("node",), ())


class UndirectedDegree(_NodeVector):
    title, sides, directed = "undirected_degree", ("src", "dst"), False
    told_by = (("node",), ("node",))


class Triangles(Metric):
    """Triangles of undirected graphs; with directed=True cyclic triads."""

    dyad_independent = False
    supports_mask = False

    def __init__(self, directed: bool = False, **options):
        super().__init__(**options)
        self.directed = directed
        self.title = "num_triangles_directed" if directed else "num_triangles"

    def values(self, graph):
        """Each triangle is met once: the smallest node opens a cycle, the largest closes the others' edge otherwise."""
        if not self.directed:
            return _one(triangles(graph.edges), F.sum("v"))
        e = graph.edges.select("graph_id", "src", "dst")
        a, b, c = e.alias("a"), e.alias("b"), e.alias("c")
        paths = a.join(b, (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.dst") == F.col("b.src")))
        paths = paths.where("a.src < a.dst AND a.src < b.dst")
        close = (F.col("c.src") == F.col("b.dst")) & (F.col("c.dst") == F.col("a.src"))
        return _one(paths.join(c, close & (F.col("c.graph_id") == F.col("a.graph_id"))).select("a.graph_id"), F.count("*"))

    def full_design(self, graph):
        if self.directed or graph.mask is not None:
            return super().full_design(graph)
        return common_neighbours(graph.edges.where("graph_id = 0")).select("src", "dst", F.lit(0).alias("local_idx"), "v")

    def design(self, graph, cells):
        if not self.directed:
            return self.full_design(graph).join(cells.select("src", "dst"), ["src", "dst"]).select("src", "dst", "local_idx", "v")
        e = self.observed(graph)
        # i -> j closes the paths j -> k -> i; in neither graph does i -> j itself lie on one
        paths = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).where("a.src <> b.dst")
        counted = paths.groupBy(F.col("b.dst").alias("src"), F.col("a.src").alias("dst")).agg(F.count("*").cast("double").alias("v"))
        return cells.select("src", "dst").join(counted, ["src", "dst"]).select("src", "dst", F.lit(0).alias("local_idx"), "v")


class Reciprocity(Metric):
    """For each pair i < j whether both edges exist."""

    title, directed, is_vector = "reciprocity", True, True
    dyad_independent = False
    supports_mask = False

    def width(self, graph):
        return graph.n * (graph.n - 1) // 2

    def _pairs(self, edges: DataFrame) -> DataFrame:
        back = edges.select(*[c for c in edges.columns if c not in {"src", "dst"}], F.col("dst").alias("src"), F.col("src").alias("dst"))
        return edges.join(back, edges.columns, "left_semi")

    def values(self, graph):
        pairs = self._pairs(graph.edges.select("graph_id", "src", "dst")).where("src < dst")
        return pairs.select("graph_id", dyad_index(F.col("src"), F.col("dst"), graph.n, False).cast("int").alias("local_idx"), F.lit(1.0).alias("value"))

    def _answered(self, graph: Graph, cells: DataFrame) -> DataFrame:
        back = self.observed(graph).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return cells.select("src", "dst").join(back, ["src", "dst"], "left_semi")

    def design(self, graph, cells):
        return self._answered(graph, cells).select("src", "dst", dyad_index(F.least("src", "dst"), F.greatest("src", "dst"), graph.n, False).cast("int").alias("local_idx"), F.lit(1.0).alias("v"))


class TotalReciprocity(Reciprocity):
    """How many pairs are joined both ways."""

    title, is_vector, supports_bootstrap = "total_reciprocity", False, True

    def width(self, graph):
        return 1

    def values(self, graph):
        return _one(self._pairs(graph.edges.select("graph_id", "src", "dst")).where("src < dst"), F.count("*"))

    def design(self, graph, cells):
        return self._answered(graph, cells).select("src", "dst", F.lit(0).alias("local_idx"), F.lit(1.0).alias("v"))

    def bootstrap(self, halves, graph):
        n, first = graph.n, (graph.n + 1) // 2
        scale = (n * (n - 1) / 2) / (first * (first - 1) / 2)
        inside = _half_edges(graph, halves, F.col("half") == 0).select("rep", "src", "dst")
        counts = self._pairs(inside).where("src < dst").groupBy("rep").agg((F.count("*") * scale).alias("value"))
        return counts.select("rep", F.lit(0).alias("local_idx"), "value")


class TypePairs(Metric):
    """Edges for each pair of node types: ordered pairs, or unordered ones in undirected graphs."""

    is_vector = True
    told_by = (("type",), ("type",))

    def __init__(self, directed: bool = True, **options):
        super().__init__(**options)
        self.directed = directed
        self.title = f"num_edges_between_types_{'directed' if directed else 'undirected'}"

    def types(self, graph: Graph) -> list[str]:
        """One entry per type, which pairs of types need at the driver anyhow."""
        return sorted(r[0] for r in graph.nodes.select("type").distinct().collect())

    def pairs(self, graph: Graph) -> list[tuple[str, str]]:
        ts = self.types(graph)
        return [(a, b) for a in ts for b in ts if self.directed or a <= b]

    def width(self, graph):
        t = len(self.types(graph))
        return t * t if self.directed else t * (t + 1) // 2

    def labels(self, graph):
        head = f"{self.prefix}_" if self.prefix else ""
        return [f"{head}{self.title}_{a}__{b}" for a, b in self.pairs(graph)]

    def placed(self, graph: Graph, rows: DataFrame) -> DataFrame:
        """rows of dyads with their pair's place."""
        pairs = rows.sparkSession.createDataFrame([(a, b, k) for k, (a, b) in enumerate(self.pairs(graph))], "t1 string, t2 string, local_idx int")
        kinds = graph.nodes.select("node", "type")
        joined = rows.join(kinds.select(F.col("node").alias("src"), F.col("type").alias("ts")), "src").join(kinds.select(F.col("node").alias("dst"), F.col("type").alias("td")), "dst")
        first, second = (F.col("ts"), F.col("td")) if self.directed else (F.least("ts", "td"), F.greatest("ts", "td"))
        return joined.withColumns({"t1": first, "t2": second}).join(F.broadcast(pairs), ["t1", "t2"])

    def values(self, graph):
        return self.placed(graph, graph.masked_edges()).groupBy("graph_id", "local_idx").agg(F.count("*").cast("double").alias("value"))

    def design(self, graph, cells):
        return self.placed(graph, cells.select("src", "dst")).select("src", "dst", "local_idx", F.lit(1.0).alias("v"))


class Weighted(Metric):
    """Sum over edges of a weight of the dyad. weight() is an expression over columns a_* and b_* of its ends."""

    def weight(self) -> Column:
        raise NotImplementedError

    def placed(self, graph: Graph, rows: DataFrame) -> DataFrame:
        ends = graph.nodes.select("node", "attr", "pos")
        a = ends.select(F.col("node").alias("src"), F.col("attr").alias("a_attr"), F.col("pos").alias("a_pos"))
        b = ends.select(F.col("node").alias("dst"), F.col("attr").alias("b_attr"), F.col("pos").alias("b_pos"))
        return rows.join(a, "src").join(b, "dst").withColumn("v", self.weight())

    def values(self, graph):
        return _one(self.placed(graph, graph.masked_edges()), F.sum("v"))

    def design(self, graph, cells):
        return self.placed(graph, cells.select("src", "dst")).select("src", "dst", F.lit(0).alias("local_idx"), "v")


class SumDistances(Weighted):
    title = "sum_distances_connected_neurons"
    told_by = (("pos",), ("pos",))

    def __init__(self, directed: bool = True, **options):
        super().__init__(**options)
        self.directed = directed

    def weight(self):
        squares = F.zip_with("a_pos", "b_pos", lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


class AttributeSum(Weighted):
    title = "node_attribute_sum"
    told_by = (("attr",), ("attr",))

    def __init__(self, directed: bool = True, **options):
        super().__init__(**options)
        self.directed = directed

    def weight(self):
        return F.col("a_attr") + F.col("b_attr")


class AttributeSumOut(Weighted):
    title, directed = "node_attribute_sum_out", True
    told_by = (("attr",), ())

    def weight(self):
        return F.col("a_attr")


class AttributeSumIn(Weighted):
    title, directed = "node_attribute_in", True
    told_by = ((), ("attr",))

    def weight(self):
        return F.col("b_attr")


def two_paths(edges: DataFrame) -> DataFrame:
    """How many nodes lie between two others. edges: graph_id, src, dst."""
    a, b = edges.alias("a"), edges.alias("b")
    joined = a.join(b, (F.col("a.graph_id") == F.col("b.graph_id")) & (F.col("a.dst") == F.col("b.src"))).where("a.src <> b.dst")
    return joined.groupBy("a.graph_id", "a.src", "b.dst").agg(F.count("*").alias("paths"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")
