"""Dyads: their order, grids, states, and graphs as integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.spec import Graph


def dyad_index(src: Column, dst: Column, n: int, directed: bool) -> Column:
    """Place of a dyad: rows first, without the diagonal; of undirected graphs above it."""
    if directed:
        return src.cast("long") * (n - 1) + dst - F.when(dst > src, 1).otherwise(0)
    s = src.cast("long")
    return s * n - F.shiftright(s * (s + 1), 1) + dst - s - 1


def index_to_pair(k: int, n: int, directed: bool = True) -> tuple[int, int]:
    """The dyad at a place; IndexError beyond the last."""
    total = n * n - n if directed else n * (n - 1) // 2
    if not 0 <= k < total:
        raise IndexError(f"no dyad {k} among {total}")
    if directed:
        i, j = divmod(k, n - 1)
        return i, j + (j >= i)
    i = 0
    while k >= n - 1 - i:
        k -= n - 1 - i
        i += 1
    return i, i + 1 + k


def pair_columns(k: Column, n: int) -> tuple[Column, Column]:
    """index_to_pair() of directed dyads on columns."""
    i, j = F.floor(k / (n - 1)).cast("int"), (k % (n - 1)).cast("int")
    return i, j + F.when(j >= i, 1).otherwise(0)


def nodes_of_dyads(count: int, directed: bool = True) -> int:
    """n from the number of dyads; ValueError where no n has so many."""
    pairs = count if not directed else count / 2
    n = round((1 + (1 + 8 * pairs) ** 0.5) / 2)
    if n * (n - 1) != (count if directed else 2 * count):
        raise ValueError(f"no graph has {count} dyads")
    return n


def grid(spark: SparkSession, n: int, directed: bool = True) -> DataFrame:
    """All dyads: src, dst, dyad_idx. Generated by index, so that the grid is spread over all tasks."""
    if directed:
        i, j = pair_columns(F.col("id"), n)
        return spark.range(max(0, n * n - n)).select(i.alias("src"), j.alias("dst"), F.col("id").alias("dyad_idx"))
    rows = spark.range(max(0, n - 1)).select(F.col("id").cast("int").alias("src"))
    cells = rows.select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1))).alias("dst"))
    return cells.withColumn("dyad_idx", dyad_index(F.col("src"), F.col("dst"), n, False))


def dyads(graph: Graph) -> DataFrame:
    """The grid of a graph, reduced to its mask."""
    cells = grid(graph.nodes.sparkSession, graph.n, graph.directed)
    return cells if graph.mask is None else cells.join(graph.mask, ["src", "dst"], "left_semi")


def slice_dyads(cells: DataFrame, low: int, high: int) -> DataFrame:
    """The dyads low .. high - 1 by dyad_idx; ValueError for bounds out of order."""
    if not 0 <= low <= high:
        raise ValueError(f"no slice from {low} to {high}")
    return cells.where((F.col("dyad_idx") >= low) & (F.col("dyad_idx") < high))


def labelled(graph: Graph, cells: DataFrame | None = None) -> DataFrame:
    """Dyads with y, the share of graphs that have the edge."""
    k = graph.graphs
    shares = graph.edges.groupBy("src", "dst").agg((F.count("*") / k).alias("y"))
    return (cells if cells is not None else dyads(graph)).join(shares, ["src", "dst"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


def seen_states(graph: Graph) -> DataFrame:
    """graph_id, src < dst and state of the pairs that have an edge."""
    one = graph.edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("bit"))
    return one.groupBy("graph_id", "src", "dst").agg(F.sum("bit").cast("int").alias("state"))


def with_graphs(cells: DataFrame, count: int, first: int = 0) -> DataFrame:
    """Each row once for each of count graphs, with graph_id. Nothing is broadcast: rows are repeated where they are."""
    if count <= 0:
        return cells.limit(0).withColumn("graph_id", F.lit(0).cast("long"))
    return cells.withColumn("graph_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + count - 1).cast("long"))))


def dyad_states(graph: Graph) -> DataFrame:
    """graph_id, src < dst and state, y(src, dst) + 2 y(dst, src), of every graph, those without edges included."""
    pairs = with_graphs(grid(graph.nodes.sparkSession, graph.n, directed=False).select("src", "dst"), graph.graphs)
    return pairs.join(seen_states(graph), ["graph_id", "src", "dst"], "left").withColumn("state", F.coalesce("state", F.lit(0)))


def graph_code(graph: Graph) -> DataFrame:
    """graph_id and code: the edges as bits of an integer, the first dyad highest. Up to 62 dyads."""
    total = graph.n * (graph.n - 1) // (1 if graph.directed else 2)
    if total > 62:
        raise ValueError("too many dyads for an integer; use graph_hash()")
    cells = grid(graph.nodes.sparkSession, graph.n, graph.directed)
    return graph.edges.join(cells, ["src", "dst"]).groupBy("graph_id").agg(F.sum(F.expr(f"shiftleft(1L, cast({total - 1} - dyad_idx as int))")).alias("code"))


def graphs_from_codes(spark: SparkSession, codes: DataFrame, n: int, directed: bool = True) -> DataFrame:
    """Edges of graphs given as graph_id, code."""
    total = n * (n - 1) // (1 if directed else 2)
    if total > 62:
        raise ValueError("too many dyads for an integer")
    cells = grid(spark, n, directed).collect()  # at most 62 rows
    table = F.array(*[F.struct(F.lit(c["src"]).alias("src"), F.lit(c["dst"]).alias("dst"), F.lit(total - 1 - c["dyad_idx"]).alias("bit")) for c in cells])
    on = F.filter(table, lambda c: F.getbit("code", c["bit"]) == 1)
    return codes.select("graph_id", F.explode(on).alias("c")).select("graph_id", "c.src", "c.dst")


def graph_hash(edges: DataFrame) -> DataFrame:
    """graph_id and hash, equal for graphs of equal edges."""
    text = F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("-", F.lpad("src", 10, "0"), F.lpad("dst", 10, "0")))))
    return edges.groupBy("graph_id").agg(F.sha2(text, 256).alias("hash"))
