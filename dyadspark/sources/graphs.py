"""Graphs from tables, lists and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadspark.spec import Graph

NODE_SCHEMA = "node int, type string, attr double, pos array<double>"
EDGE_SCHEMA = "graph_id long, src int, dst int"

#: Who named whom among 18 novices of a monastery, a public data set: source, then the ones it names.
MONASTERY = {
    0: (1, 2, 4, 7, 11, 13), 1: (0, 6, 11, 13, 14), 2: (0, 1, 12, 16, 17), 3: (4, 5, 9, 10), 4: (0, 3, 8, 10, 12), 5: (0, 3, 4, 8),
    6: (0, 1, 7, 11, 15), 7: (0, 1, 3, 5, 8, 9), 8: (4, 7, 11, 15), 9: (3, 4, 7, 8, 12, 13), 10: (3, 4, 7, 13, 15), 11: (0, 1, 6, 13),
    12: (4, 6, 17), 13: (0, 1, 10, 11, 14), 14: (0, 1, 4, 6, 11, 13), 15: (0, 1, 6, 11, 14), 16: (1, 2, 12, 17), 17: (0, 1, 2, 6, 12, 16),
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def graph_from_edges(spark: SparkSession, n: int, edges: Sequence[tuple[int, ...]], directed: bool = True, types: Sequence[str] | None = None, attrs: Sequence[float] | None = None, positions: Sequence[Sequence[float] | float] | None = None, count: int | None = None) -> Graph:
    """From (src, dst) or (graph_id, src, dst); loops go, repeated edges count once. count: graphs, if the last ones have no edges."""
    for name, given in (("types", types), ("attrs", attrs), ("positions", positions)):
        if given is not None and len(given) != n:
            raise ValueError(f"{name} must be given for all {n} nodes")
    place = lambda p: None if p is None else [float(x) for x in (p if isinstance(p, Sequence) else [p])]
    nodes = spark.createDataFrame([(i, types[i] if types else None, float(attrs[i]) if attrs else None, place(positions[i]) if positions else None) for i in range(n)], NODE_SCHEMA)
    rows = {(0, *e) if len(e) == 2 else tuple(e) for e in edges}
    if any(not (0 <= s < n and 0 <= d < n) for _, s, d in rows):
        raise ValueError(f"edges must join nodes 0 to {n - 1}")
    rows = {(g, s, d) if directed or s < d else (g, d, s) for g, s, d in rows if s != d}
    if count is not None and any(g >= count for g, _, _ in rows):
        raise ValueError(f"edges of more than {count} graphs")
    return Graph(nodes, spark.createDataFrame(sorted(rows), EDGE_SCHEMA), n, directed, count=count)


def graph_from_matrices(spark: SparkSession, matrices: Sequence[Sequence[Sequence[int]]], directed: bool = True, **attributes) -> Graph:
    """From adjacency matrices of one size, rows as sources; anything but 0 and 1 is refused."""
    n = len(matrices[0])
    for m in matrices:
        if len(m) != n or any(len(row) != n for row in m):
            raise ValueError("matrices must be square and of one size")
        if any(x not in (0, 1) for row in m for x in row):
            raise ValueError("a graph is binary")
        if not directed and any(m[i][j] != m[j][i] for i in range(n) for j in range(i)):
            raise ValueError("an undirected graph needs a symmetric matrix")
    edges = [(g, i, j) for g, m in enumerate(matrices) for i in range(n) for j in range(n) if i != j and m[i][j]]
    return graph_from_edges(spark, n, edges, directed, count=len(matrices), **attributes)


def monastery(spark: SparkSession, directed: bool = True) -> Graph:
    return graph_from_edges(spark, 18, [(s, d) for s, ds in MONASTERY.items() for d in ds], directed)


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations: their region as type, key as attribute, key and region key as position."""
    joined = _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("n_nationkey").cast("int").alias("node"), F.col("r_name").alias("type"), F.col("n_nationkey").cast("double").alias("attr"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")).alias("pos"))


def _above_average(pairs: DataFrame) -> DataFrame:
    """Edges of the pairs counted more often than the mean pair, in integers. pairs: src, dst, c."""
    total = pairs.agg(F.count("*").alias("pairs"), F.sum("c").alias("total"))
    return pairs.join(F.broadcast(total)).where(F.col("c") * F.col("pairs") > F.col("total")).select(F.lit(0).cast("long").alias("graph_id"), F.col("src").cast("int"), F.col("dst").cast("int"))


def trade_graph(spark: SparkSession, sf_dir: str, directed: bool = True) -> Graph:
    """Nation i to nation j where i's suppliers ship more lines to j's customers than pairs do on average.

    The undirected graph joins what either direction joins. Lines are counted by supplier and order
    before they meet the larger tables.
    """
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    customer = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst")
    by_order = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "src")
    pairs = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("c"))
    edges = _above_average(pairs)
    if not directed:
        edges = edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return Graph(nation_nodes(spark, sf_dir), edges, 25, directed, count=1)


def quarterly_trade(spark: SparkSession, sf_dir: str, quarters: int = 32) -> Graph:
    """A graph for each quarter from January 1994 on: nation to nation where more lines than the mean of pairs and quarters were shipped.

    Quarters without orders are graphs without edges.
    """
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    customer = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    quarter = (F.year("o_orderdate") - 1994) * 4 + F.quarter("o_orderdate") - 1
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", quarter.cast("long").alias("graph_id")).join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "dst", "graph_id")
    sold = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where(f"src <> dst AND graph_id >= 0 AND graph_id < {quarters}")
    counted = sold.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("c"))
    total = counted.agg(F.count("*").alias("pairs"), F.sum("c").alias("total"))
    edges = counted.join(F.broadcast(total)).where("c * pairs > total").select("graph_id", F.col("src").cast("int"), F.col("dst").cast("int"))
    return Graph(nation_nodes(spark, sf_dir), edges, 25, True, count=quarters)


def follow_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """User u to v where v's event comes right after u's on some calendar day."""
    events = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    order = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    steps = events.select(F.col("user_id").cast("int").alias("src"), F.lead("user_id").over(order).cast("int").alias("dst"))
    edges = steps.where("src <> dst").distinct().select(F.lit(0).cast("long").alias("graph_id"), "src", "dst")
    nodes = events.select(F.col("user_id").cast("int").alias("node")).distinct().select("node", F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("attr"), F.lit(None).cast("array<double>").alias("pos"))
    n = (events.agg(F.max("user_id")).first()[0] or -1) + 1
    return Graph(nodes, edges, int(n), True, count=1)


def cosupply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers that share more orders than pairs do on average; undirected.

    Lines are dealt out by order and listed, pairs by themselves: lines are few bytes in a file and
    many rows, so nothing is broadcast, and pairs of few orders are not worth summing before they are dealt out.
    """
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("int").alias("s")).where("l_orderkey IS NOT NULL AND s IS NOT NULL")
    orders = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("s")).alias("all"))
    first = orders.select("all", F.posexplode("all").alias("at", "src"))
    both = first.select("src", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("dst"))
    pairs = both.repartition("src", "dst").groupBy("src", "dst").agg(F.count("*").alias("c"))
    supplier = _read(spark, sf_dir, "supplier")
    nodes = supplier.select(F.col("s_suppkey").cast("int").alias("node"), F.col("s_nationkey").cast("string").alias("type"), F.col("s_acctbal").alias("attr"), F.lit(None).cast("array<double>").alias("pos"))
    n = (supplier.agg(F.max("s_suppkey")).first()[0] or -1) + 1
    return Graph(nodes, _above_average(pairs), int(n), False, count=1)


def read_graph(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    """A graph that write_graph() left."""
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")
    shape = spark.read.parquet(f"{path}/shape").first()
    return Graph(nodes, spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges"), shape["n"], directed, count=shape["graphs"])


def write_graph(graph: Graph, path: str) -> None:
    graph.nodes.select("node", "type", "attr", "pos").write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.select("graph_id", "src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    graph.nodes.sparkSession.createDataFrame([(graph.n, graph.graphs)], "n int, graphs int").write.mode("overwrite").parquet(f"{path}/shape")
