"""Named queries over the driver's tables, each with an SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadspark.functions import dyads as D
from dyadspark.functions.scalar import sigmoid
from dyadspark.model import GraphModel
from dyadspark.operators import convergence, covariance, enumeration, evaluate, fit, sampling
from dyadspark.operators import metrics as M
from dyadspark.operators.collection import Collection, random_graphs, split_nodes
from dyadspark.sources import graphs as S
from dyadspark.spec import Graph, Proposal
from dyadspark.streaming.windows import windowed_activity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Parameters that queries and their twins share.
THETA_EDGES, THETA_MUTUAL, SEED, SAMPLES = -0.75, 1.25, 17, 40

_TRADE = """
nodes AS (SELECT n_nationkey AS node, r_name AS type, CAST(n_nationkey AS DOUBLE) AS attr, CAST(n_nationkey AS DOUBLE) AS px, CAST(n_regionkey AS DOUBLE) AS py FROM nation JOIN region ON n_regionkey = r_regionkey),
counted AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
edges AS (SELECT src, dst FROM counted WHERE c * (SELECT count(*) FROM counted) > (SELECT sum(c) FROM counted)),
dyads AS (SELECT a.node AS src, b.node AS dst, CAST(a.node AS BIGINT) * 24 + b.node - CASE WHEN b.node > a.node THEN 1 ELSE 0 END AS dyad_idx, a.type AS t1, b.type AS t2, a.attr AS a1, b.attr AS a2, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS dist FROM nodes a JOIN nodes b ON a.node <> b.node),
y AS (SELECT d.*, CASE WHEN e.src IS NULL THEN 0 ELSE 1 END AS y, CASE WHEN r.src IS NULL THEN 0 ELSE 1 END AS back FROM dyads d LEFT JOIN edges e ON d.src = e.src AND d.dst = e.dst LEFT JOIN edges r ON d.src = r.dst AND d.dst = r.src),
pairs AS (SELECT src, dst, y + 2 * back AS state FROM y WHERE src < dst),
uedges AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges),
types AS (SELECT DISTINCT type FROM nodes)"""
_FOLLOW = """
steps AS (SELECT CAST(user_id AS INTEGER) AS src, CAST(lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS dst FROM events),
edges AS (SELECT DISTINCT src, dst FROM steps WHERE dst IS NOT NULL AND src <> dst),
nodes AS (SELECT DISTINCT CAST(user_id AS INTEGER) AS node FROM events)"""
_COSUPPLY = """
parts AS (SELECT DISTINCT l_orderkey AS o, CAST(l_suppkey AS INTEGER) AS s FROM lineitem),
counted AS (SELECT a.s AS src, b.s AS dst, count(*) AS c FROM parts a JOIN parts b ON a.o = b.o AND a.s < b.s GROUP BY 1, 2),
edges AS (SELECT src, dst FROM counted WHERE c * (SELECT count(*) FROM counted) > (SELECT sum(c) FROM counted))"""
_RANDOM = f"""
r AS (SELECT g AS graph_id, CAST(i AS INTEGER) AS src, CAST(j AS INTEGER) AS dst FROM range({SAMPLES}) t(g), range(6) a(i), range(6) b(j) WHERE i <> j AND CAST('0x' || substr(md5('{SEED}|' || g || '|' || i || '|' || j), 1, 8) AS BIGINT) < 0.5 * 4294967296),
stat AS (SELECT g AS t, (SELECT count(*) FROM r WHERE graph_id = g) AS edges, (SELECT count(*) FROM r a JOIN r b ON a.graph_id = g AND b.graph_id = g AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) AS mutual FROM range({SAMPLES}) t(g)),
chain AS (SELECT t, 0 AS f, CAST(edges AS DOUBLE) AS v FROM stat UNION ALL SELECT t, 1, CAST(mutual AS DOUBLE) FROM stat),
dev AS (SELECT t, f, v - avg(v) OVER (PARTITION BY f) AS d FROM chain)"""


def query(name: str, prelude: str | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {prelude.strip()}\n{sql.strip()}" if prelude else sql.strip()
        return f

    return put


def _values(metric: M.Metric, graph: Graph) -> DataFrame:
    """Named statistics of one metric, zeros included."""
    stats = Collection([metric], graph).sample_statistics()
    return stats.select(F.col("f_idx").alias("feature"), F.col("value"))


def _single(metric: M.Metric, graph: Graph) -> DataFrame:
    return _values(metric, graph).select("value")


# statistics


@query("g_edges_directed", _TRADE, "SELECT CAST(count(*) AS DOUBLE) AS value FROM edges")
def g_edges_directed(spark, d):
    return _single(M.Edges(), S.trade_graph(spark, d))


@query("g_edges_undirected", _TRADE, "SELECT CAST(count(*) AS DOUBLE) AS value FROM uedges")
def g_edges_undirected(spark, d):
    return _single(M.Edges(False), S.trade_graph(spark, d, False))


@query("g_follow_edges", _FOLLOW, "SELECT CAST(count(*) AS DOUBLE) AS value FROM edges")
def g_follow_edges(spark, d):
    return _single(M.Edges(), S.follow_graph(spark, d))


@query("g_triangles", _TRADE, "SELECT CAST(count(*) AS DOUBLE) AS value FROM uedges a JOIN uedges b ON a.dst = b.src JOIN uedges c ON c.src = a.src AND c.dst = b.dst")
def g_triangles(spark, d):
    return _single(M.Triangles(False), S.trade_graph(spark, d, False))


@query("g_cosupply_triangles", _COSUPPLY, "SELECT CAST(count(*) AS DOUBLE) AS value FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst")
def g_cosupply_triangles(spark, d):
    return _single(M.Triangles(False), S.cosupply_graph(spark, d))


@query("g_cyclic_triads", _FOLLOW, "SELECT CAST(count(*) // 3 AS DOUBLE) AS value FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src AND c.dst = a.src")
def g_cyclic_triads(spark, d):
    return _single(M.Triangles(True), S.follow_graph(spark, d))


for _name, _metric, _key in (("g_indegree", M.InDegree, "dst"), ("g_outdegree", M.OutDegree, "src")):
    query(_name, _TRADE, f"SELECT node AS feature, CAST(count({_key}) AS DOUBLE) AS value FROM nodes LEFT JOIN edges ON node = {_key} GROUP BY node")(lambda spark, d, m=_metric: _values(m(), S.trade_graph(spark, d)))


@query("g_degree", _TRADE, "SELECT node AS feature, CAST(count(src) AS DOUBLE) AS value FROM nodes LEFT JOIN uedges ON node = src OR node = dst GROUP BY node")
def g_degree(spark, d):
    return _values(M.UndirectedDegree(), S.trade_graph(spark, d, False))


@query("g_reciprocity_pairs", _TRADE, "SELECT CAST(src * 25 - src * (src + 1) // 2 + dst - src - 1 AS INTEGER) AS feature, CASE WHEN state = 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM pairs")
def g_reciprocity_pairs(spark, d):
    return _values(M.Reciprocity(), S.trade_graph(spark, d))


@query("g_total_reciprocity", _FOLLOW, "SELECT CAST(count(*) AS DOUBLE) AS value FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def g_total_reciprocity(spark, d):
    return _single(M.TotalReciprocity(), S.follow_graph(spark, d))


@query("g_type_pairs_directed", _TRADE, "SELECT 'num_edges_between_types_directed_' || a.type || '__' || b.type AS name, (SELECT CAST(coalesce(sum(y), 0) AS DOUBLE) FROM y WHERE t1 = a.type AND t2 = b.type) AS value FROM types a, types b")
def g_type_pairs_directed(spark, d):
    return Collection([M.TypePairs()], S.trade_graph(spark, d)).sample_statistics().select("name", "value")


@query("g_type_pairs_undirected", _TRADE, """
SELECT 'num_edges_between_types_undirected_' || a.type || '__' || b.type AS name, CAST(count(u.src) AS DOUBLE) AS value FROM types a JOIN types b ON a.type <= b.type
LEFT JOIN (SELECT u.src, least(p.type, q.type) AS t1, greatest(p.type, q.type) AS t2 FROM uedges u JOIN nodes p ON u.src = p.node JOIN nodes q ON u.dst = q.node) u ON u.t1 = a.type AND u.t2 = b.type GROUP BY a.type, b.type""")
def g_type_pairs_undirected(spark, d):
    return Collection([M.TypePairs(False)], S.trade_graph(spark, d, False)).sample_statistics().select("name", "value")


for _name, _metric, _sum in (("g_sum_distance", M.SumDistances, "dist"), ("g_attr_sum", M.AttributeSum, "a1 + a2"), ("g_attr_sum_out", M.AttributeSumOut, "a1"), ("g_attr_sum_in", M.AttributeSumIn, "a2")):
    query(_name, _TRADE, f"SELECT round(coalesce(sum(CASE WHEN y = 1 THEN {_sum} END), 0), 6) AS value FROM y")(lambda spark, d, m=_metric: _single(m(), S.trade_graph(spark, d)).select(F.round("value", 6).alias("value")))


def _everything() -> list[M.Metric]:
    return [M.Edges(), M.TotalReciprocity(), M.Triangles(True), M.SumDistances(), M.AttributeSum(), M.OutDegree(ignore=(0,))]


@query("g_stats_long", _TRADE, """
SELECT 0 AS f_idx, 'num_edges_directed' AS name, CAST(count(*) AS DOUBLE) AS value FROM edges
UNION ALL SELECT 1, 'total_reciprocity', CAST(count(*) AS DOUBLE) FROM pairs WHERE state = 3
UNION ALL SELECT 2, 'num_triangles_directed', CAST(count(*) // 3 AS DOUBLE) FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON b.dst = c.src AND c.dst = a.src
UNION ALL SELECT 3, 'sum_distances_connected_neurons', round(coalesce(sum(CASE WHEN y = 1 THEN dist END), 0), 6) FROM y
UNION ALL SELECT 4, 'node_attribute_sum', round(coalesce(sum(CASE WHEN y = 1 THEN a1 + a2 END), 0), 6) FROM y
UNION ALL SELECT CAST(4 + node AS INTEGER), 'outdegree_' || (node + 1), CAST(count(src) AS DOUBLE) FROM nodes LEFT JOIN edges ON src = node WHERE node > 0 GROUP BY node""")
def g_stats_long(spark, d):
    return Collection(_everything(), S.trade_graph(spark, d)).sample_statistics().select("f_idx", "name", F.round("value", 6).alias("value"))


def _masked(spark: SparkSession, d: str) -> Graph:
    graph = S.trade_graph(spark, d)
    return graph.but(mask=D.grid(spark, 25).where("(src + dst) % 3 <> 0").select("src", "dst"))


@query("g_stats_masked", _TRADE, """
SELECT 0 AS f_idx, CAST(sum(y) AS DOUBLE) AS value FROM y WHERE (src + dst) % 3 <> 0
UNION ALL SELECT CAST(1 + node AS INTEGER), CAST(count(y.dst) AS DOUBLE) FROM nodes LEFT JOIN y ON y.dst = node AND y.y = 1 AND (y.src + y.dst) % 3 <> 0 GROUP BY node""")
def g_stats_masked(spark, d):
    return Collection([M.Edges(), M.InDegree()], _masked(spark, d)).sample_statistics().select("f_idx", "value")


@query("g_bootstrap_subgraph", _TRADE, "SELECT CAST(count(*) AS BIGINT) AS edges FROM edges WHERE src % 2 = 0 AND dst % 2 = 0")
def g_bootstrap_subgraph(spark, d):
    graph = S.trade_graph(spark, d)
    kept = graph.nodes.where("node % 2 = 0").select("node")
    inside = graph.edges.join(F.broadcast(kept.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(kept.withColumnRenamed("node", "dst")), "dst", "left_semi")
    return inside.agg(F.count("*").alias("edges"))


@query("g_two_paths", _TRADE, "SELECT a.src, b.dst, count(*) AS paths FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2")
def g_two_paths(spark, d):
    return M.two_paths(S.trade_graph(spark, d).edges).select("src", "dst", "paths")


# change scores and designs


def _changes(metric: M.Metric, graph: Graph) -> DataFrame:
    return Collection([metric], graph).change_scores().select("src", "dst", F.col("f_idx").alias("feature"), F.round("change", 6).alias("change"))


for _name, _metric, _feature, _value, _where in (
    ("change_edges", M.Edges, "0", "1.0", "TRUE"), ("change_mutual", M.TotalReciprocity, "0", "1.0", "back = 1"), ("change_outdegree", M.OutDegree, "src", "1.0", "TRUE"), ("change_degree", M.InDegree, "dst", "1.0", "TRUE"),
    ("change_types", M.TypePairs, "(SELECT count(*) FROM types WHERE type < t1) * 5 + (SELECT count(*) FROM types WHERE type < t2)", "1.0", "TRUE"), ("change_distance", M.SumDistances, "0", "dist", "TRUE"),
    ("change_reciprocity", M.Reciprocity, "least(src, dst) * 25 - least(src, dst) * (least(src, dst) + 1) // 2 + greatest(src, dst) - least(src, dst) - 1", "1.0", "back = 1"),
):
    query(_name, _TRADE, f"SELECT src, dst, CAST({_feature} AS INTEGER) AS feature, round((1 - 2 * y) * CAST({_value} AS DOUBLE), 6) AS change FROM y WHERE {_where}")(lambda spark, d, m=_metric: _changes(m(), S.trade_graph(spark, d)))


@query("change_triads", _TRADE, "SELECT d.src, d.dst, 0 AS feature, CAST((1 - 2 * d.y) * count(*) AS DOUBLE) AS change FROM y d JOIN edges a ON a.src = d.dst JOIN edges b ON b.src = a.dst AND b.dst = d.src GROUP BY d.src, d.dst, d.y")
def change_triads(spark, d):
    return _changes(M.Triangles(True), S.trade_graph(spark, d))


@query("change_triangles", _COSUPPLY, """
, ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)
SELECT a.src, b.dst, 0 AS feature, CAST(count(*) * CASE WHEN any_value(e.src) IS NULL THEN 1 ELSE -1 END AS DOUBLE) AS change FROM ways a JOIN ways b ON a.dst = b.src AND a.src < b.dst LEFT JOIN edges e ON e.src = a.src AND e.dst = b.dst GROUP BY a.src, b.dst""")
def change_triangles(spark, d):
    return _changes(M.Triangles(False), S.cosupply_graph(spark, d))


_DESIGN = """, x AS (
  SELECT dyad_idx, 0 AS f, CAST(1 AS DOUBLE) AS v FROM y UNION ALL SELECT dyad_idx, 1, 1 FROM y WHERE back = 1
  UNION ALL SELECT d.dyad_idx, 2, CAST(count(*) AS DOUBLE) FROM y d JOIN edges a ON a.src = d.dst JOIN edges b ON b.src = a.dst AND b.dst = d.src GROUP BY d.dyad_idx
  UNION ALL SELECT dyad_idx, 3, dist FROM y)"""


def _design(spark: SparkSession, d: str) -> DataFrame:
    rows = Collection([M.Edges(), M.TotalReciprocity(), M.Triangles(True), M.SumDistances()], S.trade_graph(spark, d)).design_rows()
    return rows.select("dyad_idx", "y", F.explode("x").alias("e")).select("dyad_idx", F.col("y").cast("int").alias("y"), F.col("e.f").alias("f"), F.round("e.v", 6).alias("v"))


@query("design_dyads", _TRADE, f"{_DESIGN} SELECT x.dyad_idx, y.y, x.f, round(x.v, 6) AS v FROM x JOIN y USING (dyad_idx)")
def design_dyads(spark, d):
    return _design(spark, d)


@query("design_slice", _TRADE, f"{_DESIGN} SELECT CAST(x.dyad_idx // 150 AS INTEGER) AS part, x.dyad_idx, y.y, x.f, round(x.v, 6) AS v FROM x JOIN y USING (dyad_idx)")
def design_slice(spark, d):
    """Slices that together hold all dyads."""
    design = _design(spark, d)
    parts = [D.slice_dyads(design, low, low + 150).withColumn("part", F.lit(low // 150)) for low in range(0, 600, 150)]
    return reduce(DataFrame.unionByName, parts)


@query("design_labels_multi", None, f"""
WITH {_RANDOM}
SELECT CAST(a.i * 5 + b.j - CASE WHEN b.j > a.i THEN 1 ELSE 0 END AS BIGINT) AS dyad_idx, round(count(r.graph_id) / {SAMPLES}.0, 6) AS y FROM range(6) a(i) JOIN range(6) b(j) ON a.i <> b.j LEFT JOIN r ON r.src = a.i AND r.dst = b.j GROUP BY a.i, b.j""")
def design_labels_multi(spark, d):
    return D.labelled(_random(spark)).select("dyad_idx", F.round("y", 6).alias("y"))


def _random(spark: SparkSession) -> Graph:
    graph = S.graph_from_edges(spark, 6, [(0, 1)])
    return graph.but(edges=random_graphs(spark, 6, True, SAMPLES, 0.5, SEED))


@query("design_compressed", _TRADE, "SELECT t1, t2, CAST(count(*) AS DOUBLE) AS w, CAST(sum(y) AS DOUBLE) AS wy FROM y GROUP BY t1, t2")
def design_compressed(spark, d):
    """The design of type pairs, summed by its different rows."""
    graph = S.trade_graph(spark, d)
    model = Collection([M.TypePairs()], graph)
    pairs = spark.createDataFrame([(f, *model.metrics[k].pairs(graph)[j]) for f, (k, j, _) in enumerate(model.features())], "f int, t1 string, t2 string")
    return fit.compress(model.design_rows()).withColumn("f", F.col("x")[0]["f"]).join(F.broadcast(pairs), "f").select("t1", "t2", "w", "wy")


@query("dyad_index_roundtrip", _TRADE, "SELECT src, dst, dyad_idx FROM dyads")
def dyad_index_roundtrip(spark, d):
    i, j = D.pair_columns(F.col("dyad_idx"), 25)
    cells = D.grid(spark, 25).select("dyad_idx")
    return cells.select(i.alias("src"), j.alias("dst"), "dyad_idx")


@query("dyad_states", _TRADE, "SELECT src, dst, state FROM pairs")
def dyad_states(spark, d):
    return D.dyad_states(S.trade_graph(spark, d)).select("src", "dst", "state")


@query("dyad_design_4state", _TRADE, """
SELECT src, dst, state, f, v FROM (SELECT DISTINCT src, dst FROM pairs) p, (VALUES (1, 0, 1.0::DOUBLE), (2, 0, 1.0), (3, 0, 2.0), (3, 1, 1.0)) s(state, f, v)""")
def dyad_design_4state(spark, d):
    return Collection([M.Edges(), M.TotalReciprocity()], S.trade_graph(spark, d)).pair_design().select("src", "dst", "state", F.col("f_idx").alias("f"), "v")


@query("type_pair_density", _TRADE, "SELECT a.type AS t1, b.type AS t2, CAST(coalesce(sum(y), 0) AS BIGINT) AS edges, CAST(count(y.src) AS BIGINT) AS possible, round(coalesce(sum(y) / nullif(count(y.src), 0), 0), 9) AS density FROM types a CROSS JOIN types b LEFT JOIN y ON t1 = a.type AND t2 = b.type GROUP BY a.type, b.type")
def type_pair_density(spark, d):
    return evaluate.type_pair_density(S.trade_graph(spark, d)).withColumn("density", F.round("density", 9))


# fits


def _theta(model: GraphModel, fitted: bool = True, **options) -> DataFrame:
    result = model.fit(**options) if fitted else None
    rows = [(name, value, result.success if result else True) for name, value in model.parameters().items()]
    return model.graph.nodes.sparkSession.createDataFrame(rows, "name string, theta double, success boolean").select("name", F.round("theta", 5).alias("theta"))


@query("mple_edges_theta", _TRADE, "SELECT 'num_edges_directed' AS name, round(ln(sum(y) / (count(*) - sum(y))), 5) AS theta FROM y")
def mple_edges_theta(spark, d):
    return _theta(GraphModel(S.trade_graph(spark, d), [M.Edges()], fix_collinearity=False))


@query("mple_edges_theta_follow", _FOLLOW, "SELECT 'num_edges_directed' AS name, round(ln(m / (n * (n - 1.0) - m)), 5) AS theta FROM (SELECT count(*) AS m FROM edges), (SELECT max(node) + 1 AS n FROM nodes)")
def mple_edges_theta_follow(spark, d):
    return _theta(GraphModel(S.follow_graph(spark, d), [M.Edges()], fix_collinearity=False))


@query("mple_types_theta", _TRADE, """
SELECT 'num_edges_between_types_directed_' || t1 || '__' || t2 AS name, round(CASE WHEN sum(y) = 0 THEN -1 WHEN sum(y) = count(*) THEN 1 ELSE ln(sum(y) / (count(*) - sum(y))) END, 5) AS theta FROM y GROUP BY t1, t2""")
def mple_types_theta(spark, d):
    """Type pairs without edges, or with all, have no finite estimate; they are given as -1 and 1."""
    graph = S.trade_graph(spark, d)
    found = _theta(GraphModel(graph, [M.TypePairs()], fix_collinearity=False))
    return found.withColumn("theta", F.when(F.abs("theta") > 15, F.signum("theta")).otherwise(F.col("theta")))


@query("mple_weighted_theta", _TRADE, "SELECT 'num_edges_directed' AS name, round(ln(sum(w * y) / (sum(w) - sum(w * y))), 5) AS theta FROM (SELECT y, CASE WHEN (src + dst) % 2 = 0 THEN 2.5 ELSE 1.0 END AS w FROM y)")
def mple_weighted_theta(spark, d):
    graph = S.trade_graph(spark, d)
    weights = D.grid(spark, 25).where("(src + dst) % 2 = 0").select("src", "dst", F.lit(2.5).alias("w"))
    return _theta(GraphModel(graph.but(weights=weights), [M.Edges()], fix_collinearity=False))


@query("mple_masked_theta", _TRADE, "SELECT 'num_edges_directed' AS name, round(ln(sum(y) / (count(*) - sum(y))), 5) AS theta FROM y WHERE (src + dst) % 3 <> 0")
def mple_masked_theta(spark, d):
    return _theta(GraphModel(_masked(spark, d), [M.Edges()], fix_collinearity=False))


@query("mple_multi_theta", None, f"WITH {_RANDOM} SELECT 'num_edges_directed' AS name, round(ln(avg(edges) / (30 - avg(edges))), 5) AS theta FROM stat")
def mple_multi_theta(spark, d):
    return _theta(GraphModel(_random(spark), [M.Edges()], fix_collinearity=False))


@query("dyadfit_edges_mutual_theta", _TRADE, """
, c AS (SELECT CAST(count(*) FILTER (state IN (1, 2)) AS DOUBLE) AS a, CAST(count(*) FILTER (state = 3) AS DOUBLE) AS m, CAST(count(*) FILTER (state = 0) AS DOUBLE) AS z FROM pairs)
SELECT 'num_edges_directed' AS name, round(ln(a / (2 * z)), 5) AS theta FROM c UNION ALL SELECT 'total_reciprocity', round(ln(m / z) - 2 * ln(a / (2 * z)), 5) FROM c""")
def dyadfit_edges_mutual_theta(spark, d):
    return _theta(GraphModel(S.trade_graph(spark, d), [M.Edges(), M.TotalReciprocity()], fix_collinearity=False))


_QUARTERS = """
counted AS (SELECT CAST((year(o_orderdate) - 1994) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS g, s_nationkey AS src, c_nationkey AS dst, count(*) AS c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2, 3),
edges AS (SELECT g, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM counted WHERE c * (SELECT count(*) FROM counted) > (SELECT sum(c) FROM counted)),
seen AS (SELECT g, least(src, dst) AS src, greatest(src, dst) AS dst, sum(CASE WHEN src < dst THEN 1 ELSE 2 END) AS state FROM edges GROUP BY 1, 2, 3),
pairs AS (SELECT CAST(i AS INTEGER) AS src, CAST(j AS INTEGER) AS dst, m.g, coalesce(state, 0) AS state FROM range(32) m(g), range(25) a(i) JOIN range(25) b(j) ON i < j LEFT JOIN seen ON seen.g = m.g AND seen.src = i AND seen.dst = j)"""


@query("mple_multi_empty_theta", _QUARTERS, "SELECT 'num_edges_directed' AS name, round(ln(m / (32 * 600.0 - m)), 5) AS theta FROM (SELECT count(*) AS m FROM edges)")
def mple_multi_empty_theta(spark, d):
    """A sample of graphs, the last of them without edges."""
    return _theta(GraphModel(S.quarterly_trade(spark, d), [M.Edges()], fix_collinearity=False))


@query("dyadfit_multi_theta", _QUARTERS, """
, c AS (SELECT CAST(count(*) FILTER (state IN (1, 2)) AS DOUBLE) AS a, CAST(count(*) FILTER (state = 3) AS DOUBLE) AS m, CAST(count(*) FILTER (state = 0) AS DOUBLE) AS z FROM pairs)
SELECT 'num_edges_directed' AS name, round(ln(a / (2 * z)), 5) AS theta FROM c UNION ALL SELECT 'total_reciprocity', round(ln(m / z) - 2 * ln(a / (2 * z)), 5) FROM c""")
def dyadfit_multi_theta(spark, d):
    return _theta(GraphModel(S.quarterly_trade(spark, d), [M.Edges(), M.TotalReciprocity()], fix_collinearity=False))


@query("pair_labels_multi", _QUARTERS, f"SELECT src, dst, {', '.join(f'round(count(*) FILTER (state = {s}) / 32.0, 9) AS y{s}' for s in range(4))} FROM pairs GROUP BY src, dst")
def pair_labels_multi(spark, d):
    """Shares of all quarters in which a pair is in each state."""
    rows = fit.pair_rows(Collection([M.Edges(), M.TotalReciprocity()], S.quarterly_trade(spark, d)))
    return rows.select("src", "dst", *[F.round(f"y{s}", 9).alias(f"y{s}") for s in range(4)])


@query("states_multi", _QUARTERS, "SELECT g AS graph_id, src, dst, CAST(state AS INTEGER) AS state FROM pairs")
def states_multi(spark, d):
    return D.dyad_states(S.quarterly_trade(spark, d)).select("graph_id", "src", "dst", "state")


@query("mple_degree_newton", _FOLLOW, "SELECT CAST(node AS INTEGER) AS node, CAST(count(src) AS DOUBLE) AS expected FROM nodes LEFT JOIN edges ON src = node GROUP BY node")
def mple_degree_newton(spark, d):
    """At the optimum of the out-degree model, expected degrees are the observed ones."""
    model = GraphModel(S.follow_graph(spark, d), [M.OutDegree()], fix_collinearity=False)
    model.fit()
    return model.expected_degrees().select("node", F.round("expected", 4).alias("expected"))


@query("mple_triad_theta")
def mple_triad_theta(spark, d):
    """Pseudo-likelihood of a dyad-dependent model, from one join for all change scores."""
    return _theta(GraphModel(S.trade_graph(spark, d), [M.Edges(), M.Triangles(True)], fix_collinearity=False), scheme="mple")


# evaluation at fixed parameters

_P = f"(1 / (1 + exp(-({THETA_EDGES} + 0.02 * dist))))"


def _fixed(spark: SparkSession, d: str) -> GraphModel:
    return GraphModel(S.trade_graph(spark, d), [M.Edges(), M.SumDistances()], theta=[THETA_EDGES, 0.02])


def _fixed_pairs(spark: SparkSession, d: str) -> GraphModel:
    return GraphModel(S.trade_graph(spark, d), [M.Edges(), M.TotalReciprocity()], theta=[THETA_EDGES, THETA_MUTUAL])


@query("predict_fixed_theta", _TRADE, f"SELECT dyad_idx, round({_P}, 9) AS p FROM y")
def predict_fixed_theta(spark, d):
    return _fixed(spark, d).predict().select("dyad_idx", F.round("p", 9).alias("p"))


@query("predict_matrix", _TRADE, f"SELECT src, {', '.join(f'round(sum(CASE WHEN dst = {k} THEN {_P} END), 9) AS c{k}' for k in range(25))} FROM y GROUP BY src")
def predict_matrix(spark, d):
    """The matrix form; the diagonal is null."""
    wide = _fixed(spark, d).predict().groupBy("src").pivot("dst", list(range(25))).agg(F.round(F.sum("p"), 9))
    return wide.select("src", *[F.col(str(k)).alias(f"c{k}") for k in range(25)])


@query("loglik_fixed_theta", _TRADE, f"SELECT round(sum(y * ln({_P}) + (1 - y) * ln(1 - {_P})), 6) AS log_likelihood FROM y")
def loglik_fixed_theta(spark, d):
    return _fixed(spark, d).log_likelihood().select(F.round("log_likelihood", 6).alias("log_likelihood"))


@query("loglik_mean_base2", _TRADE, f"SELECT round(avg(y * ln({_P}) + (1 - y) * ln(1 - {_P})) / ln(2), 9) AS log_likelihood FROM y")
def loglik_mean_base2(spark, d):
    return _fixed(spark, d).log_likelihood("mean", 2).select(F.round("log_likelihood", 9).alias("log_likelihood"))


@query("entropy_fixed_theta", _TRADE, f"SELECT round(sum(-{_P} * log2({_P}) - (1 - {_P}) * log2(1 - {_P})), 6) AS entropy FROM y")
def entropy_fixed_theta(spark, d):
    return _fixed(spark, d).entropy().select(F.round("entropy", 6).alias("entropy"))


@query("grad_fixed_theta", _TRADE, f"SELECT 0 AS f, round(sum(y - {_P}), 6) AS g FROM y UNION ALL SELECT 1, round(sum((y - {_P}) * dist), 6) FROM y")
def grad_fixed_theta(spark, d):
    model = _fixed(spark, d)
    rows = model.collection.design_rows().withColumn("p", sigmoid(fit.linear_score(model.theta)))
    return rows.select(F.explode("x").alias("e"), (F.col("w") * (F.col("y") - F.col("p"))).alias("r")).groupBy("e.f").agg(F.round(F.sum(F.col("e.v") * F.col("r")), 6).alias("g"))


@query("curvature_fixed_theta", _TRADE, f"SELECT a.f, b.f AS g, round(sum({_P} * (1 - {_P}) * CASE WHEN a.f = 1 THEN dist ELSE 1 END * CASE WHEN b.f = 1 THEN dist ELSE 1 END), 6) AS h FROM y, (VALUES (0), (1)) a(f), (VALUES (0), (1)) b(f) GROUP BY a.f, b.f")
def curvature_fixed_theta(spark, d):
    model = _fixed(spark, d)
    rows = model.collection.design_rows().withColumn("p", sigmoid(fit.linear_score(model.theta)))
    both = rows.select("x", (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("d")).select("x", "d", F.explode("x").alias("a")).select("d", "a", F.explode("x").alias("b"))
    return both.groupBy("a.f", F.col("b.f").alias("g")).agg(F.round(F.sum(F.col("d") * F.col("a.v") * F.col("b.v")), 6).alias("h"))


_W1, _W3 = f"exp({THETA_EDGES})", f"exp({2 * THETA_EDGES + THETA_MUTUAL})"
_Z = f"(1 + 2 * {_W1} + {_W3})"


@query("dyad_predict_fixed_theta", _TRADE, f"SELECT src, dst, round(1 / {_Z}, 9) AS p0, round({_W1} / {_Z}, 9) AS p1, round({_W1} / {_Z}, 9) AS p2, round({_W3} / {_Z}, 9) AS p3 FROM pairs")
def dyad_predict_fixed_theta(spark, d):
    return _fixed_pairs(spark, d).predict_pairs().select("src", "dst", *[F.round(f"p{s}", 9).alias(f"p{s}") for s in range(4)])


@query("dyad_marginals", _TRADE, f"SELECT src, dst, round(({_W1} + {_W3}) / {_Z}, 9) AS p FROM dyads")
def dyad_marginals(spark, d):
    return fit.marginals(_fixed_pairs(spark, d).predict_pairs()).select("src", "dst", F.round("p", 9).alias("p"))


@query("dyad_loglik", _TRADE, f"SELECT round(sum(CASE state WHEN 0 THEN -ln({_Z}) WHEN 3 THEN {2 * THETA_EDGES + THETA_MUTUAL} - ln({_Z}) ELSE {THETA_EDGES} - ln({_Z}) END), 6) AS log_likelihood FROM pairs")
def dyad_loglik(spark, d):
    return _fixed_pairs(spark, d).log_likelihood().select(F.round("log_likelihood", 6).alias("log_likelihood"))


@query("dyad_entropy", _TRADE, f"SELECT round(count(*) * -(1 / {_Z} * log2(1 / {_Z}) + 2 * {_W1} / {_Z} * log2({_W1} / {_Z}) + {_W3} / {_Z} * log2({_W3} / {_Z})), 6) AS entropy FROM pairs")
def dyad_entropy(spark, d):
    return _fixed_pairs(spark, d).entropy().select(F.round("entropy", 6).alias("entropy"))


@query("concordance", _TRADE, "SELECT round(2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) * (avg(a) - avg(b))), 9) AS ccc FROM (SELECT node, (SELECT count(*)::DOUBLE FROM edges WHERE src = node) AS a, (SELECT count(*)::DOUBLE FROM edges WHERE dst = node) AS b FROM nodes)")
def concordance(spark, d):
    graph = S.trade_graph(spark, d)
    rows = _values(M.OutDegree(), graph).withColumnRenamed("value", "a").join(_values(M.InDegree(), graph).withColumnRenamed("value", "b"), "feature")
    return evaluate.concordance(rows, "a", "b").select(F.round("ccc", 9).alias("ccc"))


# simulation


@query("sample_er", None, f"WITH {_RANDOM} SELECT graph_id, src, dst FROM r")
def sample_er(spark, d):
    return _random(spark).edges


@query("sample_independent", _TRADE, f"SELECT g AS graph_id, src, dst FROM range(20) t(g), y WHERE CAST('0x' || substr(md5('{SEED}|' || g || '|' || src || '|' || dst), 1, 8) AS BIGINT) < {_P} * 4294967296")
def sample_independent(spark, d):
    return _fixed(spark, d).simulate(20, SEED)


@query("sample_dyads", _TRADE, f"""
, drawn AS (SELECT g, src, dst, CAST('0x' || substr(md5('{SEED}|' || g || '|' || src || '|' || dst), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM range(20) t(g), pairs),
s AS (SELECT *, CASE WHEN u < 1 / {_Z} THEN 0 WHEN u < (1 + {_W1}) / {_Z} THEN 1 WHEN u < (1 + 2 * {_W1}) / {_Z} THEN 2 ELSE 3 END AS state FROM drawn)
SELECT g AS graph_id, src, dst FROM s WHERE state IN (1, 3) UNION ALL SELECT g, dst, src FROM s WHERE state IN (2, 3)""")
def sample_dyads(spark, d):
    return _fixed_pairs(spark, d).simulate(20, SEED)


@query("sample_unique", None, f"""
WITH r AS (SELECT g AS graph_id, CAST(i AS INTEGER) AS src, CAST(j AS INTEGER) AS dst FROM range(40) t(g), range(3) a(i), range(3) b(j) WHERE i <> j AND CAST('0x' || substr(md5('{SEED}|' || g || '|' || i || '|' || j), 1, 8) AS BIGINT) < 0.5 * 4294967296),
h AS (SELECT g, (SELECT coalesce(string_agg(src || '-' || dst, ',' ORDER BY src, dst), '') FROM r WHERE graph_id = g) AS h FROM range(40) t(g)),
k AS (SELECT min(g) AS g FROM h GROUP BY h), n AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS new FROM k)
SELECT new AS graph_id, src, dst FROM n JOIN r ON r.graph_id = n.g WHERE new < 20""")
def sample_unique(spark, d):
    p = D.grid(spark, 3).select("src", "dst", F.lit(0.5).alias("p"))
    return sampling.sample_unique(lambda first, size: sampling.sample_independent(p, size, SEED, first), spark, 20)


@query("unique_graphs", None, f"""
WITH r AS (SELECT g AS graph_id, CAST(i AS INTEGER) AS src, CAST(j AS INTEGER) AS dst FROM range(200) t(g), range(3) a(i), range(3) b(j) WHERE i <> j AND CAST('0x' || substr(md5('{SEED}|' || g || '|' || i || '|' || j), 1, 8) AS BIGINT) < 0.5 * 4294967296)
SELECT min(g) AS graph_id FROM (SELECT g, (SELECT coalesce(sum(1 << (5 - (src * 2 + dst - CASE WHEN dst > src THEN 1 ELSE 0 END))), 0) FROM r WHERE graph_id = g) AS code FROM range(200) t(g)) GROUP BY code""")
def unique_graphs(spark, d):
    edges = random_graphs(spark, 3, True, 200, 0.5, SEED)
    return sampling.first_seen(edges, spark.range(200).select(F.col("id").alias("graph_id"))).select("graph_id")


@query("graph_codes", None, f"WITH {_RANDOM} SELECT graph_id, CAST(sum(1::BIGINT << (29 - (src * 5 + dst - CASE WHEN dst > src THEN 1 ELSE 0 END))) AS BIGINT) AS code FROM r GROUP BY graph_id")
def graph_codes(spark, d):
    return D.graph_code(_random(spark))


@query("graphs_from_codes", None, f"WITH {_RANDOM} SELECT graph_id, CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst FROM r")
def graphs_from_codes(spark, d):
    return D.graphs_from_codes(spark, D.graph_code(_random(spark)), 6)


@query("bootstrap_halves", _TRADE, f"""
, h AS (SELECT rep, node, row_number() OVER (PARTITION BY rep ORDER BY CAST('0x' || substr(md5('{SEED}|' || rep || '|' || node), 1, 8) AS BIGINT), node) <= 13 AS first FROM range(30) t(rep), nodes),
e AS (SELECT a.rep, src, dst, a.first FROM edges JOIN h a ON a.node = src JOIN h b ON b.node = dst AND a.rep = b.rep AND a.first = b.first),
s AS (SELECT rep, 0 AS f_idx, count(*) * (25.0 * 24 / (13 * 12)) AS value FROM e WHERE first GROUP BY rep
UNION ALL SELECT a.rep, 1, count(*) * (25.0 * 24 / (13 * 12)) FROM e a JOIN e b ON a.rep = b.rep AND a.src = b.dst AND a.dst = b.src WHERE a.first AND b.first AND a.src < a.dst GROUP BY a.rep
UNION ALL SELECT rep, CAST(2 + src AS INTEGER), count(*) * 24.0 / CASE WHEN first THEN 12 ELSE 11 END FROM e GROUP BY rep, src, first)
SELECT k.rep, CAST(f.f AS INTEGER) AS f_idx, round(CAST(coalesce(value, 0) AS DOUBLE), 6) AS value FROM range(30) k(rep) CROSS JOIN range(27) f(f) LEFT JOIN s ON s.rep = k.rep AND s.f_idx = f.f""")
def bootstrap_halves(spark, d):
    graph = S.trade_graph(spark, d)
    return Collection([M.Edges(), M.TotalReciprocity(), M.OutDegree()], graph).bootstrap(halves=split_nodes(graph, 30, SEED)).select("rep", "f_idx", F.round("value", 6).alias("value"))


# chains


def _chain(spark: SparkSession) -> DataFrame:
    stats = Collection([M.Edges(), M.TotalReciprocity()], _random(spark)).sample_statistics()
    return stats.select(F.col("graph_id").alias("t"), "f_idx", "value")


@query("cov_naive", None, f"WITH {_RANDOM} SELECT a.f, b.f AS g, round(covar_pop(a.v, b.v), 6) AS cov FROM chain a JOIN chain b USING (t) GROUP BY a.f, b.f")
def cov_naive(spark, d):
    return covariance.naive(_chain(spark)).select("f", "g", F.round("cov", 6).alias("cov"))


@query("cov_batch", None, f"WITH {_RANDOM}, m AS (SELECT t // 5 AS k, f, avg(d) AS d FROM dev GROUP BY 1, 2) SELECT a.f, b.f AS g, round(5 * avg(a.d * b.d), 6) AS cov FROM m a JOIN m b USING (k) GROUP BY a.f, b.f")
def cov_batch(spark, d):
    return covariance.batch(_chain(spark), SAMPLES, 7).select("f", "g", F.round("cov", 6).alias("cov"))


@query("autocov_lag", None, f"WITH {_RANDOM} SELECT a.f, b.f AS g, round(sum(a.d * b.d) / {SAMPLES}, 5) AS cov FROM dev a JOIN dev b ON b.t = a.t + 3 GROUP BY a.f, b.f")
def autocov_lag(spark, d):
    return covariance.autocovariance(_chain(spark), 3).select("f", "g", F.round("cov", 5).alias("cov"))


@query("cov_initial_sequence")
def cov_initial_sequence(spark, d):
    found = covariance.covariance(_chain(spark), SAMPLES, 2, "multivariate_initial_sequence")
    return spark.createDataFrame([(i, j, float(found[i, j])) for i in range(2) for j in range(2)], "f int, g int, cov double")


@query("diag_quantiles", None, f"WITH {_RANDOM} SELECT f AS f_idx, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS q1, round(quantile_cont(v, 0.25), 6) AS q2, round(quantile_cont(v, 0.5), 6) AS q3, round(quantile_cont(v, 0.75), 6) AS q4, round(quantile_cont(v, 0.975), 6) AS q5 FROM chain GROUP BY f")
def diag_quantiles(spark, d):
    found = evaluate.diagnostics(_chain(spark))
    return found.select("f_idx", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *[F.round(F.col("quantiles")[k], 6).alias(f"q{k + 1}") for k in range(5)])


@query("diag_trace", None, f"WITH {_RANDOM} SELECT t, f AS f_idx, v - first_value(v) OVER (PARTITION BY f ORDER BY t) AS value FROM chain")
def diag_trace(spark, d):
    chain = _chain(spark)
    found = evaluate.diagnostics(chain, chain.where("t = 0").select("f_idx", "value"))
    return found.select("f_idx", F.posexplode("trace").alias("t", "value")).select(F.col("t").cast("long"), "f_idx", "value")


@query("gradient_window", None, f"WITH {_RANDOM} SELECT t, f AS f_idx, round(avg(v) OVER (PARTITION BY f ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean FROM chain")
def gradient_window(spark, d):
    over = Window.partitionBy("f_idx").orderBy("t").rowsBetween(-9, 0)
    return _chain(spark).select("t", "f_idx", F.round(F.avg("value").over(over), 6).alias("mean"))


@query("resample_means", None, f"WITH {_RANDOM}, p AS (SELECT i // 25 AS rep, CAST(floor(CAST('0x' || substr(md5('{SEED}|' || (i // 25) || '|' || (i % 25)), 1, 8) AS BIGINT) * {SAMPLES} / 4294967296) AS BIGINT) AS t FROM range(250) r(i)) SELECT rep, f AS f_idx, round(avg(v), 6) AS mean FROM p JOIN chain USING (t) GROUP BY rep, f")
def resample_means(spark, d):
    return convergence.resample(_chain(spark), SAMPLES, 10, 25, SEED).groupBy("rep", "f_idx").agg(F.round(F.avg("value"), 6).alias("mean"))


def _outcome(spark: SparkSession, result) -> DataFrame:
    return spark.createDataFrame([(result.success, result.statistic, result.threshold)], "success boolean, statistic double, threshold double")


def _moments(spark: SparkSession):
    import numpy as np

    chain = _chain(spark)
    mean = np.array([r[0] for r in chain.groupBy("f_idx").agg(F.avg("value").alias("m")).orderBy("f_idx").select("m").collect()])
    return chain, mean, covariance.covariance(chain, SAMPLES, 2)


@query("conv_hotelling")
def conv_hotelling(spark, d):
    _, mean, cov = _moments(spark)
    return _outcome(spark, convergence.hotelling(spark, mean + 0.1, mean, cov, SAMPLES))


@query("conv_zero_grad_norm")
def conv_zero_grad_norm(spark, d):
    _, mean, _ = _moments(spark)
    return _outcome(spark, convergence.zero_gradient([mean - 15, mean - 14.5], 2))


@query("conv_model_bootstrap")
def conv_model_bootstrap(spark, d):
    chain, mean, _ = _moments(spark)
    return _outcome(spark, convergence.model_bootstrap(mean, chain, SAMPLES, 20, 100, seed=SEED))


@query("conv_observed_bootstrap")
def conv_observed_bootstrap(spark, d):
    chain, mean, _ = _moments(spark)
    boot = Collection([M.Edges(), M.TotalReciprocity()], S.monastery(spark)).bootstrap(100, SEED)
    return _outcome(spark, convergence.observed_bootstrap(mean, boot, chain, SAMPLES, 20, 100, seed=SEED))


# small graphs, whole distributions

_ENUM = f"WITH g AS (SELECT c, bit_count(c) AS e, ((c >> 5) & (c >> 3) & 1) + ((c >> 4) & (c >> 1) & 1) + ((c >> 2) & c & 1) AS m FROM range(64) t(c)), w AS (SELECT *, exp({THETA_EDGES} * e + {THETA_MUTUAL} * m) AS w FROM g)"


def _small(spark: SparkSession) -> Collection:
    return Collection([M.Edges(), M.TotalReciprocity()], S.graph_from_edges(spark, 3, [(0, 1)]))


@query("enumerate_logz", None, f"{_ENUM} SELECT round(ln(sum(w)), 6) AS log_z FROM w")
def enumerate_logz(spark, d):
    return enumeration.log_partition(_small(spark), [THETA_EDGES, THETA_MUTUAL]).select(F.round("log_z", 6).alias("log_z"))


@query("enumerate_expected", None, f"{_ENUM} SELECT 'num_edges_directed' AS name, round(sum(w * e) / sum(w), 6) AS value FROM w UNION ALL SELECT 'total_reciprocity', round(sum(w * m) / sum(w), 6) FROM w")
def enumerate_expected(spark, d):
    return enumeration.expected(_small(spark), [THETA_EDGES, THETA_MUTUAL]).select("name", F.round("value", 6).alias("value"))


@query("collinearity_removed")
def collinearity_removed(spark, d):
    graph = S.graph_from_edges(spark, 8, [(0, 1), (1, 2)], types=list("AABBBCCC"))
    gone = Collection([M.Edges(), M.TypePairs(), M.OutDegree(), M.InDegree()], graph).fix_collinearity(300, SEED)
    return spark.createDataFrame(list(enumerate(gone)), "step int, name string")


@query("feature_names", None, "SELECT * FROM (VALUES (0, 'num_edges_directed', FALSE), (1, 'in_indegree_2', FALSE), (2, 'in_indegree_3', FALSE), (3, 'num_edges_between_types_directed_A__A', FALSE), (4, 'num_edges_between_types_directed_A__B', FALSE), (5, 'num_edges_between_types_directed_B__B', FALSE), (0, 'in_indegree_1', TRUE), (1, 'num_edges_between_types_directed_B__A', TRUE)) t(place, name, ignored)")
def feature_names(spark, d):
    model = Collection([M.Edges(), M.InDegree(name="in", ignore=(0,)), M.TypePairs(ignore=(2,))], S.graph_from_edges(spark, 3, [(0, 1)], types=list("ABB")))
    return spark.createDataFrame([(k, n, False) for k, n in enumerate(model.names())] + [(k, n, True) for k, n in enumerate(model.ignored())], "place int, name string, ignored boolean")


@query("influence_sum", _TRADE, """
, v AS (SELECT dyad_idx, 1 / 1.0 + CASE WHEN src > 0 THEN 1 / ((SELECT count(*) FROM dyads WHERE src = 1) / 600.0) ELSE 0 END AS s FROM dyads)
SELECT dyad_idx, round(s / (SELECT sum(s) FROM v), 9) AS p FROM v""")
def influence_sum(spark, d):
    model = Collection([M.Edges(), M.OutDegree(ignore=(0,))], S.trade_graph(spark, d))
    return sampling.influence(model).select("dyad_idx", F.round("p", 9).alias("p"))


@query("influence_softmax", _TRADE, """
, v AS (SELECT dyad_idx, exp(1 + CASE WHEN src > 0 THEN 25 ELSE 0 END - 26.0) AS s FROM dyads)
SELECT dyad_idx, round(s / (SELECT sum(s) FROM v), 9) AS p FROM v""")
def influence_softmax(spark, d):
    model = Collection([M.Edges(), M.OutDegree(ignore=(0,))], S.trade_graph(spark, d))
    return sampling.influence(model, Proposal.INFLUENCE_SOFTMAX).select("dyad_idx", F.round("p", 9).alias("p"))


@query("mh_sample")
def mh_sample(spark, d):
    model = GraphModel(S.monastery(spark), [M.Edges(), M.TotalReciprocity()], theta=[-1.76, 2.32])
    return model.simulate(80, SEED, "metropolis_hastings", burn_in=2000, thin=200).groupBy("graph_id", "chain_id").agg(F.count("src").alias("edges"))


@query("mh_sample_unique")
def mh_sample_unique(spark, d):
    model = GraphModel(S.monastery(spark), [M.Edges(), M.TotalReciprocity()], theta=[-1.76, 2.32])
    return model.simulate(40, SEED, "metropolis_hastings", replace=False, burn_in=500, thin=50, proposal="features_influence_sum").groupBy("graph_id").agg(F.count("src").alias("edges"))


def _monte_carlo(spark, graph) -> DataFrame:
    """name, theta of the exact fit of edges and mutual ties, and near: the Monte-Carlo fit converged within 0.15 of it.

    The Monte-Carlo fit does not start from the pseudo-likelihood, which is exact for this model; it
    has 500 graphs a step and at most 20 steps.
    """
    metrics = [M.Edges(), M.TotalReciprocity()]
    exact, sampled = GraphModel(graph, metrics), GraphModel(graph, metrics, seed=3)
    exact.fit("mple_reciprocity")
    result = sampled.fit("mcmle", start_from_mple=False, steps=20, rate=0.5, cov_method="naive", count=500, burn_in=20 * graph.n**2, thin=300, distance=0.25)
    found = sampled.parameters()
    return spark.createDataFrame([(k, round(t, 5), bool(result.success and abs(found[k] - t) < 0.15)) for k, t in exact.parameters().items()], "name string, theta double, near boolean")


@query("mcmle_fit", _TRADE, """
, c AS (SELECT CAST(count(*) FILTER (state IN (1, 2)) AS DOUBLE) AS a, CAST(count(*) FILTER (state = 3) AS DOUBLE) AS m, CAST(count(*) FILTER (state = 0) AS DOUBLE) AS z FROM pairs)
SELECT 'num_edges_directed' AS name, round(ln(a / (2 * z)), 5) AS theta, TRUE AS near FROM c UNION ALL SELECT 'total_reciprocity', round(ln(m / z) - 2 * ln(a / (2 * z)), 5), TRUE FROM c""")
def mcmle_fit(spark, d):
    return _monte_carlo(spark, S.trade_graph(spark, d))


# fixed values: closed form of the bundled graph, 93 empty, 32 one-way and 28 mutual pairs
@query("mcmle_monastery", None, """
SELECT 'num_edges_directed' AS name, round(ln(32 / (2 * 93.0)), 5) AS theta, TRUE AS near UNION ALL SELECT 'total_reciprocity', round(ln(28 / 93.0) - 2 * ln(32 / (2 * 93.0)), 5), TRUE""")
def mcmle_monastery(spark, d):
    return _monte_carlo(spark, S.monastery(spark))


@query("mcmle_triads")
def mcmle_triads(spark, d):
    """The first three steps of a Monte-Carlo fit of edges and cyclic triads, which has no closed form."""
    model = GraphModel(S.monastery(spark), [M.Edges(), M.Triangles(True)], fix_collinearity=False, seed=3)
    model.fit("mcmle", steps=3, count=60, burn_in=1500, thin=80, reps=20, size=100)
    return spark.createDataFrame(list(model.parameters().items()), "name string, theta double")


@query("stream_activity", None, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def stream_activity(spark, d):
    return windowed_activity(spark.read.parquet(f"{d}/events.parquet"))
