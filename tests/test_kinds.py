import numpy as np
import pytest

from dyadspark.model import GraphModel
from dyadspark.operators import metrics as M
from dyadspark.operators.collection import Collection
from dyadspark.operators.fit import compress, fit_mple
from dyadspark.sources.graphs import graph_from_edges

TYPES, ATTRS = list("ABABCAB"), [1, 2, 1, 2, 1, 1, 2]
EDGES = [(0, 0, 1), (0, 1, 0), (0, 2, 5), (0, 6, 3), (1, 0, 1), (1, 4, 2), (1, 5, 6), (0, 3, 4)]


def whole(rows):
    return sorted((tuple((e["f"], e["v"]) for e in r["x"]), pytest.approx(r["w"]), pytest.approx(r["wy"])) for r in compress(rows).collect())


@pytest.mark.parametrize("metrics", [
    [M.Edges()], [M.OutDegree()], [M.InDegree()], [M.TypePairs()], [M.Edges(), M.OutDegree(ignore=(0,))], [M.Edges(), M.AttributeSum(), M.TypePairs(ignore=(0,))],
    [M.AttributeSumOut(), M.InDegree(ignore=(3,))], [M.SumDistances(), M.AttributeSumIn()],
], ids=str)
def test_kinds_sum_up_to_the_dyads(spark, metrics):
    model = Collection(metrics, graph_from_edges(spark, 7, EDGES, types=TYPES, attrs=ATTRS, positions=[float(x) for x in ATTRS], count=2))
    kinds = model.kind_rows()
    if kinds is not None:
        assert whole(kinds) == whole(model.design_rows())
    theta = np.linspace(-1, 1, len(model.features())).tolist()
    m = GraphModel(model.graph, metrics, theta=theta)
    sums = {r["src"]: r["s"] for r in m.predict().groupBy("src").agg({"p": "sum"}).withColumnRenamed("sum(p)", "s").collect()}
    assert {r["node"]: r["expected"] for r in m.expected_degrees().collect()} == pytest.approx(sums)


def test_a_metric_of_ones_own_is_not_told_by_its_ends():
    class Odd(M.Edges):
        def design(self, graph, cells):
            return super().design(graph, cells).where("src < dst")

    class Far(M.AttributeSum):
        def weight(self):
            return super().weight() * 2

    assert Odd.ends() is None and Far.ends() is None and M.Edges.ends() == ((), ())
    assert M.TotalReciprocity.ends() is None and M.Triangles.ends() is None


def test_edges_of_many_nodes_are_fitted_without_their_dyads(spark):
    """10^10 dyads: no grid could be listed here."""
    n = 100_001
    graph = graph_from_edges(spark, 2, [(0, 1), (1, 0)])
    graph = graph.but(nodes=graph.nodes, n=n, count=1)
    assert fit_mple(Collection([M.Edges()], graph)).theta[0] == pytest.approx(np.log(2 / (n * (n - 1.0) - 2)), abs=1e-8)
