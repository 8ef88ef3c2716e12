"""Statistics and change scores of small graphs, worked out by hand or by toggling every dyad."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from dyadspark.functions import dyads as D
from dyadspark.operators import metrics as M
from dyadspark.operators.collection import Collection
from dyadspark.sources.graphs import graph_from_edges, graph_from_matrices, monastery, read_graph, write_graph


def matrix(rows):
    return [[int(c == "1") for c in row] for row in rows.split("/")]


def graph(spark, *rows, directed=True, **attributes):
    return graph_from_matrices(spark, [matrix(r) for r in rows], directed, **attributes)


def mask(spark, rows):
    return spark.createDataFrame([(i, j) for i, row in enumerate(matrix(rows)) for j, x in enumerate(row) if x], "src int, dst int")


def stats(metrics, g):
    rows = Collection(metrics, g).sample_statistics().collect()
    found = {(r["graph_id"], r["f_idx"]): r["value"] for r in rows}
    return [[found[k, f] for f in sorted({f for _, f in found})] for k in sorted({k for k, _ in found})]


AB = ["A", "B", "A", "B"]
LITERALS = [
    ([M.Edges()], ["010/101/100", "000/101/100"], {}, [[4], [3]]),
    ([M.Edges(False)], ["011/101/110"], {"directed": False}, [[3]]),
    ([M.Triangles(False)], ["011/101/110"], {"directed": False}, [[1]]),
    ([M.Triangles(True)], ["010/001/100"], {}, [[1]]),
    ([M.Triangles(True)], ["0111/0011/0001/0000"], {}, [[0]]),
    ([M.Triangles(True)], ["010000/001000/100000/000010/000001/000100"], {}, [[2]]),
    ([M.Reciprocity()], ["001/100/010", "001/100/110", "011/101/110"], {}, [[0, 0, 0], [0, 1, 0], [1, 1, 1]]),
    ([M.InDegree()], ["0101/1001/1101/1000"], {}, [[3, 2, 0, 3]]),
    ([M.OutDegree()], ["0101/1001/1101/1000"], {}, [[2, 2, 3, 1]]),
    ([M.UndirectedDegree()], ["0101/1001/0001/1110"], {"directed": False}, [[2, 2, 1, 3]]),
    ([M.TypePairs()], ["0100/1001/1100/0010", "0110/0001/1000/0110"], {"types": AB}, [[1, 2, 2, 1], [2, 1, 1, 2]]),
    ([M.TypePairs(False)], ["0110/1001/1000/0100"], {"types": AB, "directed": False}, [[1, 1, 1]]),
    ([M.SumDistances()], ["010/101/100"], {"positions": [(0, 0, 2), (0, 3, 2), (4, 0, 2)]}, [[15]]),
    ([M.SumDistances(False)], ["011/100/100"], {"positions": [(0, 0, 2), (0, 3, 2), (4, 0, 2)], "directed": False}, [[7]]),
    ([M.AttributeSum(), M.AttributeSumOut(), M.AttributeSumIn()], ["0110/0001/1000/0110"], {"attrs": [1, 2, 3, 4]}, [[30, 15, 15]]),
    ([M.AttributeSum(), M.AttributeSumOut(), M.AttributeSumIn()], ["010/101/100", "001/100/110", "000/100/010"], {"attrs": [2, 1, 1]}, [[11, 5, 6], [11, 5, 6], [5, 2, 3]]),
    ([M.Edges(), M.InDegree(ignore=(0,)), M.OutDegree(ignore=(0,)), M.TotalReciprocity()], ["0100/1001/1001/0110"], {}, [[7, 2, 1, 2, 2, 2, 2, 3]]),
]


@pytest.mark.parametrize("case", range(len(LITERALS)))
def test_statistics(spark, case):
    metrics, rows, options, want = LITERALS[case]
    assert stats(metrics, graph(spark, *rows, **options)) == want


def test_masked_statistics(spark):
    g = graph(spark, "010/101/100", "000/101/100")
    assert stats([M.Edges()], g.but(mask=mask(spark, "010/101/010"))) == [[3], [2]]
    g = graph(spark, "0100/1001/1100/0010", "0110/0001/1000/0110", types=AB)
    assert stats([M.TypePairs()], g.but(mask=mask(spark, "0100/1010/0000/1000"))) == [[0, 1, 1, 0], [0, 1, 0, 0]]
    g = graph(spark, "010/101/100", positions=[(0, 0, 2), (0, 3, 2), (4, 0, 2)])
    assert stats([M.SumDistances()], g.but(mask=mask(spark, "000/100/110"))) == [[7]]


def change(metrics, g, i, j):
    rows = Collection(metrics, g).change_scores().where((F.col("src") == i) & (F.col("dst") == j)).collect()
    found = {r["f_idx"]: r["change"] for r in rows}
    return [found.get(f, 0) for f in range(len(Collection(metrics, g).features()))]


def test_change_scores(spark):
    assert change([M.Triangles(False)], graph(spark, "011/101/110", directed=False), 0, 1) == [-1]
    assert change([M.Triangles(False)], graph(spark, "0001/0011/0101/1110", directed=False), 0, 1) == [1]
    assert change([M.Triangles(False)], graph(spark, "0101/1010/0101/1010", directed=False), 1, 3) == [2]
    cycle = graph(spark, "010/001/100")
    assert change([M.Triangles(True)], cycle, 0, 1) == [-1] and change([M.Triangles(True)], cycle, 1, 0) == [0]
    assert change([M.Edges(), M.Reciprocity()], graph(spark, "001/100/110"), 2, 0) == [-1, 0, -1, 0]
    typed = graph(spark, "0110/0001/1000/0100", types=AB)
    assert change([M.TypePairs(ignore=(0,))], typed, 0, 1) == [-1, 0, 0] and change([M.TypePairs(ignore=(0,))], typed, 0, 2) == [0, 0, 0]


DIRECTED = [M.Edges, M.InDegree, M.OutDegree, M.Reciprocity, M.TotalReciprocity, lambda: M.Triangles(True), M.TypePairs, M.SumDistances, M.AttributeSum, M.AttributeSumOut, M.AttributeSumIn]
UNDIRECTED = [lambda: M.Edges(False), M.UndirectedDegree, lambda: M.Triangles(False), lambda: M.TypePairs(False), lambda: M.SumDistances(False), lambda: M.AttributeSum(False)]


@pytest.mark.parametrize(("directed", "seed"), [(True, 1), (False, 2)])
def test_designs_are_what_toggling_gives(spark, directed, seed):
    """Every metric's own design against the base class's, which takes each dyad off and on."""
    rng = random.Random(seed)
    n = 5
    cells = [(i, j) for i in range(n) for j in range(n) if (i != j if directed else i < j)]
    g = graph_from_edges(spark, n, [c for c in cells if rng.random() < 0.5], directed, types=list("ABBCA"), attrs=[1, 2, 0.5, 3, -1], positions=[(k, k * k) for k in range(n)])
    for make in DIRECTED if directed else UNDIRECTED:
        metric = make()
        own = {(r["src"], r["dst"], r["local_idx"]): round(r["v"], 9) for r in metric.design(g, D.dyads(g)).collect() if r["v"]}
        plain = {(r["src"], r["dst"], r["local_idx"]): round(r["v"], 9) for r in M.Metric.design(metric, g, D.dyads(g)).collect() if abs(r["v"]) > 1e-12}
        assert own == plain, metric.title


class Stars(M.Metric):
    """A user's metric: pairs of edges that leave one node."""

    title, directed, dyad_independent, supports_mask = "out_stars", True, False, False

    def values(self, graph):
        degrees = graph.edges.groupBy("graph_id", "src").agg(F.count("*").alias("k"))
        return degrees.groupBy("graph_id").agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("double").alias("value")).select("graph_id", F.lit(0).alias("local_idx"), "value")


def test_a_metric_of_the_users_own(spark):
    g = graph(spark, "0111/0000/1001/0000")
    model = Collection([M.Edges(), Stars()], g)
    assert model.statistics() == [5, 4] and model.scheme() == "mcmle"
    scores = {(r["src"], r["dst"]): r["change"] for r in model.change_scores().where("f_idx = 1").collect()}
    assert scores[0, 1] == -2 and scores[2, 1] == 2 and (1, 0) not in scores


def test_designs_of_four_states(spark):
    model = Collection([M.Edges(), M.OutDegree(ignore=(0,)), M.InDegree(ignore=(0,)), M.TotalReciprocity()], graph(spark, "0100/1001/1001/0110"))
    found = {(r["src"], r["dst"], r["state"], r["f_idx"]): r["v"] for r in model.pair_design().collect()}
    assert {f: v for (s, d, state, f), v in found.items() if (s, d, state) == (0, 1, 3)} == {0: 2, 1: 1, 4: 1, 7: 1}
    assert {f: v for (s, d, state, f), v in found.items() if (s, d, state) == (1, 2, 1)} == {0: 1, 1: 1, 5: 1}
    assert {f: v for (s, d, state, f), v in found.items() if (s, d, state) == (1, 2, 2)} == {0: 1, 2: 1, 4: 1}


def test_states_indices_and_codes(spark):
    g = graph(spark, "0100/1001/1001/0110")
    assert [r["state"] for r in D.dyad_states(g).orderBy("src", "dst").collect()] == [3, 2, 0, 0, 3, 3]
    assert [D.index_to_pair(k, 4) for k in (7, 0, 5, 11)] == [(2, 1), (0, 1), (1, 3), (3, 2)]
    with pytest.raises(IndexError):
        D.index_to_pair(13, 4)
    assert D.nodes_of_dyads(12) == 4 and D.nodes_of_dyads(6, False) == 4
    with pytest.raises(ValueError):
        D.nodes_of_dyads(11)
    for directed in (True, False):
        cells = D.grid(spark, 5, directed).orderBy("dyad_idx").collect()
        assert [D.index_to_pair(k, 5, directed) for k in range(len(cells))] == [(r["src"], r["dst"]) for r in cells]


def test_bootstrap_of_given_halves(spark):
    def boot(metrics, rows, first, directed=True):
        g = graph(spark, rows, directed=directed)
        halves = spark.createDataFrame([(0, i, 0 if i in first else 1) for i in range(4)], "rep long, node int, half int")
        return [r["value"] for r in Collection(metrics, g).bootstrap(halves=halves).orderBy("f_idx").collect()]

    rows = "0100/1001/1001/0110"
    assert boot([M.Edges()], rows, {2, 3}) == [12] and boot([M.TotalReciprocity()], rows, {2, 3}) == [6] and boot([M.TotalReciprocity()], rows, {0, 2}) == [0]
    assert boot([M.UndirectedDegree()], "0100/1001/0001/0110", {0, 2}, False) == [0, 3, 0, 3]


def test_collinear_features_go(spark):
    types = [int(x) for x in "330000131130320331"]

    def removed(metrics, n=18, kinds=None, attrs=None):
        g = graph_from_edges(spark, n, [(0, 1)], types=kinds, attrs=attrs)
        return Collection(metrics, g).fix_collinearity(1000, 3)

    assert len(removed([M.Edges(), M.Edges()])) == 1
    assert removed([M.Edges(), M.TotalReciprocity(), M.InDegree()]) == ["indegree_1"]
    assert removed([M.InDegree()]) == [] and removed([M.InDegree(), M.OutDegree()]) == ["indegree_1"]
    assert len(removed([M.AttributeSum(), M.AttributeSumOut(), M.AttributeSumIn()], 6, None, [1, 2, 3, 4, 5, 7])) == 1
    assert removed([M.Edges(), M.TypePairs()], 6, list("AAABBB"))[0].endswith("A__A")
    assert len(removed([M.Edges(), M.TypePairs()], 18, ["ABCD"[t] for t in types])) == 2


def test_names(spark):
    model = Collection([M.Edges(), M.InDegree(ignore=(0,)), M.TypePairs()], graph(spark, "010/001/100", types=list("ABB")))
    assert model.names()[:3] == ["num_edges_directed", "indegree_2", "indegree_3"] and model.names()[4] == "num_edges_between_types_directed_A__B" and model.ignored() == ["indegree_1"]
    twins = Collection([M.Edges(), M.Edges()], graph(spark, "010/001/100"))
    assert len(set(twins.names())) == 2


def test_what_models_refuse(spark):
    g = graph(spark, "010/001/100")
    with pytest.raises(ValueError):
        Collection([M.Edges(False)], g)
    with pytest.raises(ValueError):
        Collection([M.Edges(name="a"), M.Edges(name="a")], g)
    with pytest.raises(ValueError):
        Collection([M.TotalReciprocity()], g.but(mask=mask(spark, "010/001/100")))
    with pytest.raises(ValueError):
        graph(spark, "010/000/100", "01/10")
    with pytest.raises(ValueError):
        graph_from_matrices(spark, [[[0, 2], [0, 0]]])
    with pytest.raises(ValueError):
        graph(spark, "010/000/000", directed=False)
    with pytest.raises(NotImplementedError):
        Collection([M.Reciprocity(), M.TypePairs()], graph(spark, "010/001/100", types=list("ABB"))).bootstrap(3)


def test_the_monastery_and_files(spark, tmp_path):
    g = monastery(spark)
    write_graph(g, str(tmp_path / "g"))
    for x in (g, read_graph(spark, str(tmp_path / "g"))):
        assert stats([M.Edges(), M.TotalReciprocity(), M.Triangles(True)], x) == [[88, 28, 39]]
    assert stats([M.InDegree()], g) == [[11, 10, 3, 5, 8, 2, 6, 5, 4, 2, 3, 7, 5, 6, 3, 3, 2, 3]]
    assert stats([M.Edges(False), M.Triangles(False)], monastery(spark, False)) == [[60, 57]]


def test_graph_hash_tells_graphs_apart(spark):
    graphs = [list(x) for x in itertools.product([0, 1], repeat=2)]
    g = graph_from_matrices(spark, [[[0, a], [b, 0]] for a, b in [*graphs, graphs[1]]])
    hashes = {r["graph_id"]: r["hash"] for r in D.graph_hash(g.edges).collect()}
    assert hashes[1] == hashes[4] and len({hashes[k] for k in (1, 2, 3)}) == 3
