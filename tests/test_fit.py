import math

import numpy as np
import pytest

from dyadspark.functions.dyads import dyad_states
from dyadspark.model import GraphModel
from dyadspark.operators import metrics as M
from dyadspark.operators.collection import Collection
from dyadspark.operators.fit import THETA_CAP, fit_dyads, fit_mple, pair_rows
from dyadspark.sources.graphs import graph_from_matrices, monastery, read_graph, write_graph


def test_more_kinds_of_pairs_than_the_limit_are_fitted_by_sums(spark):
    model = GraphModel(monastery(spark), [M.Edges(), M.TotalReciprocity()]).collection
    few, many = fit_dyads(model), fit_dyads(model, limit=0)
    assert many.result.success and np.allclose(many.theta, few.theta, atol=1e-7)


EMPTY = [[0, 0, 0]] * 3
ONE = [[0, 1, 0], [0, 0, 0], [0, 0, 0]]


@pytest.mark.parametrize("sample", [[EMPTY, ONE], [ONE, EMPTY], [EMPTY, ONE, EMPTY, EMPTY]])
def test_graphs_without_edges_count(spark, tmp_path, sample):
    write_graph(graph_from_matrices(spark, sample), str(tmp_path / "g"))
    for graph in (graph_from_matrices(spark, sample), read_graph(spark, str(tmp_path / "g"))):
        k = len(sample)
        assert graph.graphs == k and dyad_states(graph).count() == 3 * k
        rows = {(r["src"], r["dst"]): [r[f"y{s}"] for s in range(4)] for r in pair_rows(Collection([M.Edges(), M.TotalReciprocity()], graph)).collect()}
        assert rows == {(0, 1): pytest.approx([1 - 1 / k, 1 / k, 0, 0]), (0, 2): [1, 0, 0, 0], (1, 2): [1, 0, 0, 0]}
        theta = fit_mple(Collection([M.Edges()], graph)).theta[0]
        assert theta == pytest.approx(math.log(1 / (6 * k - 1)), abs=1e-8)


def test_a_sparse_sample_gives_back_its_parameter(spark):
    model = GraphModel(graph_from_matrices(spark, [ONE]), [M.Edges()], theta=[-4.0])
    sample = model.simulated(3000)
    assert sample.graphs == 3000
    assert fit_mple(Collection([M.Edges()], sample)).theta[0] == pytest.approx(-4.0, abs=0.2)


def test_features_that_no_row_ties_are_fitted_apart(spark):
    """As by one matrix: those with all or no edges stop at the bound, features of zero do not move, tied ones share a matrix."""
    graph = graph_from_matrices(spark, [[[0, 1, 0, 0], [0, 0, 0, 0], [1, 1, 0, 1], [1, 0, 1, 0]]])
    alone = fit_mple(Collection([M.OutDegree()], graph))
    assert not alone.result.success and np.allclose(alone.theta, [-math.log(2), -THETA_CAP, THETA_CAP, math.log(2)], atol=1e-6)
    tied, summed = (fit_mple(Collection([M.OutDegree(ignore=(1, 2)), M.AttributeSumOut(ignore=(0,))], graph), limit=limit) for limit in (100, 0))
    assert np.allclose(tied.theta, summed.theta, atol=1e-8)
    both = [fit_mple(Collection([M.Edges(), M.OutDegree(ignore=(0, 1, 2))], graph), limit=limit).theta for limit in (100, 0)]
    assert np.allclose(*both, atol=1e-8)
