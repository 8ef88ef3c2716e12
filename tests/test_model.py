"""Fits, likelihoods, samples and convergence against closed forms and whole distributions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadspark.functions import scalar
from dyadspark.functions.dyads import grid
from dyadspark.model import GraphModel
from dyadspark.operators import convergence, covariance, enumeration, evaluate, fit, sampling
from dyadspark.operators import metrics as M
from dyadspark.operators.collection import Collection, random_graphs
from dyadspark.sources.graphs import graph_from_edges, monastery
from tests.test_metrics import graph

#: Published Monte-Carlo estimates of the model with all senders, receivers and mutual ties: fixed values.
P1 = (
    "-1.1761 -0.2945 1.4141 0.3662 0.1315 1.2148 0.6055 1.3609 0.6402 2.0639 1.4355 -0.1681 -0.2322 0.5841 1.8600 1.4317 1.2211 1.8724 "
    "-0.1522 -3.0453 -1.7596 -0.8198 -3.3922 -1.6074 -2.2656 -2.2069 -3.9189 -3.0257 -0.9457 -1.4749 -1.5950 -3.3147 -3.0567 -3.4436 -3.3239 3.6918"
)


def logit(p):
    return math.log(p / (1 - p))


def model(g, *metrics, theta=None):
    return GraphModel(g, list(metrics), theta=theta, fix_collinearity=False)


def ccc(a, b):
    a, b = np.array(a), np.array(b)
    return 2 * np.cov(a, b, bias=True)[0, 1] / (a.var() + b.var() + (a.mean() - b.mean()) ** 2)


def test_closed_forms(spark):
    m = model(monastery(spark), M.Edges())
    assert m.fit().success and m.theta == pytest.approx([-0.9071582482], abs=1e-7)
    assert m.log_likelihood().first()[0] == pytest.approx(-183.5914778, abs=1e-5) and m.entropy().first()[0] == pytest.approx(264.8665146, abs=1e-5)
    m = model(monastery(spark), M.Edges(), M.TotalReciprocity())
    assert m.fit().success and m.theta == pytest.approx([-1.7600107709, 2.3196265588], abs=1e-6)
    m = model(graph(spark, "0111/1000/0000/0000"), M.Edges())
    m.fit()
    assert m.theta == pytest.approx([logit(4 / 12)], abs=1e-6)
    m = model(graph(spark, "0100/1000/0000/0000"), M.TotalReciprocity())
    m.fit()
    assert m.theta == pytest.approx([math.log(0.6)], abs=1e-6)
    m = model(graph(spark, "0001/1000/0000/1010", types=list("AABB")), M.TypePairs())
    m.fit()
    assert [1 / (1 + math.exp(-t)) for t in m.theta] == pytest.approx([0.5, 0.25, 0.25, 0.5], abs=1e-6)


def test_senders_receivers_and_mutual_ties(spark):
    m = model(monastery(spark), M.Edges(), M.OutDegree(ignore=(0,)), M.InDegree(ignore=(0,)), M.TotalReciprocity())
    assert m.fit().success
    assert ccc(m.theta, [float(x) for x in P1.split()]) > 0.99
    assert m.theta[0] == pytest.approx(-1.1923710, abs=1e-4) and m.theta[-1] == pytest.approx(3.6996253, abs=1e-4)


def test_masks_are_weights_of_zero_and_constant_weights_change_nothing(spark):
    g = graph_from_edges(spark, 8, [(i, (3 * i + 1) % 8) for i in range(8)] + [(0, 5), (2, 6), (7, 1)], positions=list(range(8)))
    cells = grid(spark, 8).where("(src + 2 * dst) % 3 <> 0").select("src", "dst")
    zero = grid(spark, 8).where("(src + 2 * dst) % 3 = 0").select("src", "dst", F.lit(0.0).alias("w"))
    five = grid(spark, 8).select("src", "dst", F.lit(5.0).alias("w"))

    def theta(x):
        m = model(x, M.Edges(), M.SumDistances())
        m.fit()
        return m.theta

    assert theta(g.but(mask=cells)) == pytest.approx(theta(g.but(weights=zero)), abs=1e-6)
    assert theta(g.but(weights=five)) == pytest.approx(theta(g), abs=1e-6)
    with pytest.raises(NotImplementedError):
        model(g.but(weights=five), M.Edges(), M.TotalReciprocity()).fit()
    with pytest.raises(ValueError):
        model(g.but(weights=five.withColumn("w", -F.col("w"))), M.Edges()).fit()


def test_compressed_and_distributed_newton_agree(spark):
    g = monastery(spark)
    c = Collection([M.Edges(), M.OutDegree(ignore=(0,))], g)
    assert fit.fit_mple(c, limit=2).theta == pytest.approx(fit.fit_mple(c).theta, abs=1e-6)


def test_separation_is_no_success(spark):
    m = model(graph(spark, "0000/0000/0000/0000"), M.Edges())
    assert not m.fit().success and abs(m.theta[0]) <= fit.THETA_CAP + 1e-9


def test_parameters(spark):
    g = graph(spark, "010/001/100")
    m = GraphModel(g, [M.Edges(), M.OutDegree()], theta={"num_edges_directed": 0.5, "outdegree_2": -1.0})
    assert m.parameters() == {"num_edges_directed": 0.5, "outdegree_2": -1.0} and "outdegree_1" in m.ignored_features() and "num_edges_directed" in m.summary()
    with pytest.raises(ValueError):
        m.set_parameters({"nothing": 1.0})
    with pytest.raises(ValueError):
        GraphModel(g, [M.Edges()], theta=[1.0, 2.0])
    with pytest.raises(NotImplementedError):
        model(g, M.Edges(), M.Triangles(True), theta=[0.1, 0.1]).log_likelihood()
    with pytest.raises(ValueError):
        model(g, M.Edges(), theta=[0.0]).diagnostics()


def test_entropies(spark):
    def bits(p, n):
        return evaluate.dyad_entropy(spark.createDataFrame([(p,)] * n, "p double")).first()[0]

    assert (bits(0.5, 6), bits(0.5, 3)) == (6.0, 3.0) and bits(0.1, 12) == pytest.approx(5.628, abs=1e-3) == bits(0.9, 12)
    pairs = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0), (0.5, 0.5, 0.0, 0.0), (0.25,) * 4], "p0 double, p1 double, p2 double, p3 double")
    assert evaluate.pair_entropy(pairs).first()[0] == pytest.approx(3, abs=1e-6)


def test_covariances(spark):
    def chain(rows):
        g = graph(spark, *rows)
        return Collection([M.Edges(), M.TotalReciprocity()], g).sample_statistics().select(F.col("graph_id").alias("t"), "f_idx", "value")

    x = chain(["010/001/110", "010/100/010", "001/001/110", "001/101/110", "001/100/100", "001/101/100"])
    assert covariance.covariance(x, 6, 2, "naive") == pytest.approx(np.array([[17, 8], [8, 8]]) / 36)
    assert covariance.covariance(x, 6, 2, "batch", 3) == pytest.approx(np.full((2, 2), 4 / 9))
    x = chain(["000/001/100", "010/000/110", "011/001/100", "010/000/010", "010/001/110", "011/100/110"])
    assert covariance.covariance(x, 6, 2, "multivariate_initial_sequence") == pytest.approx(np.array([[264, 192], [192, 144]]) / 216)
    with pytest.raises(ValueError):
        covariance.covariance(x, 6, 2, "other")


def test_criteria(spark):
    assert convergence.zero_gradient([np.array([10.0]), np.array([0.0])], 2).statistic == 5
    same = np.array([1.0, 2.0])
    assert convergence.hotelling(spark, same, same, np.eye(2), 100).success
    assert math.isnan(convergence.hotelling(spark, same, same, np.zeros((2, 2)), 100).statistic)
    assert convergence.f_quantile(spark, 0.5, 3, 97) == pytest.approx(0.79424, abs=1e-4)
    flat = spark.createDataFrame([(t, 0, 1.0) for t in range(20)], "t long, f_idx int, value double")
    result = convergence.model_bootstrap(np.array([1.0]), flat, 20, 5, 10)
    assert not result.success and math.isnan(result.statistic)


def test_enumeration_and_its_sampler(spark):
    c = Collection([M.Edges()], graph(spark, "010/001/100"))
    assert enumeration.log_partition(c, [-0.5]).first()[0] == pytest.approx(6 * math.log(1 + math.exp(-0.5)))
    assert enumeration.expected(c, [-0.5]).first()["value"] == pytest.approx(6 / (1 + math.exp(0.5)))
    assert enumeration.exact_sample(c, [-0.5], 50, 1).count() == 50
    with pytest.raises(ValueError):
        enumeration.all_graphs(spark, 6)


def test_multi_graph_fit_against_the_whole_distribution(spark):
    g = graph(spark, "010/001/000").but(edges=random_graphs(spark, 3, True, 60, 0.4, 5))
    m = model(g, M.Edges())
    m.fit()
    observed = g.edges.count() / 60
    assert enumeration.expected(m.collection, m.theta).first()["value"] == pytest.approx(observed, abs=1e-5)


def test_chains_follow_the_whole_distribution(spark):
    theta = [-0.4, 0.7]
    m = model(graph(spark, "010/001/100"), M.Edges(), M.Triangles(True), theta=theta)
    want = {r["f_idx"]: r["value"] for r in enumeration.expected(m.collection, theta).collect()}
    drawn = m.simulate(4000, 3, "metropolis_hastings", burn_in=200, thin=8).where("src IS NOT NULL").select("graph_id", "src", "dst")
    got = {r["f_idx"]: r["v"] for r in m._sampled(drawn, 4000).groupBy("f_idx").agg(F.avg("value").alias("v")).collect()}
    assert got[0] == pytest.approx(want[0], abs=0.12) and got[1] == pytest.approx(want[1], abs=0.06)


class Stars(M.Metric):
    """Pairs of edges from one node, told to chains by the metric itself."""

    title, directed, dyad_independent = "stars", True, False

    def values(self, graph):
        degree = graph.edges.groupBy("graph_id", "src").agg(F.count("*").alias("d"))
        return degree.groupBy("graph_id").agg(F.sum(F.expr("d * (d - 1) / 2")).alias("value")).select("graph_id", F.lit(0).alias("local_idx"), "value")

    def chain_change(self, y, i, j):
        return {0: float(y[i].sum())}


@pytest.mark.parametrize("metric, theta", [(M.Reciprocity, [-0.4, 0.9, -0.8, 0.3]), (Stars, [-0.6, 0.5])])
def test_chains_of_vectors_and_own_metrics(spark, metric, theta):
    m = model(graph(spark, "010/001/100"), M.Edges(), metric(), theta=theta)
    want = [r["value"] for r in enumeration.expected(m.collection, theta).orderBy("f_idx").collect()]
    drawn = m.simulate(4000, 5, "metropolis_hastings", burn_in=200, thin=8).where("src IS NOT NULL").select("graph_id", "src", "dst")
    got = [r["v"] for r in m._sampled(drawn, 4000).groupBy("f_idx").agg(F.avg("value").alias("v")).orderBy("f_idx").collect()]
    assert got == pytest.approx(want, abs=0.12) and got[1:] == pytest.approx(want[1:], abs=0.1)


def test_chains_refuse_what_does_not_tell_them(spark):
    silent = type("Silent", (Stars,), {"chain_change": M.Metric.chain_change})
    with pytest.raises(NotImplementedError, match="chain_change"):
        sampling.chain_terms(Collection([M.Edges(), silent()], graph(spark, "010/001/100")), [0.0, 0.0])


def test_exact_samples(spark):
    m = model(monastery(spark), M.Edges(), M.TotalReciprocity(), theta=[-1.76, 2.32])
    p = {(r["src"], r["dst"]): r["p"] for r in fit.marginals(m.predict_pairs()).collect()}
    got = m.simulate(300, 11).groupBy("graph_id").count().agg(F.avg("count")).first()[0]
    assert got == pytest.approx(sum(p.values()), abs=2.5)
    assert m.simulate(20, 7).exceptAll(m.simulate(20, 7)).count() == 0
    with pytest.raises(ValueError):
        model(monastery(spark), M.Edges(), M.Triangles(True), theta=[0.0, 0.0]).simulate(2, method="exact")


def test_unique_samples(spark):
    sure = grid(spark, 4).select("src", "dst", F.lit(0.9999).alias("p"))
    with pytest.raises(ValueError, match="duplication rate"):
        sampling.sample_unique(lambda first, size: sampling.sample_independent(sure, size, 1, first), spark, 400)
    half = grid(spark, 4).select("src", "dst", F.lit(0.5).alias("p"))
    found = sampling.sample_unique(lambda first, size: sampling.sample_independent(half, size, 1, first), spark, 50)
    graphs = {}
    for r in found.collect():
        graphs.setdefault(r["graph_id"], set()).add((r["src"], r["dst"]))
    assert len({frozenset(x) for x in graphs.values()}) == len(graphs) >= 49


def test_monte_carlo_fit_comes_near_the_closed_form(spark):
    g = monastery(spark)
    m = GraphModel(g, [M.Edges(), M.TotalReciprocity()], fix_collinearity=False, seed=2)
    seen = []
    m.fit("mcmle", steps=4, rate=0.5, count=120, burn_in=3000, thin=150, criterion="zero_grad_norm", cov_method="naive", callback=lambda k, t: seen.append(t.copy()))
    assert len(seen) <= 4 and m.theta[0] == pytest.approx(-1.76, abs=0.5) and m.theta[1] == pytest.approx(2.32, abs=0.8)
    assert m.diagnostics().count() == 2


def test_influence(spark):
    c = Collection([M.Edges(), M.OutDegree(ignore=(0,))], graph_from_edges(spark, 10, [(0, 1)]))
    p = {r["dyad_idx"]: r["p"] for r in sampling.influence(c).collect()}
    assert p[80] / p[0] == pytest.approx(11) and sum(p.values()) == pytest.approx(1)


def test_scalar_functions(spark):
    row = spark.range(1).select(scalar.sigmoid(F.lit(-800.0)).alias("a"), scalar.sigmoid(F.lit(0.0)).alias("b"), scalar.log_likelihood(F.lit(1.0), F.lit(0.25), 2).alias("c")).first()
    assert row["a"] == pytest.approx(0) and row["b"] == 0.5 and row["c"] == pytest.approx(-2)
    assert scalar.convex_minorant([(0, 0), (1, 5), (2, 1), (3, 4)]) == [(0, 0), (2, 1), (3, 4)]
    assert scalar.minorant_at([(0, 0), (1, 5), (2, 1), (3, 4)]) == pytest.approx([0, 0.5, 1, 4])
