"""Exponential-family graph models: fit, simulate, evaluate."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.operators import convergence, evaluate, fit, sampling
from dyadspark.operators.collection import Collection
from dyadspark.operators.covariance import covariance
from dyadspark.operators.metrics import Metric
from dyadspark.spec import Covariance, Criterion, FitResult, Graph, Optimizer, Proposal, Reduction, Sampling, Scheme

log = logging.getLogger("dyadspark")


def set_log_level(level: int | str) -> None:
    log.setLevel(level)


def disable_logging() -> None:
    log.disabled = True


def enable_logging() -> None:
    log.disabled = False


class GraphModel:
    """A model of graphs like graph: its node set, attributes, mask and weights, under metrics."""

    def __init__(self, graph: Graph, metrics: list[Metric], theta: list[float] | dict[str, float] | None = None, fix_collinearity: bool = True, collinearity_samples: int = 1000, seed: int = 0):
        self.collection, self.seed = Collection(list(metrics), graph), seed
        self.scheme: Scheme | None = None
        self.chain: DataFrame | None = None
        if isinstance(theta, dict):
            self._theta = np.zeros(0)
            self.set_parameters(theta)
            return
        if theta is None and fix_collinearity:
            self.collection.fix_collinearity(collinearity_samples, seed)
        q = len(self.collection.features())
        if theta is not None and len(theta) != q:
            raise ValueError(f"{q} parameters are needed")
        self._theta = np.array(theta, dtype=float) if theta is not None else np.random.default_rng(seed).uniform(-1, 1, q)

    @property
    def graph(self) -> Graph:
        return self.collection.graph

    @property
    def theta(self) -> list[float]:
        return self._theta.tolist()

    def parameters(self) -> dict[str, float]:
        return dict(zip(self.collection.names(), self.theta, strict=True))

    def ignored_features(self) -> list[str]:
        return self.collection.ignored()

    def set_parameters(self, values: dict[str, float]) -> None:
        """Features without a value leave the model; a value without a feature is an error."""
        names = self.collection.names()
        if any("__" in n.rsplit("_", 1)[-1] and n.rsplit("__", 1)[-1].isdigit() for n in names):
            raise ValueError("metrics alike need names before parameters can be set")
        if unknown := set(values) - set(names):
            raise ValueError(f"no features {sorted(unknown)}")
        for index in reversed([k for k, n in enumerate(names) if n not in values]):
            self.collection.remove(index)
        self._theta = np.array([values[n] for n in self.collection.names()], dtype=float)

    def statistics(self, graph: Graph | None = None) -> list[float]:
        return self.collection.statistics(graph)

    def sample_statistics(self, graph: Graph | None = None) -> DataFrame:
        return self.collection.sample_statistics(graph)

    def summary(self) -> str:
        return "\n".join(f"{name}: {value:.6f}" for name, value in self.parameters().items())

    # fitting

    def fit(self, scheme: str = Scheme.AUTO, start_from_mple: bool = True, **options) -> FitResult:
        """Fit by the scheme, or by the one that the metrics call for."""
        chosen = self.collection.scheme() if scheme == Scheme.AUTO else Scheme(scheme)
        if self.graph.weights is not None:
            if chosen != Scheme.MPLE:
                raise NotImplementedError("weights are for pseudo-likelihood only")
            if self.graph.weights.where("w < 0").head(1):
                raise ValueError("weights must not be negative")
        self.scheme = chosen
        if chosen == Scheme.MPLE:
            found = fit.fit_mple(self.collection, **options)
        elif chosen == Scheme.MPLE_RECIPROCITY:
            found = fit.fit_dyads(self.collection, **options)
        else:
            if start_from_mple:
                self._theta = fit.fit_mple(self.collection).theta
            return self._fit_mcmle(**options)
        self._theta = found.theta
        log.info("%s: %d steps, %s", chosen, found.steps, found.result)
        return found.result

    def _fit_mcmle(
        self, steps: int = 1000, rate: float = 0.1, optimizer: str = Optimizer.NEWTON, criterion: str = Criterion.MODEL_BOOTSTRAP, cov_method: str = Covariance.BATCH, batches: int = 25, count: int | None = None, burn_in: int | None = None, thin: int | None = None, chains: int = 4,
        proposal: str = Proposal.UNIFORM, confidence: float = 0.5, window: int = 10, gradient_threshold: float = 1e-3, reps: int = 100, size: int = 1000, quantile: float = 0.95, distance: float = 1.0, callback: Callable[[int, np.ndarray], None] | None = None,
    ) -> FitResult:
        """Newton or gradient steps on sampled means until the criterion holds; the last result if it never does."""
        n, spark = self.graph.n, self.graph.nodes.sparkSession
        q = len(self.collection.features())
        count = 10 * n if count is None else count
        count += count % 2
        observed_rows = self.collection.sample_statistics().groupBy("f_idx").agg(F.avg("value").alias("v")).collect()
        observed = np.zeros(q)
        for r in observed_rows:
            observed[r["f_idx"]] = r["v"]
        boot = None
        if criterion == Criterion.OBSERVED_BOOTSTRAP:
            if self.graph.graphs > 1:
                raise ValueError("the bootstrap of the observed graph needs a single graph")
            boot = self.collection.bootstrap(seed=self.seed).cache()
        weights = None if proposal == Proposal.UNIFORM else sampling.influence(self.collection, Proposal(proposal))
        start, gradients = None, []
        result = FitResult(False)
        for step in range(steps):
            drawn = sampling.metropolis_hastings(self.collection, self.theta, count, self.seed * 1_000_003 + step, burn_in if step == 0 else 0, thin, chains, start, weights).cache()
            edges = drawn.where("src IS NOT NULL").select("graph_id", "src", "dst")
            stats = self._sampled(edges, count).cache()
            mean = np.zeros(q)
            for r in stats.groupBy("f_idx").agg(F.avg("value").alias("v")).collect():
                mean[r["f_idx"]] = r["v"]
            gradient = mean - observed
            gradients.append(gradient)
            cov = None
            if optimizer == Optimizer.NEWTON or criterion == Criterion.HOTELLING:
                cov = covariance(stats, count, q, cov_method, batches)
            move = np.linalg.pinv(cov) @ gradient if optimizer == Optimizer.NEWTON else gradient
            self._theta = self._theta - rate * move
            last = [(r["src"], r["dst"]) for r in edges.where(F.col("graph_id") == count - 1).collect()]
            start = spark.createDataFrame(last, "src int, dst int") if last else spark.createDataFrame([], "src int, dst int")
            if criterion == Criterion.HOTELLING:
                result = convergence.hotelling(spark, observed, mean, cov, count, confidence)
            elif criterion == Criterion.ZERO_GRAD_NORM:
                result = convergence.zero_gradient(gradients, window, gradient_threshold)
            elif criterion == Criterion.OBSERVED_BOOTSTRAP:
                result = convergence.observed_bootstrap(observed, boot, stats, count, reps, size, quantile, distance, self.seed + step)
            elif criterion == Criterion.MODEL_BOOTSTRAP:
                result = convergence.model_bootstrap(observed, stats, count, reps, size, quantile, distance, self.seed + step)
            else:
                raise ValueError(f"unknown criterion {criterion}")
            if callback:
                callback(step, self._theta)
            log.info("step %d: %s", step, result)
            drawn.unpersist()
            if self.chain is not None:
                self.chain.unpersist()
            self.chain = stats
            if result.success:
                break
        return result

    def _sampled(self, edges: DataFrame, count: int) -> DataFrame:
        """t, f_idx, value of sampled graphs; those without edges have zeros."""
        stats = self.collection.sample_statistics(self.graph.but(edges=edges, count=count)).select(F.col("graph_id").alias("t"), "f_idx", "value")
        every = edges.sparkSession.range(count).select(F.col("id").alias("t")).join(F.broadcast(self.collection.feature_table().select("f_idx")))
        return every.join(stats, ["t", "f_idx"], "left").select("t", "f_idx", F.coalesce("value", F.lit(0.0)).alias("value"))

    # simulation

    def simulate(self, count: int, seed: int = 0, method: str | None = None, replace: bool = True, burn_in: int | None = 10_000, thin: int | None = 1000, start: DataFrame | None = None, proposal: str = Proposal.UNIFORM, chains: int = 4) -> DataFrame:
        """Edges of count graphs: exact draws where dyads or pairs are independent, else chains."""
        scheme = self.collection.scheme()
        method = method or (Sampling.METROPOLIS_HASTINGS if scheme == Scheme.MCMLE else Sampling.EXACT)
        if method == Sampling.EXACT:
            if scheme == Scheme.MCMLE:
                raise ValueError("this model has no exact sampler")
            if scheme == Scheme.MPLE:
                p = self.predict().select("src", "dst", "p").cache()
                batch = lambda first, size: sampling.sample_independent(p, size, seed, first)
            else:
                pairs = self.predict_pairs().cache()
                batch = lambda first, size: sampling.sample_dyads(pairs, size, seed, first)
            return batch(0, count) if replace else sampling.sample_unique(batch, self.graph.nodes.sparkSession, count)
        weights = None if proposal == Proposal.UNIFORM else sampling.influence(self.collection, Proposal(proposal))
        return sampling.metropolis_hastings(self.collection, self.theta, count, seed, burn_in, thin, chains, start, weights, replace)

    def simulated(self, count: int, **options) -> Graph:
        """simulate() as a sample to fit: graphs that were drawn without an edge count as well."""
        return self.graph.but(edges=self.simulate(count, **options).where("src IS NOT NULL").select("graph_id", "src", "dst"), count=count)

    # evaluation

    def predict(self, graph: Graph | None = None) -> DataFrame:
        """src, dst, dyad_idx, p, y, w. Models whose dyads depend on each other look at graph, by default the model's."""
        return fit.predictions(self.collection, self.theta, graph)

    def expected_degrees(self) -> DataFrame:
        """node, expected: sums of predict() over the dyads of each node, in directed graphs those that it starts."""
        return fit.expected_degrees(self.collection, self.theta)

    def predict_pairs(self) -> DataFrame:
        if self.collection.scheme() != Scheme.MPLE_RECIPROCITY:
            raise NotImplementedError("only reciprocity models have pair probabilities")
        return fit.pair_predictions(self.collection, self.theta)

    def log_likelihood(self, how: str = Reduction.SUM, base: float = math.e) -> DataFrame:
        scheme = self.collection.scheme()
        if scheme == Scheme.MPLE:
            return evaluate.dyad_log_likelihood(self.predict(), how, base)
        if scheme == Scheme.MPLE_RECIPROCITY:
            return evaluate.pair_log_likelihood(self.predict_pairs(), how, base)
        raise NotImplementedError("the likelihood of this model has no closed form")

    def entropy(self, how: str = Reduction.SUM) -> DataFrame:
        scheme = self.collection.scheme()
        if scheme == Scheme.MPLE:
            return evaluate.dyad_entropy(self.predict(), how)
        if scheme == Scheme.MPLE_RECIPROCITY:
            return evaluate.pair_entropy(self.predict_pairs(), how)
        raise NotImplementedError("the entropy of this model has no closed form")

    def diagnostics(self, chain: DataFrame | None = None, observed: bool = False) -> DataFrame:
        chain = chain if chain is not None else self.chain
        if chain is None:
            raise ValueError("no chain to look at: fit by Monte Carlo or give a sample")
        at = self.collection.sample_statistics().where("graph_id = 0").select("f_idx", "value") if observed else None
        return evaluate.diagnostics(chain, at)
