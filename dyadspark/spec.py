"""Names and settings that all parts share."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import StrEnum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scheme(StrEnum):
    AUTO = "auto"
    MPLE = "mple"
    MPLE_RECIPROCITY = "mple_reciprocity"
    MCMLE = "mcmle"


class Optimizer(StrEnum):
    NEWTON = "newton"
    GRADIENT_DESCENT = "gradient_descent"


class Criterion(StrEnum):
    HOTELLING = "hotelling"
    ZERO_GRAD_NORM = "zero_grad_norm"
    OBSERVED_BOOTSTRAP = "observed_bootstrap"
    MODEL_BOOTSTRAP = "model_bootstrap"


class Covariance(StrEnum):
    NAIVE = "naive"
    BATCH = "batch"
    INITIAL_SEQUENCE = "multivariate_initial_sequence"


class Proposal(StrEnum):
    UNIFORM = "uniform"
    INFLUENCE_SUM = "features_influence_sum"
    INFLUENCE_SOFTMAX = "features_influence_softmax"


class Sampling(StrEnum):
    EXACT = "exact"
    METROPOLIS_HASTINGS = "metropolis_hastings"


class Reduction(StrEnum):
    SUM = "sum"
    MEAN = "mean"
    NONE = "none"


@dataclass(frozen=True)
class FitResult:
    success: bool
    statistic: float | None = None
    threshold: float | None = None


@dataclass(frozen=True)
class Graph:
    """A sample of graphs on one node set.

    nodes: node (0 .. n-1), type, attr, pos. edges: graph_id, src, dst, one row for each edge, of an
    undirected graph with src < dst. mask: the dyads (src, dst) that count, or None for all.
    weights: src, dst, w of dyads whose weight in a fit is not 1. count: how many graphs there are,
    numbered from 0, those without edges included; if None, as many as the largest graph_id tells.
    """

    nodes: DataFrame
    edges: DataFrame
    n: int
    directed: bool = True
    mask: DataFrame | None = None
    weights: DataFrame | None = None
    count: int | None = None

    def but(self, **changes) -> Graph:
        """A copy with changes. Other edges are those of an unknown number of graphs, unless count is given."""
        if "edges" in changes:
            changes.setdefault("count", None)
        return replace(self, **changes)

    @property
    def graphs(self) -> int:
        """How many graphs there are; where count does not say so, a graph without edges counts if a later one has some."""
        if self.count is not None:
            return self.count
        top = self.edges.agg(F.max("graph_id")).first()[0]
        return 1 if top is None else int(top) + 1

    def masked_edges(self) -> DataFrame:
        return self.edges if self.mask is None else self.edges.join(self.mask, ["src", "dst"], "left_semi")
