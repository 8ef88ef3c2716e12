"""Simulation: exact draws, draws without repetition, and Metropolis-Hastings chains."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadspark.functions.dyads import graph_hash, index_to_pair, with_graphs
from dyadspark.functions.rng import RANGE, draw
from dyadspark.operators.collection import Collection
from dyadspark.operators.metrics import AttributeSum, AttributeSumIn, AttributeSumOut, Metric, Reciprocity, TotalReciprocity, Triangles
from dyadspark.spec import Proposal


def sample_independent(probabilities: DataFrame, count: int, seed: int, first: int = 0) -> DataFrame:
    """Edges of count graphs: graph_id, src, dst. probabilities: src, dst, p; dyads without p stay off."""
    cells = with_graphs(probabilities.select("src", "dst", "p"), count, first)
    return cells.where(draw(seed, F.col("graph_id"), F.col("src"), F.col("dst")) < F.col("p") * RANGE).select("graph_id", "src", "dst")


def sample_dyads(pairs: DataFrame, count: int, seed: int, first: int = 0) -> DataFrame:
    """Edges of count graphs from state probabilities p0 .. p3 of pairs; one draw decides a pair."""
    u = draw(seed, F.col("graph_id"), F.col("src"), F.col("dst"))
    state = F.when(F.col("u") < F.col("p0") * RANGE, 0).when(F.col("u") < (F.col("p0") + F.col("p1")) * RANGE, 1).when(F.col("u") < (F.col("p0") + F.col("p1") + F.col("p2")) * RANGE, 2).otherwise(3)
    drawn = with_graphs(pairs.select("src", "dst", "p0", "p1", "p2"), count, first).withColumn("u", u).withColumn("state", state)
    up = drawn.where("state IN (1, 3)").select("graph_id", "src", "dst")
    return up.unionByName(drawn.where("state IN (2, 3)").select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def first_seen(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """graph_id of the first graph of each kind, among ids; graphs without edges are a kind."""
    kinds = ids.join(graph_hash(edges), "graph_id", "left").withColumn("hash", F.coalesce("hash", F.lit("")))
    return kinds.groupBy("hash").agg(F.min("graph_id").alias("graph_id"))


def sample_unique(draw_batch, spark: SparkSession, count: int, batches: int = 50) -> DataFrame:
    """count different graphs, in the order of their draws, renumbered.

    draw_batch(first, size) gives edges of graphs first .. first + size - 1. Batches adapt to the
    share of repetitions; over 95 % of them in a batch ends in an error.
    """
    made, kept, factor = 0, 0, 2.0
    edges = unique = None
    for _ in range(batches):
        size = max(10, count, int((count - kept) * factor)) if made == 0 else max(10, int((count - kept) * factor))
        fresh = draw_batch(made, size)
        edges = fresh if edges is None else edges.unionByName(fresh)
        made += size
        before = kept
        unique = first_seen(edges, spark.range(made).select(F.col("id").alias("graph_id")))
        kept = unique.count()
        if kept >= count:
            order = F.row_number().over(Window.orderBy("graph_id")) - 1  # one row per graph kept
            numbered = unique.select("graph_id", order.cast("long").alias("new")).where(F.col("new") < count)
            return edges.join(F.broadcast(numbered), "graph_id").select(F.col("new").alias("graph_id"), "src", "dst")
        repeated = 1 - (kept - before) / size
        if repeated > 0.95:
            raise ValueError(f"duplication rate of {repeated:.0%}: the model has too few likely graphs")
        factor = min(10.0, factor * 1.5) if repeated > 0.5 else max(1.0, factor * 0.8) if repeated < 0.1 else factor
    raise ValueError(f"no {count} different graphs in {made} draws")


def influence(model: Collection, kind: Proposal = Proposal.INFLUENCE_SUM) -> DataFrame:
    """Proposal probabilities: dyad_idx, src, dst, p, from what dyads do to each feature against its mean.

    Changes count by their size, as probabilities can't be negative.
    """
    from dyadspark.functions.dyads import dyads

    cells = dyads(model.graph)
    rows = model.design(cells.select("src", "dst")).withColumn("v", F.abs("v"))
    total = cells.count()
    means = rows.groupBy("f_idx").agg((F.sum("v") / total).alias("mean"))
    scored = rows.join(F.broadcast(means), "f_idx").groupBy("src", "dst").agg(F.sum(F.when(F.col("mean") == 0, F.col("v")).otherwise(F.col("v") / F.col("mean"))).alias("s"))
    every = cells.join(scored, ["src", "dst"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    if kind == Proposal.INFLUENCE_SOFTMAX:
        every = every.join(F.broadcast(every.agg(F.max("s").alias("top")))).withColumn("s", F.exp(F.col("s") - F.col("top")))
    whole = every.agg(F.sum("s").alias("whole"))
    return every.join(F.broadcast(whole)).select("dyad_idx", "src", "dst", (F.col("s") / F.col("whole")).alias("p"))


@dataclass
class ChainTerms:
    """What features say to a flip, times their parameters.

    fixed and mutual: by dyad, always and where the dyad of the other direction is there. triads: the
    parameter of each triad that the dyad closes. own: metrics that tell a chain themselves, with
    the parameters of their local features.
    """

    fixed: np.ndarray
    mutual: np.ndarray
    triads: float = 0.0
    own: list[tuple[Metric, dict[int, float]]] = field(default_factory=list)


class ChainState:
    """A graph as a chain holds it: its matrix, and what every feature says to a flip."""

    def __init__(self, n: int, directed: bool, edges: list[tuple[int, int]], terms: ChainTerms):
        self.directed, self.terms = directed, terms
        self.y = np.zeros((n, n), dtype=np.int8)
        for i, j in edges:
            self.y[i, j] = 1
            if not directed:
                self.y[j, i] = 1

    def log_ratio(self, i: int, j: int) -> float:
        """theta' change of flipping (i, j)."""
        terms, y = self.terms, self.y
        up = terms.fixed[i, j] + terms.mutual[i, j] * y[j, i]
        if terms.triads:
            # paths back from j to i; without directions, the common neighbours
            up += terms.triads * float(y[j].astype(np.int64) @ y[:, i])
        if terms.own:
            was = int(y[i, j])
            self._put(i, j, 0)
            up += sum(theta[k] * v for metric, theta in terms.own for k, v in metric.chain_change(y, i, j).items() if k in theta)
            self._put(i, j, was)
        return -up if y[i, j] else up

    def flip(self, i: int, j: int) -> None:
        self._put(i, j, self.y[i, j] ^ 1)

    def _put(self, i: int, j: int, value: int) -> None:
        self.y[i, j] = value
        if not self.directed:
            self.y[j, i] = value


def chain_terms(model: Collection, theta: list[float]) -> ChainTerms:
    """The model's features, summed by dyad where they do not depend on the graph."""
    n = model.graph.n
    terms = ChainTerms(np.zeros((n, n)), np.zeros((n, n)))
    own: dict[int, dict[int, float]] = {}
    plain = []
    for f, (k, local, _) in enumerate(model.features()):
        metric = model.metrics[k]
        if type(metric) is Triangles:
            terms.triads += theta[f]
        elif type(metric) is TotalReciprocity:
            terms.mutual += theta[f]
        elif type(metric) is Reciprocity:
            i, j = index_to_pair(local, n, False)
            terms.mutual[i, j] += theta[f]
            terms.mutual[j, i] += theta[f]
        elif metric.dyad_independent:
            plain.append(f)
        elif type(metric).chain_change is Metric.chain_change:
            raise NotImplementedError(f"no chain for {metric.title}: it does not say chain_change()")
        else:
            own.setdefault(k, {})[local] = theta[f]
    terms.own = [(model.metrics[k], by_local) for k, by_local in own.items()]
    if plain:
        table = F.array(*[F.lit(float(t)) for t in theta])
        rows = model.design().where(F.col("f_idx").isin(plain)).groupBy("src", "dst").agg(F.sum(F.col("v") * F.element_at(table, F.col("f_idx") + 1)).alias("s")).collect()
        for r in rows:
            terms.fixed[r["src"], r["dst"]] = r["s"]
            if not model.graph.directed:
                terms.fixed[r["dst"], r["src"]] = r["s"]
    return terms


def metropolis_hastings(model: Collection, theta: list[float], count: int, seed: int, burn_in: int | None = None, thin: int | None = None, chains: int = 4, start: DataFrame | None = None, proposal: DataFrame | None = None, replace: bool = True) -> DataFrame:
    """Edges of count graphs: graph_id, chain_id, t, src, dst; graphs without edges have a row of nulls.

    Chains are independent and run in tasks of their own. Each proposes a dyad, flips it with
    probability min(1, exp(theta' change)), and records its graph after burn_in + 1 proposals and then
    every thin. start: edges (src, dst) where all begin, by default the model's first graph. proposal:
    dyad_idx, p; by default every dyad is as likely. Without replacement a chain records only graphs
    that it has not recorded before.
    """
    n, directed = model.graph.n, model.graph.directed
    burn_in = 100 * n * n if burn_in is None else burn_in
    thin = n * n if thin is None else thin
    spark = model.graph.nodes.sparkSession
    terms = chain_terms(model, theta)
    edges = [(r["src"], r["dst"]) for r in (Metric.observed(model.graph) if start is None else start.select("src", "dst")).collect()]
    total = n * n - n if directed else n * (n - 1) // 2
    weights = None
    if proposal is not None:
        weights = np.zeros(total)
        for r in proposal.select("dyad_idx", "p").collect():
            weights[r["dyad_idx"]] = r["p"]
    share = [count // chains + (c < count % chains) for c in range(chains)]
    begin = np.cumsum([0, *share])

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        c = int(key[0])
        rng = np.random.default_rng([seed, c])
        state = ChainState(n, directed, edges, terms)
        pairs = [index_to_pair(k, n, directed) for k in range(total)] if weights is not None else []
        cumulative = np.cumsum(weights) / weights.sum() if weights is not None else None
        out, seen, step, t = [], set(), 0, 0
        due = burn_in
        while t < share[c]:
            size = 8192
            us = rng.random(size)
            if cumulative is not None:
                places = [pairs[k] for k in np.minimum(np.searchsorted(cumulative, rng.random(size), side="right"), total - 1)]
            else:
                i, d = rng.integers(0, n, size), rng.integers(1, n, size)
                places = list(zip(i.tolist(), ((i - d) % n).tolist(), strict=True))
            for (i, j), u in zip(places, us.tolist(), strict=True):
                if not directed and i > j:
                    i, j = j, i
                ratio = state.log_ratio(i, j)
                if ratio >= 0 or u <= np.exp(ratio):
                    state.flip(i, j)
                if step == due:
                    due += thin
                    code = state.y.tobytes()
                    if replace or code not in seen:
                        seen.add(code)
                        a, b = np.nonzero(state.y if directed else np.triu(state.y))
                        out += [(int(begin[c]) + t, c, t, int(x), int(y)) for x, y in zip(a, b, strict=True)] or [(int(begin[c]) + t, c, t, None, None)]
                        t += 1
                        if t == share[c]:
                            break
                step += 1
        return pd.DataFrame(out, columns=["graph_id", "chain_id", "t", "src", "dst"]).astype({"src": "Int32", "dst": "Int32"})

    seeds = spark.range(chains, numPartitions=chains).select(F.col("id").alias("chain_id"))
    return seeds.groupBy("chain_id").applyInPandas(run, "graph_id long, chain_id long, t long, src int, dst int")


__all__ = ["AttributeSum", "AttributeSumIn", "AttributeSumOut", "first_seen", "influence", "metropolis_hastings", "sample_dyads", "sample_independent", "sample_unique"]
