"""Pseudo-likelihood fits by Newton's method on sums over dyads."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark.functions.dyads import grid, seen_states
from dyadspark.functions.scalar import EPS, sigmoid, softmax
from dyadspark.operators.collection import Collection
from dyadspark.spec import FitResult

#: Designs with at most so many different rows are summed up once and fitted at the driver.
COMPRESS_LIMIT = 50_000
#: Numbers in the matrices of features that rows tie together; beyond it sums are made by jobs.
DENSE_LIMIT = 20_000_000
#: |theta| never passes the log-odds of the probability at which likelihoods are clipped.
THETA_CAP = math.log((1 - EPS) / EPS)


@dataclass
class Fit:
    theta: np.ndarray
    result: FitResult
    steps: int


def linear_score(theta: list[float]) -> Column:
    """The score of a design row x under theta."""
    table = theta_table(theta)
    return F.aggregate("x", F.lit(0.0), lambda a, e: a + e["v"] * F.element_at(table, e["f"] + 1))


def theta_table(theta: list[float]) -> Column:
    """The parameters as an array, from one literal however many there are."""
    return F.split(F.lit(",".join(repr(float(t)) for t in theta)), ",").cast("array<double>")


def compress(rows: DataFrame) -> DataFrame:
    """Design rows that are alike as one: x, w (sum of weights), wy (of weighted labels)."""
    return rows.groupBy("x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))


def moments(rows: DataFrame, theta: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient X'(wy - wp) and curvature X' diag(w p (1 - p)) X at theta. rows: x, w, wy."""
    q = len(theta)
    scored = rows.withColumn("p", sigmoid(linear_score(theta)))
    first = scored.select(F.explode("x").alias("e"), (F.col("wy") - F.col("w") * F.col("p")).alias("r")).groupBy("e.f").agg(F.sum(F.col("e.v") * F.col("r")).alias("g"))
    both = scored.select("x", (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("d")).select("x", "d", F.explode("x").alias("a")).select("d", "a", F.explode("x").alias("b"))
    second = both.groupBy(F.col("a.f").alias("f"), F.col("b.f").alias("g")).agg(F.sum(F.col("d") * F.col("a.v") * F.col("b.v")).alias("h"))
    gradient, curvature = np.zeros(q), np.zeros((q, q))
    for r in first.collect():
        gradient[r["f"]] = r["g"]
    for r in second.collect():
        curvature[r["f"], r["g"]] = r["h"]
    return gradient, curvature


def _newton(q: int, evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | Blocks]], start: np.ndarray | None, steps: int, tol: float) -> Fit:
    theta = np.zeros(q) if start is None else np.array(start, dtype=float)
    for k in range(steps):
        gradient, curvature = evaluate(theta)
        move = curvature.solve(gradient) if isinstance(curvature, Blocks) else np.linalg.lstsq(curvature, gradient, rcond=1e-12)[0]
        size = np.abs(move).max(initial=0.0)
        theta = np.clip(theta + (move if size <= 3 else move * (3 / size)), -THETA_CAP, THETA_CAP)
        if size < tol:
            bound = bool((np.abs(theta) >= THETA_CAP).any())
            return Fit(theta, FitResult(not bound, float(np.abs(gradient).max(initial=0.0)), tol), k + 1)
    return Fit(theta, FitResult(False, float(size), tol), steps)


@dataclass
class Blocks:
    """A curvature of features that fall apart into groups: of single ones the diagonal, of others matrices."""

    single: np.ndarray
    diagonal: np.ndarray
    groups: list[tuple[np.ndarray, np.ndarray]]

    def solve(self, gradient: np.ndarray, rcond: float = 1e-12) -> np.ndarray:
        """The shortest least-squares solution, with one cutoff for all groups, as of the whole matrix."""
        parts = [(f, *np.linalg.eigh(h)) for f, h in self.groups]
        cut = rcond * max([np.abs(self.diagonal).max(initial=0.0), *(np.abs(values).max(initial=0.0) for _, values, _ in parts)])
        move = np.zeros(len(gradient))
        full = np.abs(self.diagonal) > cut
        move[self.single[full]] = gradient[self.single[full]] / self.diagonal[full]
        for f, values, vectors in parts:
            kept = np.abs(values) > cut
            move[f] = vectors[:, kept] @ ((vectors[:, kept].T @ gradient[f]) / values[kept])
        return move


def _blocks(few: pa.Table, q: int) -> Callable[[np.ndarray], tuple[np.ndarray, Blocks]] | None:
    """Gradient and curvature of rows (w, wy, f, v) at theta; None if the matrices of features that rows tie together would be too large."""
    few = few.combine_chunks()
    flat = lambda c: few.column(c).combine_chunks()
    lists = lambda c: np.concatenate([np.zeros(0, kind := np.int64 if c == "f" else float), flat(c).flatten().to_numpy(zero_copy_only=False).astype(kind)])
    w, wy = (few.column(c).to_numpy().astype(float) for c in ("w", "wy"))
    f, v = lists("f"), lists("v")
    row = np.repeat(np.arange(few.num_rows), np.array(pc.list_value_length(few.column("f")).to_pylist(), dtype=np.int64))
    # the lowest feature that rows tie each feature to
    group = np.arange(q)
    while True:
        low = np.full(few.num_rows, q)
        np.minimum.at(low, row, group[f])
        new = group.copy()
        np.minimum.at(new, group[f], low[row])
        new = new[new]
        if (new == group).all():
            break
        group = new[group]
    sizes = np.bincount(group, minlength=q)
    alone = sizes[group[f]] == 1
    single = np.flatnonzero(sizes[group] == 1)
    order = np.argsort(group[f], kind="stable")
    order = order[~alone[order]]
    groups, cells = [], 0
    for at in np.split(order, np.flatnonzero(np.diff(group[f[order]])) + 1) if len(order) else []:
        mine, rows = np.flatnonzero(group == group[f[at[0]]]), np.unique(row[at])
        cells += len(mine) * (len(rows) + len(mine))
        if cells > DENSE_LIMIT:
            return None
        x = np.zeros((len(rows), len(mine)))
        x[np.searchsorted(rows, row[at]), np.searchsorted(mine, f[at])] = v[at]
        groups.append((mine, rows, x))

    def evaluate(theta: np.ndarray) -> tuple[np.ndarray, Blocks]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=v * theta[f], minlength=len(w)), -700, 700)))
        residual, d = wy - w * p, w * p * (1 - p)
        gradient = np.bincount(f, weights=v * residual[row], minlength=q)
        diagonal = np.bincount(f[alone], weights=(v * v * d[row])[alone], minlength=q)[single]
        return gradient, Blocks(single, diagonal, [(mine, (x * d[rows][:, None]).T @ x) for mine, rows, x in groups])

    return evaluate


def fit_mple(model: Collection, start: list[float] | None = None, steps: int = 100, tol: float = 1e-9, limit: int = COMPRESS_LIMIT) -> Fit:
    """Logistic regression of the edges on the change scores.

    X comes from the first graph, labels are shares over all. Where a coefficient would go to
    infinity it stops at THETA_CAP and the fit counts as failed.
    """
    q = len(model.features())
    rows = model.kind_rows()
    rows = compress(model.design_rows() if rows is None else rows)
    # with many features the driver has lists of their length anyhow
    most = max(limit, 2 * q if limit else 0)
    few = rows.select("w", "wy", F.transform("x", lambda e: e["f"]).alias("f"), F.transform("x", lambda e: e["v"]).alias("v")).limit(most + 1).toArrow()
    blocks = _blocks(few, q) if few.num_rows <= most else None
    if blocks is None:
        rows = rows.cache()
        try:
            return _newton(q, lambda theta: moments(rows, theta.tolist()), None if start is None else np.array(start), steps, tol)
        finally:
            rows.unpersist()
    return _newton(q, blocks, None if start is None else np.array(start), steps, tol)


def state_shares(model: Collection) -> DataFrame:
    """src < dst and y0 .. y3, the shares of all graphs in which the pair is in each state, of pairs with an edge in some."""
    k = model.graph.graphs
    seen = seen_states(model.graph).groupBy("src", "dst")
    return seen.agg(((k - F.count("*")) / k).alias("y0"), *[(F.count(F.when(F.col("state") == s, 1)) / k).alias(f"y{s}") for s in (1, 2, 3)])


def pair_rows(model: Collection) -> DataFrame:
    """One row per pair: x1, x2, x3 (sparse designs of the states; that of 0 is empty) and y0 .. y3."""
    spark, n = model.graph.nodes.sparkSession, model.graph.n
    empty = F.array().cast("array<struct<f:int,v:double>>")
    design = model.pair_design().groupBy("src", "dst").agg(*[F.array_sort(F.collect_list(F.when(F.col("state") == s, F.struct(F.col("f_idx").alias("f"), "v")))).alias(f"x{s}") for s in (1, 2, 3)])
    shares = state_shares(model)
    pairs = grid(spark, n, directed=False).select("src", "dst").join(design, ["src", "dst"], "left").join(shares, ["src", "dst"], "left")
    return pairs.select("src", "dst", *[F.coalesce(f"x{s}", empty).alias(f"x{s}") for s in (1, 2, 3)], F.coalesce("y0", F.lit(1.0)).alias("y0"), *[F.coalesce(f"y{s}", F.lit(0.0)).alias(f"y{s}") for s in (1, 2, 3)])


def pair_moments(rows: DataFrame, theta: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the four-state logit at theta. rows: x1 .. x3, y0 .. y3."""
    q = len(theta)
    table = F.array(*[F.lit(float(t)) for t in theta])
    score = lambda s: F.aggregate(f"x{s}", F.lit(0.0), lambda a, e: a + e["v"] * F.element_at(table, e["f"] + 1))
    ps = softmax([F.lit(0.0), score(1), score(2), score(3)])
    total = F.col("y0") + F.col("y1") + F.col("y2") + F.col("y3")
    scored = rows.withColumn("n", total).withColumns({f"p{s}": ps[s] for s in (1, 2, 3)})
    scaled = lambda s, c: F.transform(f"x{s}", lambda e: F.struct(e["f"].alias("f"), (e["v"] * c).alias("v")))
    first = scored.select(F.explode(F.concat(*[scaled(s, F.col(f"y{s}") - F.col("n") * F.col(f"p{s}")) for s in (1, 2, 3)])).alias("e")).groupBy("e.f").agg(F.sum("e.v").alias("g"))
    # the states' own products less those of their mean
    mean = F.struct((-F.col("n")).alias("d"), F.concat(*[scaled(s, F.col(f"p{s}")) for s in (1, 2, 3)]).alias("x"))
    parts = scored.select(F.explode(F.array(*[F.struct((F.col("n") * F.col(f"p{s}")).alias("d"), F.col(f"x{s}").alias("x")) for s in (1, 2, 3)], mean)).alias("t")).select("t.d", "t.x")
    both = parts.select("d", "x", F.explode("x").alias("a")).select("d", "a", F.explode("x").alias("b"))
    second = both.groupBy(F.col("a.f").alias("f"), F.col("b.f").alias("g")).agg(F.sum(F.col("d") * F.col("a.v") * F.col("b.v")).alias("h"))
    gradient, curvature = np.zeros(q), np.zeros((q, q))
    for r in first.collect():
        gradient[r["f"]] = r["g"]
    for r in second.collect():
        curvature[r["f"], r["g"]] = r["h"]
    return gradient, curvature


def fit_dyads(model: Collection, start: list[float] | None = None, steps: int = 100, tol: float = 1e-9, limit: int = COMPRESS_LIMIT) -> Fit:
    """Conditional logit of the four states of each pair; directed graphs only."""
    if not model.graph.directed:
        raise ValueError("pairs of undirected graphs have two states; use fit_mple()")
    q = len(model.features())
    grouped = pair_rows(model).groupBy("x1", "x2", "x3").agg(*[F.sum(f"y{s}").alias(f"y{s}") for s in range(4)])
    few = grouped.limit(limit + 1).collect()
    if len(few) > limit:
        grouped = grouped.cache()
        try:
            return _newton(q, lambda theta: pair_moments(grouped, theta.tolist()), None if start is None else np.array(start), steps, tol)
        finally:
            grouped.unpersist()
    x = np.zeros((len(few), 4, q))
    for k, r in enumerate(few):
        for s in (1, 2, 3):
            for e in r[f"x{s}"]:
                x[k, s, e["f"]] += e["v"]
    y = np.array([[r[f"y{s}"] for s in range(4)] for r in few], dtype=float).reshape(-1, 4)
    total = y.sum(axis=1)

    def evaluate(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x @ theta
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        mean = np.einsum("ks,ksq->kq", p, x)
        second = np.einsum("ks,ksq,ksr->qr", p * total[:, None], x, x)
        return np.einsum("ks,ksq->q", y - p * total[:, None], x), second - (mean * total[:, None]).T @ mean

    return _newton(q, evaluate, None if start is None else np.array(start), steps, tol)


def predictions(model: Collection, theta: list[float], graph=None) -> DataFrame:
    """src, dst, dyad_idx, p of every dyad that counts."""
    return model.design_rows(graph=graph).select("src", "dst", "dyad_idx", sigmoid(linear_score(theta)).alias("p"), "y", "w")


def expected_degrees(model: Collection, theta: list[float]) -> DataFrame:
    """node, expected: the sum of p over the dyads that start at each node of a directed graph, or that it is in."""
    if model.graph.directed and (kinds := model.kind_rows(ends=True)) is not None:
        # the dyads of a kind share out evenly over its sources, less the dyad that a node would have with itself
        p = kinds.rows.select("a", "b", sigmoid(linear_score(theta)).alias("p"))
        sums = kinds.counts.join(p, ["a", "b"]).groupBy("a").agg(F.sum(F.col("p") * F.col("targets")).alias("all"))
        own = p.withColumnRenamed("p", "own")
        at = kinds.nodes.join(sums, "a", "left").join(own, ["a", "b"], "left")
        return at.select("node", (F.coalesce("all", F.lit(0.0)) - F.coalesce("own", F.lit(0.0))).alias("expected"))
    p = predictions(model, theta).select("src", "dst", "p")
    if not model.graph.directed:
        p = p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p"))
    return p.groupBy(F.col("src").alias("node")).agg(F.sum("p").alias("expected"))


def pair_predictions(model: Collection, theta: list[float]) -> DataFrame:
    """src < dst and p0 .. p3, with the observed shares y0 .. y3."""
    table = F.array(*[F.lit(float(t)) for t in theta])
    score = lambda s: F.aggregate(f"x{s}", F.lit(0.0), lambda a, e: a + e["v"] * F.element_at(table, e["f"] + 1))
    ps = softmax([F.lit(0.0), score(1), score(2), score(3)])
    return pair_rows(model).select("src", "dst", *[p.alias(f"p{s}") for s, p in enumerate(ps)], *[f"y{s}" for s in range(4)])


def marginals(pairs: DataFrame) -> DataFrame:
    """Edge probabilities from state probabilities: src, dst, p."""
    up = pairs.select("src", "dst", (F.col("p1") + F.col("p3")).alias("p"))
    return up.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("p2") + F.col("p3")).alias("p")))
