"""Paths of two edges in undirected graphs, counted in blocks of nodes.

A node that many edges meet lies on as many paths as pairs of its neighbours. These pairs are never
rows: what a node's neighbours are in each block of nodes goes as a list to the pairs of blocks, and
each pair of blocks counts for itself, in a stream. A task holds one pair of blocks, whatever the
number of nodes and paths; what is shuffled is, for each edge, an entry for each block that its end
has neighbours in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes in a block; places in it are short integers.
BLOCK = 1024
#: So many rows of lists become a matrix at once, so many paths a list of codes; beyond that a block counts in a matrix.
ROWS, CODES = 2048, BLOCK * BLOCK // 4


def _block(name: str):
    return F.shiftright(name, BLOCK.bit_length() - 1)


def _place(name: str):
    return (F.col(name).bitwiseAND(F.lit(BLOCK - 1))).cast("short")


def _ends(edges: DataFrame) -> DataFrame:
    """graph_id, i <= j (blocks), a, b: the places in both of what the edges to dst come from; b is null where i = j."""
    spread = edges.select("graph_id", "src", "dst").repartition("graph_id", "dst")
    lists = spread.groupBy("graph_id", "dst", _block("src").alias("i")).agg(F.collect_list(_place("src")).alias("a"))
    of_node = lists.groupBy("graph_id", "dst").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("own"))
    first = of_node.select("graph_id", "own", F.posexplode("own").alias("at", "x"))
    both = first.select("graph_id", "x", F.explode(F.slice("own", F.col("at") + 1, F.size("own"))).alias("y"))
    return both.select("graph_id", F.col("x.i").alias("i"), F.col("y.i").alias("j"), F.col("x.a").alias("a"), F.when(F.col("x.i") != F.col("y.i"), F.col("y.a")).alias("b"), F.lit(False).alias("closing"))


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("graph_id", "i", "j").sortWithinPartitions("graph_id", "i", "j")


class _Pair:
    """The paths between two blocks, counted as they come."""

    def __init__(self, key: tuple[int, int, int]):
        self.key, self.codes, self.size, self.matrix, self.closing = key, [], 0, None, []

    def take(self, a: pa.ListArray, b: pa.ListArray, closing: np.ndarray) -> None:
        for low in range(0, len(a), ROWS):
            x, y, ends = a.slice(low, ROWS), b.slice(low, ROWS), closing[low : low + ROWS]
            if self.key[1] == self.key[2]:
                mask = pa.array(ends)
                if ends.any():
                    self._add(*_listed(x.filter(mask)), *_listed(y.filter(mask)), True)
                x = x.filter(pa.array(~ends)) if ends.any() else x
                self._add(*_listed(x), *_listed(x), False)
            else:
                for kind in (True, False):
                    if (ends == kind).any():
                        mask = pa.array(ends == kind)
                        self._add(*_listed(x.filter(mask)), *_listed(y.filter(mask)), kind)

    def _add(self, la: np.ndarray, va: np.ndarray, lb: np.ndarray, vb: np.ndarray, closing: bool) -> None:
        """Rows of lists: their lengths, and their values one after the other."""
        each = la * lb
        total = int(each.sum())
        if closing:
            self.closing.append(_codes(la, va, lb, vb, each, total))
        elif self.matrix is None and self.size + total <= CODES:
            self.size += total
            self.codes.append(_codes(la, va, lb, vb, each, total))
        else:
            if self.matrix is None:
                held = np.concatenate([np.zeros(0, np.int64), *self.codes])
                self.matrix, self.codes = np.bincount(held, minlength=BLOCK * BLOCK).reshape(BLOCK, BLOCK).astype(np.float64), []
            x, y = _matrix(la, va), _matrix(lb, vb)
            self.matrix += x.T @ y  # of at most ROWS rows, so that single precision is exact

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of pairs of nodes and the numbers of their paths; in one block of pairs in ascending order only."""
        if self.matrix is not None:
            codes = np.flatnonzero(self.matrix)
            found = self.matrix.ravel()[codes]
        else:
            codes, found = np.unique(np.concatenate([np.zeros(0, np.int64), *self.codes]), return_counts=True)
        if self.key[1] == self.key[2]:
            up = codes // BLOCK < codes % BLOCK
            codes, found = codes[up], found[up]
        return codes, found.astype(np.float64)

    def closed(self) -> float:
        """How many paths an edge closes."""
        ends = np.concatenate([np.zeros(0, np.int64), *self.closing])
        if self.matrix is not None:
            return float(self.matrix.ravel()[ends].sum())
        return float(np.isin(np.concatenate([np.zeros(0, np.int64), *self.codes]), ends).sum())


def _listed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _codes(la, va, lb, vb, each, total) -> np.ndarray:
    """All pairs of values of both lists, row by row, as one integer each."""
    row = np.repeat(np.arange(len(each)), each)
    at = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
    return va[(np.cumsum(la) - la)[row] + at // lb[row]] * BLOCK + vb[(np.cumsum(lb) - lb)[row] + at % lb[row]]


def _matrix(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.repeat(np.arange(len(lengths)), lengths) * BLOCK + values
    return np.bincount(at, minlength=len(lengths) * BLOCK).reshape(len(lengths), BLOCK).astype(np.float32)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Pair]:
    """Rows in the order of their blocks, as one whole for each pair of blocks."""
    now: _Pair | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g, i, j, closing = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("graph_id", "i", "j", "closing"))
        a, b = batch.column("a"), batch.column("b")
        cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(g)], strict=True):
            key = (int(g[low]), int(i[low]), int(j[low]))
            if now is None or now.key != key:
                if now is not None:
                    yield now
                now = _Pair(key)
            now.take(a.slice(low, high - low), b.slice(low, high - low), closing[low:high])
    if now is not None:
        yield now


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pair in _pairs(batches):
        (g, i, j), (codes, found) = pair.key, pair.counts()
        if len(codes):
            src, dst = (i * BLOCK + codes // BLOCK).astype(np.int32), (j * BLOCK + codes % BLOCK).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), g, np.int64)), pa.array(src), pa.array(dst), pa.array(found)], ["graph_id", "src", "dst", "v"])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pair in _pairs(batches):
        if pair.closing and (found := pair.closed()):
            yield pa.RecordBatch.from_arrays([pa.array([pair.key[0]], pa.int64()), pa.array([found])], ["graph_id", "v"])


def common_neighbours(edges: DataFrame) -> DataFrame:
    """graph_id, src < dst, v: how many nodes have an edge to both, for all pairs that have any. edges: graph_id, src < dst."""
    ways = edges.select("graph_id", "src", "dst").unionByName(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return _in_order(_ends(ways)).mapInArrow(_counted, "graph_id long, src int, dst int, v double")


def triangles(edges: DataFrame) -> DataFrame:
    """graph_id, v: parts of the number of triangles, to be summed. edges: graph_id, src < dst.

    The largest node of a triangle makes a path between the others, which the edge of these closes.
    """
    ends = edges.groupBy("graph_id", _block("src").alias("i"), _block("dst").alias("j"), "src").agg(F.array(_place("src")).alias("a"), F.collect_list(_place("dst")).alias("b"))
    closing = ends.select("graph_id", "i", "j", "a", "b", F.lit(True).alias("closing"))
    return _in_order(_ends(edges).unionByName(closing)).mapInArrow(_closed, "graph_id long, v double")
