import itertools
import random

import numpy as np
import pytest

from dyadspark.operators import metrics as M
from dyadspark.operators import paths
from dyadspark.operators.collection import Collection
from dyadspark.sources.graphs import cosupply_graph, graph_from_edges


def drawn(n, p, seed, count=1):
    toss = random.Random(seed)
    return [(g, i, j) for g in range(count) for i, j in itertools.combinations(range(n), 2) if toss.random() < p]


@pytest.mark.parametrize("n, p, block, codes", [(40, 0.3, 8, 0), (40, 0.3, 8, 10**6), (40, 0.1, 64, 5), (70, 0.05, 16, 10)])
def test_neighbours_in_common_are_those_of_the_matrix(n, p, block, codes, monkeypatch):
    """Blocks in small, in one process: many pairs of blocks, in matrices, in codes, and from codes to a matrix."""
    monkeypatch.setattr(paths, "BLOCK", block)
    monkeypatch.setattr(paths, "CODES", codes)
    monkeypatch.setattr(paths, "ROWS", 7)
    import pyarrow as pa

    edges = drawn(n, p, 5)
    y = np.zeros((n, n), dtype=int)
    for _, i, j in edges:
        y[i, j] = y[j, i] = 1
    up = np.triu(y)
    rows = []
    for nodes, closing in ((y, False), (up, True)):
        for k in range(n):
            if closing:
                mine = [(k // block, b, [k % block], [d % block for d in np.flatnonzero(up[k]) if d // block == b], True) for b in range(n // block + 1)]
                rows += [r for r in mine if r[3]]
                continue
            at = {b: [d % block for d in np.flatnonzero(nodes[k]) if d // block == b] for b in range(n // block + 1)}
            rows += [(i, j, at[i], at[j] if i != j else None, False) for i in at for j in at if i <= j and at[i] and at[j]]
    rows.sort(key=lambda r: r[:2])

    def batches():
        for low in range(0, len(rows), 50):
            part = rows[low : low + 50]
            columns = list(zip(*part, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int16()), pa.list_(pa.int16()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(part), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["graph_id", "i", "j", "a", "b", "closing"])

    squared = y @ y
    got = {(s, d): v for b in paths._counted(batches()) for _, s, d, v in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    assert got == {(i, j): squared[i, j] for i, j in itertools.combinations(range(n), 2) if squared[i, j]}
    # every triangle has three edges, each of them closing a path
    assert sum(b.column("v").to_pylist()[0] for b in paths._closed(batches())) == np.trace(y @ squared) / 2


def test_change_scores_across_blocks(spark):
    """Nodes at the edges of blocks, and far from each other."""
    places = [0, 1, 1023, 1024, 1025, 2047, 2048, 5000]
    edges = [(places[i], places[j]) for _, i, j in drawn(len(places), 0.6, 3)]
    graph = graph_from_edges(spark, 5001, edges, directed=False)
    both = set(edges) | {(d, s) for s, d in edges}
    near = {x: {d for s, d in both if s == x} for x in places}
    want = {(i, j): (-1 if (i, j) in both else 1) * len(near[i] & near[j]) for i, j in itertools.combinations(places, 2) if near[i] & near[j]}
    got = Collection([M.Triangles(False)], graph).change_scores().collect()
    assert {(r["src"], r["dst"]): r["change"] for r in got} == want


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_lines_of_suppliers_are_not_broadcast_and_dyads_not_listed(spark):
    """Few bytes in a file may be many rows; pairs of suppliers without common neighbours are no rows."""
    graph = cosupply_graph(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in physical(graph.edges)
    assert "Range (" not in physical(Collection([M.Triangles(False)], graph).change_scores())


def test_triangles_across_blocks_and_graphs(spark):
    places = [0, 1, 1022, 1023, 1024, 1025, 2047, 2048, 5000]
    edges = [(g, places[i], places[j]) for g, i, j in drawn(len(places), 0.6, 8, 3)]
    graph = graph_from_edges(spark, 5001, edges, directed=False, count=4)
    on = set(edges)
    want = [float(sum((g, a, b) in on and (g, b, c) in on and (g, a, c) in on for a, b, c in itertools.combinations(places, 3))) for g in range(4)]
    assert want[0] > 0 and want[3] == 0
    got = Collection([M.Triangles(False)], graph).sample_statistics().orderBy("graph_id").collect()
    assert [r["value"] for r in got] == want


def test_paths_to_triangles_are_no_rows(spark):
    graph = graph_from_edges(spark, 4, [(0, 1), (1, 2), (0, 2)], directed=False)
    plan = physical(M.Triangles(False).values(graph))
    assert "MapInArrow" in plan and "Join" not in plan
