"""Triangles by blocks against dense products."""

import numpy as np
import pyarrow as pa
import pytest

from graphwright.graph import Graph
from graphwright.operators import triangles


@pytest.mark.parametrize("most", [1 << 22, 40])
def test_support_equals_dense_product(spark, monkeypatch, most):
    monkeypatch.setattr(triangles, "MOST", most)
    monkeypatch.setattr(triangles, "LEAST", 1)
    rng, rows, want = np.random.default_rng(1), [], {}
    for g, n, p, low in (("a", 30, 0.3, 0), ("b", 40, 0.1, -20), ("hubs", 60, 0.02, 0)):
        up = np.triu(rng.random((n, n)) < p, 1)
        if g == "hubs":
            up[0, 1:] = up[1:-1, -1] = True
        b = (up | up.T).astype(int)
        for i, j in zip(*np.nonzero(up), strict=True):
            rows.append((g, int(i) + low, int(j) + low, 0.5 + int(i)))
            want[g, int(i) + low, int(j) + low] = (0.5 + i, int((b[i] & b[j]).sum()))
    g = Graph.from_edges(spark.createDataFrame(rows, "graph_id string, src int, dst int, weight double"))
    got = {(r.graph_id, r.src, r.dst): (r.weight, r.support) for r in triangles.support(g).collect()}
    assert got == want and sum(n for _, n in want.values()) > 500


def test_shuffle_carries_lists_and_not_wedges():
    """A complete graph of 400 nodes has 10 million wedges; what is sent is at most each edge once per block."""
    n, cuts = 400, [("g", 100), ("g", 200), ("g", 300)]
    lists = [np.arange(k + 1, n, dtype="int32") for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(["g"] * n), pa.array(range(n), pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["graph_id", "node", "near"])
    sent = pa.Table.from_batches(triangles.sender(cuts)([batch]))
    assert len(sent["near"].combine_chunks().flatten()) <= (len(cuts) + 1) * n * (n - 1) // 2
    found = pa.Table.from_batches(triangles.counted(sent.sort_by([("block", "ascending"), ("kind", "ascending")]).to_batches()))
    assert sum(found["n"].combine_chunks().flatten().to_pylist()) == n * (n - 1) * (n - 2) // 2
