"""Forms without a dense matrix against the dense ones, and reports of the command line."""

import json
import os

import numpy as np
import pandas as pd
import pytest

from graphwright import __main__ as command
from graphwright.graph import Graph, GraphError
from graphwright.operators import dynamics, signals, sparse, spectral
from graphwright.plans import experiments


def links(n, seed, extra=3):
    """A ring with random chords of random weights, as places of ends and weights, both ways; no self loops, each pair once."""
    r = np.random.default_rng(seed)
    pairs = {(min(a, b), max(a, b)) for a, b in [(k, (k + 1) % n) for k in range(n)] + r.integers(0, n, (extra * n, 2)).tolist() if a != b}
    i, j = np.array(sorted(pairs)).T
    w = r.uniform(0.2, 2.0, len(i))
    return np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])


def matrix(n, i, j, w):
    a = np.zeros((n, n))
    np.add.at(a, (i, j), w)
    return a


@pytest.mark.parametrize("kind", ["unnormalized", "normalized", "random-walk"])
def test_lowest_equals_dense(kind):
    n, k = 600, 12
    i, j, w = links(n, 1)
    values, vectors = sparse.lowest(sparse.EdgeLaplacian(n, i, j, w, kind), k)
    lap = spectral.laplacian(matrix(n, i, j, w), kind)
    want = np.linalg.eigvalsh((lap + lap.T) / 2)[:k]
    assert np.allclose(values, want, atol=1e-7)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-9)
    assert np.abs((lap + lap.T) / 2 @ vectors - vectors * values).max() < 1e-5


def test_lowest_asymmetric_is_symmetrised():
    n = 80
    i, j, w = links(n, 2)
    w = w * np.random.default_rng(3).uniform(0.5, 1.5, len(w))
    lap = spectral.laplacian(matrix(n, i, j, w))
    assert np.allclose(sparse.lowest(sparse.EdgeLaplacian(n, i, j, w), 5)[0], np.linalg.eigvalsh((lap + lap.T) / 2)[:5], atol=1e-7)


def test_lowest_finds_every_part_of_a_broken_graph():
    parts = [links(120, s) for s in range(4)]
    i, j, w = (np.concatenate([p[c] + (120 * t if c < 2 else 0) for t, p in enumerate(parts)]) for c in range(3))
    values, _ = sparse.lowest(sparse.EdgeLaplacian(481, i, j, w), 7)  # one node without edges
    assert (values[:5] == 0).all() and (values[5:] > 1e-6).all()


def test_lowest_without_edges_and_without_convergence():
    none = np.zeros(0, np.int64)
    assert (sparse.lowest(sparse.EdgeLaplacian(10, none, none, np.zeros(0)), 3)[0] == 0).all()
    with pytest.raises(GraphError, match="settle"):
        sparse.lowest(sparse.EdgeLaplacian(600, *links(600, 4)), 10, rounds=1)


def test_decompose_beyond_the_dense_limit(spark):
    n = 6000
    i, j, w = links(n, 5)
    half = i < j
    g = Graph.from_edges(spark.createDataFrame(pd.DataFrame({"src": i[half], "dst": j[half], "weight": w[half]})))
    with pytest.raises(Exception, match="too many"):
        spectral.decompose(g).count()
    s = spectral.decompose(g, "normalized", k=4)
    m = [r.eigenvalue for r in spectral.modes(s).orderBy("mode").collect()]
    assert len(m) == 4 and m[0] == 0 and 0 < m[1] <= m[2] <= m[3] and s.count() == 4 * n


def test_decompose_of_small_graphs_is_dense(spark):
    i, j, w = links(40, 6)
    g = Graph.from_matrix(spark, matrix(40, i, j, w))
    whole = {(r.mode, r.node): r.v for r in spectral.decompose(g).where("mode < 3").collect()}
    first = {(r.mode, r.node): r.v for r in spectral.decompose(g, k=3).collect()}
    assert whole.keys() == first.keys() and all(abs(whole[x] - first[x]) < 1e-9 for x in whole)
    assert spectral.decompose(g, k=99).select("mode").distinct().count() == 40


def test_joined_filters_equal_kernels(spark):
    i, j, w = links(30, 7)
    a = np.zeros((31, 31))  # the last node is isolated
    a[:30, :30] = matrix(30, i, j, w)
    g = Graph.from_matrix(spark, a)
    x = dynamics.seeds(g, [0, 30], strengths=[1.0, 2.0]).union(dynamics.seeds(g, [4], signal="other"))
    for got, want in [(sparse.heat_smooth_joined(g, x, 0.3), spectral.heat_smooth(g, x, 0.3)), (sparse.chebyshev_joined(g, x, lambda z: 1 / (1 + z), order=40), spectral.tikhonov(g, x))]:
        a, b = ({(r.signal, r.node): r.value for r in d.collect()} for d in (got, want))
        assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6
    assert sparse.heat_smooth_joined(g, x.where("node < 0"), 0.3).count() == 0


def test_denoise_all(spark):
    i, j, w = links(20, 8)
    g = Graph.from_matrix(spark, matrix(20, i, j, w))
    x = dynamics.seeds(g, [0]).union(dynamics.seeds(g, [4], signal="other"))
    for method in ("tikhonov", "heat", "wavelet"):
        assert spectral.denoise_all(g, x, method=method).groupBy("signal").count().count() == 2
    with pytest.raises(GraphError, match="method"):
        spectral.denoise_all(g, x, method="none")


def test_report_of_a_matrix_file(spark, tmp_path, capsys):
    i, j, w = links(12, 9)
    path = str(tmp_path / "a.csv")
    np.savetxt(path, matrix(12, i, j, w), delimiter=",")
    params = json.dumps({"seed_nodes": [0], "target_nodes": [5], "steps": 5, "max_edges": 3, "interventions": [{"kind": "remove_node", "nodes": [3]}]})
    assert command.main(["report", "counterfactual", "--csv", path, "--out", str(tmp_path / "out"), "--params", params]) == 0
    found = [f for _, _, fs in os.walk(tmp_path / "out") for f in fs]
    assert {"summary.json", "report.md", "report.html"} <= set(found) and sum("sensitivity" in f for f in found) >= 2
    capsys.readouterr()
    assert command.main(["kinds"]) == 0
    assert capsys.readouterr().out.split() == experiments.task_kinds()


def test_bound_holds(spark):
    i, j, w = links(15, 10)
    g = Graph.from_matrix(spark, matrix(15, i, j, w))
    assert np.linalg.eigvalsh(spectral.laplacian(matrix(15, i, j, w)))[-1] <= sparse.largest_bound(g)
    assert signals.aligned(g, dynamics.seeds(g)).count() == 15
