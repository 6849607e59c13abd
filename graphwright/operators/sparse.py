"""Forms for graphs whose dense matrix is out of reach: lowest modes from edge lists, and polynomial filters as joins.

lowest() holds one graph's edges and a block of k + a few vectors in a task, no matrix; chebyshev_joined() holds nothing but rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, GraphError, settled
from .dynamics import chebyshev_coefficients
from .matrices import EPS, canonical_kind, degrees, laplacian_entries, product
from .signals import ONE, aligned

#: Steps of the polynomial that damps the modes above the wanted ones, rounds at most, and the residual that ends them (as a share of the largest eigenvalue's bound).
DEGREE, ROUNDS, TOLERANCE = 20, 400, 1e-9


class EdgeLaplacian:
    """A Laplacian by its edges, symmetrised: applied to blocks of vectors, bounded by its rows (Gershgorin)."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, kind: str = "unnormalized", isolated_diagonal: float = 0.0):
        kind = canonical_kind(kind)
        d = np.bincount(i, w, n)
        on = d > EPS
        inverse = np.where(on, 1 / np.where(on, d, 1), 0)
        if kind == "unnormalized":
            diagonal, off = d, w
        elif kind == "normalized":
            root = np.sqrt(inverse)
            diagonal, off = np.where(on, 1.0, isolated_diagonal), w * root[i] * root[j]
        else:
            diagonal, off = np.ones(n), w * inverse[i]
        self.n, self.diagonal, self.off = n, diagonal, np.concatenate([off, off]) / 2
        self.i, self.j = np.concatenate([i, j]), np.concatenate([j, i])
        self.bound = float((diagonal + np.bincount(self.i, np.abs(self.off), n)).max(initial=0.0))

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        return self.diagonal[:, None] * x - np.stack([np.bincount(self.i, self.off * c[self.j], self.n) for c in x.T], axis=1)


def damped(m: EdgeLaplacian, x: np.ndarray, least: float, cut: float, degree: int) -> np.ndarray:
    """A scaled Chebyshev polynomial of m on x: small on [cut, bound], growing below it."""
    half, middle = (m.bound - cut) / 2, (m.bound + cut) / 2
    first = scale = half / (least - middle)
    before, now = x, (m @ x - middle * x) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (m @ now - middle * now) * (2 * following / half) - before * (scale * following)
        scale = following
    return now


def lowest(m: EdgeLaplacian, k: int, *, degree: int = DEGREE, rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k lowest eigenvalues and vectors by Chebyshev-filtered subspace iteration; a block finds eigenvalues of any multiplicity up to its width."""
    width = min(m.n, k + max(8, k // 2))
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((m.n, width)))[0]
    for _ in range(rounds):
        image = m @ x
        values, turn = np.linalg.eigh(x.T @ image)
        x, image = x @ turn, image @ turn
        if m.bound <= EPS or np.linalg.norm(image[:, :k] - x[:, :k] * values[:k], axis=0).max() <= tolerance * m.bound:
            values, x = values[:k].copy(), x[:, :k]
            values[np.abs(values) < 1e-10 * max(m.bound, 1.0)] = 0
            top = x[np.abs(x).argmax(0), np.arange(k)]
            return values, x * np.where(top < 0, -1, 1)
        x = np.linalg.qr(damped(m, x, min(values[0], 0.0), min(values[-1], 0.999 * m.bound), degree))[0]
    raise GraphError(f"{k} modes of {m.n} nodes did not settle in {rounds} rounds")


def per_graph_edges(graph: Graph, kernel: Callable, schema: str) -> DataFrame:
    """kernel(node ids, places of ends i and j, weights) gives the columns of the schema but graph_id, for each graph in a task of its own."""

    def run(key: tuple, edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(nodes["node"].to_numpy())
        ends = (np.searchsorted(ids, edges[c].to_numpy()) for c in ("src", "dst"))
        out = pd.DataFrame(kernel(ids, *ends, edges["weight"].to_numpy(float)))
        out.insert(0, "graph_id", key[0])
        return out

    return graph.edges.groupBy("graph_id").cogroup(graph.nodes.groupBy("graph_id")).applyInPandas(run, f"graph_id string, {schema}")


def largest_bound(graph: Graph) -> float:
    """No eigenvalue of any of the graphs' Laplacians is above it: twice the largest degree."""
    top = degrees(graph).agg(F.max("degree")).first()[0]
    return max(2 * float(top or 0.0), 1e-12)


def chebyshev_joined(graph: Graph, signals: DataFrame, transfer: Callable[[np.ndarray], np.ndarray], *, order: int = 40, every: int = 4) -> DataFrame:
    """transfer(L) x by a polynomial of some order, for graphs of any size: each term is a join and an aggregate. Last coefficients that can't be seen are left out."""
    bound = largest_bound(graph)
    c = chebyshev_coefficients(transfer, order, bound)
    seen = np.flatnonzero(np.abs(c) > 1e-15 * max(np.abs(c).max(), 1e-300))
    c = c[: seen[-1] + 1] if len(seen) else c[:1]
    entries = settled(laplacian_entries(graph))
    state = settled(aligned(graph, signals).select(*ONE, "node", F.lit(0.0).alias("before"), F.col("value").alias("now"), (F.col("value") * float(c[0])).alias("y")))
    for k, ck in enumerate(c[1:], 1):
        image = product(entries, state.select(*ONE, "node", F.col("now").alias("value"))).withColumnRenamed("value", "image")
        shifted = F.coalesce("image", F.lit(0.0)) * (2 / bound) - F.col("now")
        step = shifted if k == 1 else 2 * shifted - F.col("before")
        state = state.join(image, [*ONE, "node"], "left").select(*ONE, "node", F.col("now").alias("before"), step.alias("now"), (F.col("y") + float(ck) * step).alias("y"))
        if k % every == 0:
            state = settled(state)
    return state.select(*ONE, "node", F.col("y").alias("value"))


def heat_smooth_joined(graph: Graph, signals: DataFrame, time: float = 1.0, *, order: int = 40) -> DataFrame:
    """exp(-t L) x for graphs of any size; the order needed grows with the root of t times the largest degree."""
    return chebyshev_joined(graph, signals, lambda z: np.exp(-time * z), order=order)
