"""Propagation of signals: Euler heat flow, hops, lazy walks, personalised PageRank.

run() propagates every signal of every graph in a kernel per graph (all signals of a graph are columns of one matrix); run_joined() does the
same by join and aggregate for graphs whose matrix doesn't fit a task; scan() fans seeds out over tasks.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, GraphError, dense, per_graph_and_signal, settled
from .matrices import degrees, laplacian_entries, product, transition_entries

MODELS = {"diffusion": "heat", "laplacian": "heat", "heat": "heat", "euler_heat": "heat", "discrete": "hop", "hop": "hop", "discrete_hop": "hop", "lazy_random_walk": "lazy", "lazy": "lazy", "personalized_pagerank": "pagerank", "pagerank": "pagerank"}
STATE = "signal string, node int, value double"


def model_of(name: str) -> str:
    try:
        return MODELS[name.strip().lower()]
    except KeyError:
        raise GraphError(f"unknown model {name!r}") from None


def stepper(a: np.ndarray, model: str, dt: float, x0: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """One step for states as columns."""
    degree = a.sum(1)
    if model == "heat":
        return lambda x: x - dt * (degree[:, None] * x - a @ x)
    if model == "hop":
        def hop(x: np.ndarray) -> np.ndarray:
            y = a @ x
            return y / (np.abs(y).sum(0) + 1e-12)

        return hop
    p = np.divide(a, degree[:, None], out=np.zeros_like(a), where=degree[:, None] > 1e-12)
    m = min(max(dt, 0.0), 1.0)
    if model == "lazy":
        return lambda x: (1 - m) * x + m * (p.T @ x)
    teleport = np.maximum(x0, 0)
    mass = teleport.sum(0)
    teleport = np.where(mass > 1e-12, teleport / np.where(mass > 1e-12, mass, 1), 1 / len(a))
    return lambda x: (1 - m) * (p.T @ x) + m * teleport


def evolve(a: np.ndarray, x0: np.ndarray, *, model: str = "heat", steps: int = 60, dt: float = 0.1, clamp: bool = False, renormalize: bool = False, final_clamp: bool = False, norm: str = "none", keep: bool = False) -> np.ndarray:
    """The last state (n x signals), or with keep all of them (steps + 1, n, signals)."""
    x, step = x0.astype(float).copy(), stepper(a, model, dt, x0)
    if model == "pagerank":
        x = np.maximum(x, 0)
        mass = x.sum(0)
        x = np.where(mass > 1e-12, x / np.where(mass > 1e-12, mass, 1), 1 / len(a))
    states = [x] if keep else []
    for _ in range(steps):
        x = step(x)
        if clamp:
            x = np.maximum(x, 0)
        if renormalize:
            mass = np.abs(x).sum(0)
            x = np.where(mass > 1e-12, x / np.where(mass > 1e-12, mass, 1), x)
        if keep:
            states.append(x)
    if final_clamp:
        x = np.maximum(x, 0)
    x = scaled(x, norm)
    return np.array(states) if keep else x


def scaled(x: np.ndarray, norm: str, *, tiny_to_zero: bool = True) -> np.ndarray:
    """none, l1, l2, max, sum or zscore by column; a column of tiny scale becomes zeros, or stays."""
    if norm in ("none", "raw"):
        return x
    y = x - x.mean(0) if norm == "zscore" else x
    scale = {"l1": lambda: np.abs(x).sum(0), "l2": lambda: np.sqrt((x * x).sum(0)), "max": lambda: np.abs(x).max(0), "sum": lambda: x.sum(0), "zscore": lambda: x.std(0)}[norm]()
    ok = np.abs(scale) > 1e-12
    return np.where(ok, y / np.where(ok, scale, 1), 0.0 if tiny_to_zero else x)


def stability(graph: Graph, dt: float) -> DataFrame:
    """(graph_id, bound, stable): 2 dt times the largest degree; Euler steps are unstable if it is over about 2."""
    d = degrees(graph).groupBy("graph_id").agg((2 * dt * F.max("degree")).alias("bound"))
    return d.withColumn("stable", F.col("bound") <= 2.1)


def warn_if_unstable(graph: Graph, dt: float) -> None:
    bad = stability(graph, dt).where("not stable").first()
    if bad:
        warnings.warn(f"dt {dt} is too large for graph {bad.graph_id!r}: 2 dt max degree = {bad.bound:.3g}", stacklevel=2)


def run(graph: Graph, signals: DataFrame, *, model: str = "diffusion", steps: int = 60, dt: float = 0.1, **options) -> DataFrame:
    """(graph_id, signal, node, value) after so many steps."""
    kind = model_of(model)

    def kernel(a: np.ndarray, ids: np.ndarray, vectors: dict) -> dict:
        names = list(vectors)
        x = evolve(a, np.column_stack([vectors[k] for k in names]) if names else np.zeros((len(a), 0)), model=kind, steps=steps, dt=dt, **options)
        return {"signal": np.repeat(names, len(ids)), "node": np.tile(ids, len(names)), "value": x.T.ravel()}

    return per_graph_and_signal(graph, signals, kernel, STATE)


def trajectory(graph: Graph, signals: DataFrame, *, model: str = "diffusion", steps: int = 60, dt: float = 0.1, **options) -> DataFrame:
    """(graph_id, signal, t, node, value) for t = 0 to steps."""
    kind = model_of(model)

    def kernel(a: np.ndarray, ids: np.ndarray, vectors: dict) -> dict:
        names, n = list(vectors), len(ids)
        x = evolve(a, np.column_stack([vectors[k] for k in names]) if names else np.zeros((n, 0)), model=kind, steps=steps, dt=dt, keep=True, **options)
        return {
            "signal": np.repeat(names, n * (steps + 1)), "t": np.tile(np.repeat(np.arange(steps + 1), n), len(names)),
            "node": np.tile(ids, (steps + 1) * len(names)), "value": x.transpose(2, 0, 1).ravel(),
        }

    return per_graph_and_signal(graph, signals, kernel, "signal string, t int, node int, value double")


def run_joined(graph: Graph, signals: DataFrame, *, model: str = "diffusion", steps: int = 60, dt: float = 0.1, every: int = 2) -> DataFrame:
    """The same as run() for graphs of any size: each step is a join and an aggregate; lineage is cut every few steps."""
    kind = model_of(model)
    names = signals.select("graph_id", "signal").distinct()
    full = graph.nodes.join(names, "graph_id").join(signals, ["graph_id", "signal", "node"], "left").select("graph_id", "signal", "node", F.coalesce("value", F.lit(0.0)).alias("value"))
    teleport = None
    if kind == "heat":
        lap = laplacian_entries(graph)
        m = lap.select("graph_id", "i", "j", (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - dt * F.col("value")).alias("value"))
    elif kind == "hop":
        m = graph.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("value"))
    else:
        share = min(max(dt, 0.0), 1.0)
        walk = transition_entries(graph).select("graph_id", F.col("j").alias("i"), F.col("i").alias("j"), "value")
        if kind == "lazy":
            stay = graph.nodes.select("graph_id", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1 - share).alias("value"))
            m = walk.withColumn("value", F.col("value") * share).union(stay).groupBy("graph_id", "i", "j").agg(F.sum("value").alias("value"))
        else:
            m = walk.withColumn("value", F.col("value") * (1 - share))
            mass = full.groupBy("graph_id", "signal").agg(F.sum(F.greatest("value", F.lit(0.0))).alias("mass"), F.count("*").alias("n"))
            start = F.when(F.col("mass") > 1e-12, F.greatest("value", F.lit(0.0)) / F.when(F.col("mass") > 1e-12, F.col("mass")).otherwise(1.0)).otherwise(1 / F.col("n"))
            full = full.join(mass, ["graph_id", "signal"]).select("graph_id", "signal", "node", start.alias("value"))
            teleport = full.select("graph_id", "signal", "node", (F.col("value") * share).alias("t"))
    m, x = settled(m), settled(full)
    base = x.select("graph_id", "signal", "node")
    for k in range(steps):
        x = base.join(product(m, x), ["graph_id", "signal", "node"], "left").na.fill(0.0, ["value"])
        if kind == "hop":
            norm = x.groupBy("graph_id", "signal").agg(F.sum(F.abs("value")).alias("s"))
            x = x.join(norm, ["graph_id", "signal"]).select("graph_id", "signal", "node", (F.col("value") / (F.col("s") + 1e-12)).alias("value"))
        if teleport is not None:
            x = x.join(teleport, ["graph_id", "signal", "node"]).select("graph_id", "signal", "node", (F.col("value") + F.col("t")).alias("value"))
        if (k + 1) % every == 0:
            x = settled(x)
    return x


def seeds(graph: Graph, nodes: list[int] | None = None, *, strength: float = 1.0, strengths: list[float] | None = None, signal: str = "seed", accumulate: bool = False, skip_outside: bool = True) -> DataFrame:
    """A signal with strengths at nodes: assigned (the default node is 0) or, with accumulate, added up; others 0."""
    nodes = [0] if not nodes and not accumulate else list(nodes or [])
    values = list(strengths) if strengths is not None else [strength] * len(nodes)
    if len(values) != len(nodes):
        raise GraphError("as many strengths as nodes are needed")
    held: dict[int, float] = {}
    for i, v in zip(nodes, values, strict=True):
        held[int(i)] = held.get(int(i), 0.0) + float(v) if accumulate else float(v)
    if not skip_outside and held:
        known = {r[0] for r in graph.nodes.where(F.col("node").isin(list(held))).select("node").distinct().collect()}
        if missing := sorted(set(held) - known):
            raise GraphError(f"seeds outside the graph: {missing}")
    value = F.lit(0.0)
    for i, v in held.items():
        value = F.when(F.col("node") == i, F.lit(v)).otherwise(value)
    return graph.nodes.select("graph_id", F.lit(signal).alias("signal"), "node", value.alias("value"))


def forward(graph: Graph, *, model: str = "diffusion", seed_nodes: list[int] | None = None, steps: int = 60, dt: float = 0.1, seed_strength: float = 1.0) -> DataFrame:
    return run(graph, seeds(graph, seed_nodes, strength=seed_strength), model=model, steps=steps, dt=dt)


def scan(graph: Graph, *, model: str = "diffusion", steps: int = 60, dt: float = 0.1, chunk: int = 256) -> DataFrame:
    """(graph_id, node, score): the sum of absolute values that a unit seed at each node ends with. Seeds are dealt to tasks in chunks, with their graph."""
    kind = model_of(model)
    parts = graph.nodes.groupBy("graph_id").agg(F.max("node").alias("m")).select("graph_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / chunk).cast("int"))).alias("part"))
    e, v = graph.edges.join(parts, "graph_id"), graph.nodes.join(parts, "graph_id")

    def kernel(key: tuple, edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        a, ids, _ = dense(edges, nodes)
        mine = np.flatnonzero(ids // chunk == key[1])
        x0 = np.zeros((len(ids), len(mine)))
        x0[mine, np.arange(len(mine))] = 1
        x = evolve(a, x0, model=kind, steps=steps, dt=dt)
        return pd.DataFrame({"graph_id": key[0], "node": ids[mine], "score": np.abs(x).sum(0)})

    v = v.select(F.col("graph_id").alias("g"), F.col("part").alias("p"), "node", "label")
    return e.groupBy("graph_id", "part").cogroup(v.groupBy("g", "p")).applyInPandas(kernel, "graph_id string, node int, score double")


def inverse(signals: DataFrame) -> DataFrame:
    """y / (|y| + 1e-12) for each observed signal."""
    norm = signals.groupBy("graph_id", "signal").agg((F.sqrt(F.sum(F.col("value") ** 2)) + 1e-12).alias("norm"))
    return signals.join(norm, ["graph_id", "signal"]).select("graph_id", "signal", "node", (F.col("value") / F.col("norm")).alias("value"))


def mediation(graph: Graph) -> DataFrame:
    """(graph_id, node, score): how many neighbours a node has."""
    return degrees(graph).select("graph_id", "node", F.col("links").alias("score"))


def polynomial(graph: Graph, signals: DataFrame, coefficients: list[float]) -> DataFrame:
    """sum of c_k L^k x."""

    def kernel(a: np.ndarray, ids: np.ndarray, vectors: dict) -> dict:
        lap = np.diag(a.sum(1)) - a
        out = {"signal": [], "node": [], "value": []}
        for name, x in vectors.items():
            y, p = np.zeros(len(x)), x
            for c in coefficients:
                y, p = y + c * p, lap @ p
            out["signal"] += [name] * len(ids)
            out["node"] += ids.tolist()
            out["value"] += y.tolist()
        return out

    return per_graph_and_signal(graph, signals, kernel, STATE)


def operator_entries(graph: Graph, dt: float) -> DataFrame:
    """I - dt L as entries."""
    e = laplacian_entries(graph)
    return e.select("graph_id", "i", "j", (F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0) - dt * F.col("value")).alias("value"))


def lanczos(a: np.ndarray, x: np.ndarray, m: int, lap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis (n x k) and tridiagonal matrix (k x k) of a Krylov space of L, fully reorthogonalised; k = 0 for a zero signal."""
    lap = np.diag(a.sum(1)) - a if lap is None else lap
    norm = np.linalg.norm(x)
    if norm <= 1e-12:
        return np.zeros((len(x), 0)), np.zeros((0, 0))
    q, alpha, beta = [x / norm], [], []
    for k in range(min(m, len(x))):
        w = lap @ q[k]
        alpha.append(float(q[k] @ w))
        basis = np.array(q)
        for _ in range(2):
            w = w - basis.T @ (basis @ w)
        b = float(np.linalg.norm(w))
        if b <= 1e-12 or k + 1 == min(m, len(x)):
            break
        beta.append(b)
        q.append(w / b)
    t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
    return np.array(q[: len(alpha)]).T, t


def heat_lanczos(a: np.ndarray, x: np.ndarray, time: float, m: int = 30) -> np.ndarray:
    """exp(-t L) x from a Krylov space."""
    q, t = lanczos(a, x, m)
    if not q.shape[1]:
        return np.zeros(len(x))
    values, vectors = np.linalg.eigh(t)
    return np.linalg.norm(x) * (q @ (vectors @ (np.exp(-time * values) * vectors[0])))


def chebyshev_coefficients(transfer: Callable, order: int, lmax: float, grid: int = 2048) -> np.ndarray:
    """order + 1 coefficients of transfer on [0, lmax], from Chebyshev nodes; the first is halved."""
    m = max(grid, 4 * (order + 1))
    theta = np.pi * (np.arange(m) + 0.5) / m
    g = transfer(lmax / 2 * (np.cos(theta) + 1))
    c = 2 / m * np.cos(np.outer(np.arange(order + 1), theta)) @ g
    c[0] /= 2
    return c


def chebyshev_apply(a: np.ndarray, x: np.ndarray, c: np.ndarray, lmax: float) -> np.ndarray:
    if lmax <= 1e-12:
        lmax = 1.0
    lap = np.diag(a.sum(1)) - a
    shifted = lambda v: 2 / lmax * (lap @ v) - v
    before, now = x, shifted(x)
    y = c[0] * before + (c[1] * now if len(c) > 1 else 0)
    for k in range(2, len(c)):
        before, now = now, 2 * shifted(now) - before
        y = y + c[k] * now
    return y


def per_signal(graph: Graph, signals: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """f(matrix, vector) for every signal of every graph."""

    def kernel(a: np.ndarray, ids: np.ndarray, vectors: dict) -> dict:
        names = list(vectors)
        return {"signal": np.repeat(names, len(ids)), "node": np.tile(ids, len(names)), "value": np.concatenate([f(a, vectors[k]) for k in names]) if names else []}

    return per_graph_and_signal(graph, signals, kernel, STATE)


