"""Evidence for pathways between sources and targets: current flow, conditioned walks, heat corridors, and their consensus."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, GraphError, dense, per_graph
from .spectral import eigen, laplacian
from .traversal import cost_matrix, diverse

SHARES_NODE = {"current": 0.34, "bridge": 0.28, "heat": 0.24, "geodesic": 0.14}
SHARES_EDGE = {"current": 0.36, "bridge": 0.30, "heat": 0.20, "geodesic": 0.14}
NODE_EVIDENCE = "node int, current double, bridge double, heat double, geodesic double, degree double"
EDGE_EVIDENCE = "i int, j int, weight double, cost double, current double, bridge double, heat double, geodesic double"


def distribution(n: int, nodes: list[int], weights: dict[int, float] | None = None) -> np.ndarray:
    x = np.zeros(n)
    for v in nodes:
        x[v] += max(0.0, (weights or {}).get(v, 1.0))
    return x / x.sum() if x.sum() > 1e-15 else np.full(n, 1 / n)


def potentials(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Centred solution of L phi = b with the last node grounded; the pseudoinverse's if that is singular."""
    lap, b = np.diag(a.sum(1)) - a, b - b.mean()
    try:
        x = np.append(np.linalg.solve(lap[:-1, :-1] + 1e-9 * np.eye(len(a) - 1), b[:-1]), 0.0)
        if not np.isfinite(x).all():
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        x = np.linalg.pinv(lap) @ b
    return x - x.mean()


def current(a: np.ndarray, s: list[int], t: list[int], ws: dict | None = None, wt: dict | None = None) -> dict:
    b = distribution(len(a), s, ws) - distribution(len(a), t, wt)
    phi = potentials(a, b)
    drop = np.abs(phi[:, None] - phi)
    edge = a * drop
    return {"potential": phi, "edge": edge, "node": edge.sum(1) / 2, "power": float((a * drop**2).sum() / 2), "resistance": float(b @ phi)}


def walk_matrix(a: np.ndarray, beta: float, strategy: str = "inverse") -> np.ndarray:
    """Rows in proportion to weight times exp(-beta cost); rows without any stay where they are."""
    cost = cost_matrix(a, strategy)
    w = np.where(np.isfinite(cost), a * np.exp(-beta * np.where(np.isfinite(cost), cost, 0)), 0)
    total = w.sum(1, keepdims=True)
    p = np.divide(w, total, out=np.zeros_like(w), where=total > 1e-15)
    lone = np.flatnonzero(total[:, 0] <= 1e-15)
    p[lone, lone] = 1
    return p


def _solve(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(m, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m) @ b


def bridge(a: np.ndarray, s: list[int], t: list[int], beta: float = 1.0, ws: dict | None = None) -> dict:
    """Expected visits of a walk from s that is told to reach t.

    h is the chance to reach t, N the visits of the free walk before that. Told so, the walk from i visits j N_ij h_j / h_i times and steps from j to k with
    the chance p_jk h_k / h_j (Doob's transform), so one factorisation gives both.
    """
    p, start, inside = walk_matrix(a, beta), distribution(len(a), s, ws), np.setdiff1d(np.arange(len(a)), t)
    h, visits, steps = np.ones(len(a)), np.zeros(len(a)), np.zeros_like(p)
    stay = (1 + 1e-12) * np.eye(len(inside)) - p[np.ix_(inside, inside)]
    h[inside] = np.clip(_solve(stay, p[np.ix_(inside, np.unique(t))].sum(1)), 0, 1)
    live = inside[h[inside] > 1e-15]
    odds = np.zeros(len(a))
    odds[live] = start[live] / h[live]
    visits[inside] = h[inside] * np.maximum(_solve(stay.T, odds[inside]), 0)
    steps[live] = p[live] * h / h[live, None]
    edge = visits[:, None] * steps
    edge = (edge + edge.T) * (1 - np.eye(len(a))) / 2
    information = -np.sum(steps * np.log(steps, where=steps > 1e-15, out=np.zeros_like(steps)), axis=1)
    return {"hitting": h, "node": visits, "edge": edge, "absorption": float(start @ h), "entropy_rate": float(visits @ information / max(visits.sum(), 1e-15))}


def corridor(a: np.ndarray, s: list[int], t: list[int], times: list[float], ws: dict | None = None, wt: dict | None = None) -> dict:
    """Mean over times of where heat from both ends meets."""
    values, vectors = eigen(laplacian(a))
    ends = np.column_stack([distribution(len(a), s, ws), distribution(len(a), t, wt)])
    node, edge = np.zeros(len(a)), np.zeros_like(a)
    for time in times:
        x, y = np.maximum(vectors @ (np.exp(-time * values)[:, None] * (vectors.T @ ends)), 0).T
        o = np.sqrt(x * y)
        node += o
        edge += a * np.sqrt(np.outer(o, o))
    return {"node": node / len(times), "edge": edge / len(times)}


def geodesic(n: int, paths: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the paths that hold each node and edge."""
    node, edge = np.zeros(n), np.zeros((n, n))
    for p in paths:
        node[list(set(p["nodes"]))] += 1
        for u, v in zip(p["nodes"], p["nodes"][1:], strict=False):
            edge[u, v] += 1
            edge[v, u] += 1
    return node / max(1, len(paths)), edge / max(1, len(paths))


def _evidence(a: np.ndarray, s: list[int], t: list[int], beta: float, times: list[float], k: int, penalty: float, strategy: str) -> tuple[dict, dict, list[dict]]:
    paths = diverse(a, s, t, k=k, penalty=penalty, strategy=strategy)
    c, b, h = current(a, s, t), bridge(a, s, t, beta), corridor(a, s, t, times)
    gn, ge = geodesic(len(a), paths)
    return {"current": c["node"], "bridge": b["node"], "heat": h["node"], "geodesic": gn}, {"current": c["edge"], "bridge": b["edge"], "heat": h["edge"], "geodesic": ge}, paths


def evidence(graph: Graph, sources: list[int], targets: list[int], of: str = "nodes", *, beta: float = 1.0, times: list[float] | None = None, k: int = 12, penalty: float = 0.35, strategy: str = "inverse") -> DataFrame:
    """The four kinds of evidence for nodes, or for edges (i < j) of each graph."""
    times = [0.25, 0.5, 1.0, 2.0, 4.0] if times is None else list(times)

    def kernel(a: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> dict:
        at = {int(v): i for i, v in enumerate(ids)}
        node, edge, _ = _evidence(a, [at[v] for v in sources], [at[v] for v in targets], beta, times, k, penalty, strategy)
        if of == "nodes":
            return {"node": ids, **node, "degree": a.sum(1)}
        i, j = np.nonzero(np.triu(a, 1) > 0)
        return {"i": ids[i], "j": ids[j], "weight": a[i, j], "cost": cost_matrix(a, strategy)[i, j], **{n: e[i, j] for n, e in edge.items()}}

    return per_graph(graph, kernel, NODE_EVIDENCE if of == "nodes" else EDGE_EVIDENCE)


def scored(rows: DataFrame, shares: dict[str, float], *, zero_floor: bool = False) -> DataFrame:
    """Adds score: shares of the parts, each from 0 to 1 in its graph, then itself from 0 to 1. zero_floor: cells without a row hold 0."""
    low = lambda c: F.least(F.min(c), F.lit(0.0)) if zero_floor else F.min(c)
    s = rows.groupBy("graph_id").agg(*(x for p in shares for x in (low(p).alias(f"lo_{p}"), F.max(p).alias(f"hi_{p}"))))
    df, total = rows.join(s, "graph_id"), F.lit(0.0)
    for p, w in shares.items():
        span = F.col(f"hi_{p}") - F.col(f"lo_{p}")
        total = total + w * F.coalesce((F.col(p) - F.col(f"lo_{p}")) / F.when(span > 1e-15, span), F.lit(0.0))
    df = df.withColumn("raw", total)
    r = df.groupBy("graph_id").agg(low("raw").alias("lo"), F.max("raw").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return df.join(r, "graph_id").withColumn("score", F.coalesce((F.col("raw") - F.col("lo")) / F.when(span > 1e-15, span), F.lit(0.0))).select(*rows.columns, "score")


def node_scores(graph: Graph, sources: list[int], targets: list[int], *, top: int | None = 25, **options) -> DataFrame:
    df = scored(evidence(graph, sources, targets, "nodes", **options), SHARES_NODE)
    return ranked(df, [F.desc("score"), "node"], top)


def edge_scores(graph: Graph, sources: list[int], targets: list[int], *, top: int | None = 40, **options) -> DataFrame:
    df = scored(evidence(graph, sources, targets, "edges", **options), SHARES_EDGE, zero_floor=True)
    return ranked(df, [F.desc("score"), F.desc("weight"), "i", "j"], top)


def ranked(df: DataFrame, order: list, top: int | None) -> DataFrame:
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(*order)))
    return df if top is None else df.where(F.col("rank") <= top)


def subgraph_nodes(graph: Graph, sources: list[int], targets: list[int], scores: DataFrame, paths: DataFrame) -> DataFrame:
    """(graph_id, node): the first max(8, a fifth) nodes by score, the terminals, and the nodes of the first five paths."""
    n = graph.nodes.groupBy("graph_id").agg(F.greatest(F.lit(8), F.ceil(0.2 * F.count("*"))).alias("k"))
    best = scores.join(n, "graph_id").where("rank <= k").select("graph_id", "node")
    ends = graph.nodes.where(F.col("node").isin([*sources, *targets])).select("graph_id", "node")
    return best.union(ends).union(paths.where("rank <= 5").select("graph_id", F.explode("nodes"))).distinct()


def subgraph_edges(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Edges inside, the best max(nodes - 1, min(all, 2 nodes)) of them."""
    size = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    inside = scores.drop("rank").join(nodes.withColumnRenamed("node", "i"), ["graph_id", "i"], "left_semi").join(nodes.withColumnRenamed("node", "j"), ["graph_id", "j"], "left_semi")
    inside = ranked(inside, [F.desc("score"), F.desc("weight"), "i", "j"], None)
    m = inside.groupBy("graph_id").agg(F.count("*").alias("m")).join(size, "graph_id")
    return inside.join(m, "graph_id").where(F.col("rank") <= F.greatest(F.col("n") - 1, F.least("m", 2 * F.col("n")))).drop("m", "n")


def current_flow(graph: Graph, sources: list[int], targets: list[int]) -> DataFrame:
    """(graph_id, node, potential, through, resistance, power)."""

    def kernel(a: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> dict:
        at = {int(v): i for i, v in enumerate(ids)}
        c = current(a, [at[v] for v in sources], [at[v] for v in targets])
        return {"node": ids, "potential": c["potential"], "through": c["node"], "resistance": c["resistance"], "power": c["power"]}

    return per_graph(graph, kernel, "node int, potential double, through double, resistance double, power double")


def bridge_flow(graph: Graph, sources: list[int], targets: list[int], beta: float = 1.0) -> DataFrame:
    """(graph_id, node, hitting, visits, absorption, entropy_rate)."""

    def kernel(a: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> dict:
        at = {int(v): i for i, v in enumerate(ids)}
        b = bridge(a, [at[v] for v in sources], [at[v] for v in targets], beta)
        return {"node": ids, "hitting": b["hitting"], "visits": b["node"], "absorption": b["absorption"], "entropy_rate": b["entropy_rate"]}

    return per_graph(graph, kernel, "node int, hitting double, visits double, absorption double, entropy_rate double")


def heat_corridor(graph: Graph, sources: list[int], targets: list[int], times: list[float]) -> DataFrame:
    def kernel(a: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> dict:
        at = {int(v): i for i, v in enumerate(ids)}
        return {"node": ids, "value": corridor(a, [at[v] for v in sources], [at[v] for v in targets], times)["node"]}

    return per_graph(graph, kernel, "node int, value double")


def bottleneck_scan(graph: Graph, sources: list[int], targets: list[int], *, candidates: list[int] | None = None, metric: str = "effective_resistance") -> DataFrame:
    """(graph_id, node, baseline, value, delta, error, rank): each candidate cut off in turn, dealt out over tasks; lost connections are infinite."""
    if metric not in ("effective_resistance", "dissipated_power"):
        raise GraphError(f"unknown metric {metric!r}")
    key = "resistance" if metric == "effective_resistance" else "power"
    tasks = graph.nodes.where(~F.col("node").isin([*sources, *targets]))
    tasks = tasks if candidates is None else tasks.where(F.col("node").isin(list(candidates)))
    tasks = tasks.select("graph_id", F.col("node").alias("candidate"), F.pmod(F.xxhash64("node"), F.lit(32)).alias("part"))
    parts = tasks.select("graph_id", "part").distinct()
    rows = graph.edges.join(parts, "graph_id").select("graph_id", "part", F.lit("e").alias("kind"), "src", "dst", "weight", F.lit("").alias("text"))
    rows = rows.union(graph.nodes.join(parts, "graph_id").select("graph_id", "part", F.lit("v"), "node", "node", F.lit(0.0), "label"))
    rows = rows.union(tasks.select("graph_id", "part", F.lit("c"), "candidate", "candidate", F.lit(0.0), F.lit("")))

    def kernel(table: pd.DataFrame) -> pd.DataFrame:
        e, v, c = (table[table["kind"] == k] for k in "evc")
        a, ids, _ = dense(e, pd.DataFrame({"node": v["src"], "label": v["text"]}))
        at = {int(x): i for i, x in enumerate(ids)}
        s, t = [at[x] for x in sources], [at[x] for x in targets]
        base, out = current(a, s, t)[key], []
        for x in sorted(c["src"].tolist()):
            b = a.copy()
            b[at[x]] = b[:, at[x]] = 0
            _, reach = reachable(b, s)
            if not reach[t].any():
                out.append((x, base, np.inf, np.inf, "targets out of reach"))
            else:
                value = current(b, s, t)[key]
                out.append((x, base, value, value - base, None))
        df = pd.DataFrame(out, columns=["node", "baseline", "value", "delta", "error"])
        df.insert(0, "graph_id", table["graph_id"].iloc[0])
        return df

    found = rows.groupBy("graph_id", "part").applyInPandas(kernel, "graph_id string, node int, baseline double, value double, delta double, error string")
    return ranked(found, [F.desc("delta"), "node"], None)


def reachable(a: np.ndarray, start: list[int]) -> tuple[int, np.ndarray]:
    seen = np.zeros(len(a), bool)
    seen[start] = True
    rounds = 0
    while (new := (a[seen] > 0).any(0) & ~seen).any():
        seen |= new
        rounds += 1
    return rounds, seen


def edge_cuts(graph: Graph, sources: list[int], targets: list[int], top: int = 10) -> DataFrame:
    """(graph_id, i, j, weight, current, support, score, rank): score is current over 1 + the triangles on the edge."""
    from .matrices import triangle_support

    e = evidence(graph, sources, targets, "edges").select("graph_id", "i", "j", "weight", "current")
    t = triangle_support(graph).select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), "support")
    df = e.join(t, ["graph_id", "i", "j"]).withColumn("score", F.col("current") / (1 + F.col("support")))
    return ranked(df, [F.desc("score"), "i", "j"], top)
