"""Interventions on graphs, their exact effects, and first-order sensitivities.

Interventions are functions of a Graph to a Graph over frames. Scenario scans deal (graph, scenario) out over tasks; sensitivities of all edges
come from one forward and one adjoint trajectory.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, GraphError, dense, per_graph_and_signal
from .dynamics import evolve, run
from .prepare import upper_edges
from .stats import compare_states
from .traversal import bfs_hops


@dataclass(frozen=True)
class Intervention:
    """A change of a graph that keeps its nodes."""

    def apply(self, graph: Graph) -> Graph:
        raise NotImplementedError

    def identifier(self, fingerprint: str = "") -> str:
        """16 hex digits of the class, its fields and a graph's fingerprint."""
        text = json.dumps([type(self).__name__, asdict(self), fingerprint], sort_keys=True, default=str)
        return hashlib.sha1(text.encode()).hexdigest()[:16]

    def affected_edges(self, graph: Graph) -> DataFrame:
        """(graph_id, src, dst, before, after) for src < dst where the weight changes by over 1e-15."""
        b, a = upper_edges(graph.edges), upper_edges(self.apply(graph).edges)
        both = b.withColumnRenamed("weight", "before").join(a.withColumnRenamed("weight", "after"), ["graph_id", "src", "dst"], "full_outer").na.fill(0.0, ["before", "after"])
        return both.where(F.abs(F.col("after") - F.col("before")) > 1e-15)

    def affected_nodes(self, graph: Graph) -> DataFrame:
        e = self.affected_edges(graph)
        return e.select("graph_id", F.col("src").alias("node")).union(e.select("graph_id", "dst")).distinct()


def touching(nodes: list[int]) -> Column:
    return F.col("src").isin([int(i) for i in nodes]) | F.col("dst").isin([int(i) for i in nodes])


def is_edge(u: int, v: int) -> Column:
    return ((F.col("src") == int(u)) & (F.col("dst") == int(v))) | ((F.col("src") == int(v)) & (F.col("dst") == int(u)))


@dataclass(frozen=True)
class RemoveNodes(Intervention):
    nodes: tuple[int, ...]

    def apply(self, graph: Graph) -> Graph:
        return graph.with_edges(graph.edges.where(~touching(self.nodes)), suffix="-removed")


@dataclass(frozen=True)
class RemoveEdges(Intervention):
    pairs: tuple[tuple[int, int], ...]

    def apply(self, graph: Graph) -> Graph:
        e = graph.edges
        for u, v in self.pairs:
            e = e.where(~is_edge(u, v))
        return graph.with_edges(e, suffix="-cut")


@dataclass(frozen=True)
class ReweightEdge(Intervention):
    u: int
    v: int
    weight: float | None = None
    factor: float | None = None

    def apply(self, graph: Graph) -> Graph:
        if (self.weight is None) == (self.factor is None):
            raise GraphError("either a weight or a factor is needed")
        hit = is_edge(self.u, self.v)
        if self.factor is not None:
            e = graph.edges.withColumn("weight", F.when(hit, F.greatest(F.col("weight") * self.factor, F.lit(0.0))).otherwise(F.col("weight")))
        else:
            new = graph.nodes.select("graph_id").distinct().select("graph_id", F.explode(F.array(F.struct(F.lit(self.u).alias("a"), F.lit(self.v).alias("b")), F.struct(F.lit(self.v).alias("a"), F.lit(self.u).alias("b")))).alias("p"))
            e = graph.edges.where(~hit).union(new.select("graph_id", F.col("p.a").cast("int"), F.col("p.b").cast("int"), F.lit(max(0.0, float(self.weight)))))
        return graph.with_edges(e.where("weight > 0"), suffix="-reweighted")


@dataclass(frozen=True)
class MutateNode(Intervention):
    """Edges that touch the shell of some hops around a node are scaled, less with distance."""

    node: int
    factor: float = 0.5
    radius: int = 1
    decay: float = 0.5

    def apply(self, graph: Graph) -> Graph:
        if self.radius <= 0:
            return graph
        shell = bfs_hops(graph, [self.node], self.radius)
        e = graph.edges
        for end in ("src", "dst"):
            e = e.join(shell.select("graph_id", F.col("node").alias(end), F.col("value").alias(f"d_{end}")), ["graph_id", end], "left")
        d = F.least("d_src", "d_dst")
        scale = F.when(d.isNull(), 1.0).when(d <= 1, self.factor).otherwise(1 - (1 - self.factor) * F.pow(F.lit(self.decay), d - 1))
        return graph.with_edges(e.withColumn("weight", F.col("weight") * scale).where("weight > 0"), suffix="-mutated")


@dataclass(frozen=True)
class BlockPath(Intervention):
    nodes: tuple[int, ...]
    factor: float = 0.0

    def apply(self, graph: Graph) -> Graph:
        w = F.col("weight")
        hit = F.lit(False)
        for u, v in zip(self.nodes, self.nodes[1:], strict=False):
            hit = hit | is_edge(u, v)
        return graph.with_edges(graph.edges.withColumn("weight", F.when(hit, w * self.factor).otherwise(w)).where("weight > 0"), suffix="-blocked")


@dataclass(frozen=True)
class Threshold(Intervention):
    """remove_below or remove_above a weight, or keep_top_fraction of the edges (rounded up, ties in row-major order)."""

    mode: str
    value: float

    def apply(self, graph: Graph) -> Graph:
        e = graph.edges
        if self.mode == "remove_below":
            kept = e.where(F.col("weight") >= self.value)
        elif self.mode == "remove_above":
            kept = e.where(F.col("weight") <= self.value)
        elif self.mode == "keep_top_fraction":
            up = upper_edges(e)
            n = up.groupBy("graph_id").agg(F.ceil(F.count("*") * self.value).alias("k"))
            turn = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("weight"), "src", "dst"))
            best = up.withColumn("turn", turn).join(n, "graph_id").where("turn <= k").select("graph_id", "src", "dst", "weight")
            kept = best.union(best.select("graph_id", "dst", "src", "weight"))
        else:
            raise GraphError(f"unknown mode {self.mode!r}")
        return graph.with_edges(kept, suffix="-threshold")


@dataclass(frozen=True)
class Composite(Intervention):
    children: tuple[Intervention, ...]

    def apply(self, graph: Graph) -> Graph:
        for child in self.children:
            graph = child.apply(graph)
        return graph

    def affected_nodes(self, graph: Graph) -> DataFrame:
        out = None
        for child in self.children:
            x = child.affected_nodes(graph)
            out = x if out is None else out.union(x)
        return out.distinct() if out is not None else graph.nodes.select("graph_id", "node").where("false")


KINDS = {
    "remove_node": RemoveNodes, "node_removal": RemoveNodes, "remove_edge": RemoveEdges, "edge_removal": RemoveEdges, "reweight_edge": ReweightEdge, "edge_reweight": ReweightEdge,
    "mutate_node": MutateNode, "local_mutation": MutateNode, "block_path": BlockPath, "path_blocking": BlockPath, "threshold": Threshold, "contact_threshold": Threshold, "composite": Composite,
}


def make(kind: str, **fields) -> Intervention:
    try:
        cls = KINDS[kind.strip().lower().replace("-", "_")]
    except KeyError:
        raise GraphError(f"unknown intervention {kind!r}") from None
    if cls is Composite:
        return Composite(tuple(c if isinstance(c, Intervention) else make(**c) for c in fields["children"]))
    frozen = lambda x: tuple(frozen(y) for y in x) if isinstance(x, list | tuple) else x
    return cls(**{k: frozen(v) for k, v in fields.items()})


def from_config(items: list[dict]) -> list[Intervention]:
    return [make(**{("kind" if k == "type" else k): v for k, v in item.items()}) for item in items]


def evaluate(graph: Graph, change: Intervention, seed: DataFrame, *, target: DataFrame | None = None, k: int = 10, **dynamics) -> DataFrame:
    """Differences between the states that the graph and the changed graph end with."""
    return compare_states(run(graph, seed, **dynamics).drop("signal"), run(change.apply(graph), seed, **dynamics).drop("signal"), target=target, k=k)


def evaluate_many(graph: Graph, changes: dict[str, Intervention], seed: DataFrame, *, target: DataFrame | None = None, k: int = 10, **dynamics) -> DataFrame:
    """As evaluate, for named changes, in one plan: a changed graph is a graph of its own, graph_id and name joined by a bar."""
    base = run(graph, seed, **dynamics).drop("signal")
    e, v, s, b, t = None, None, None, None, None
    add = lambda a, x: x if a is None else a.union(x)
    for name, change in changes.items():
        own = F.concat("graph_id", F.lit(f"|{name}"))
        named = lambda df, own=own: df.withColumn("graph_id", own)
        g = change.apply(graph)
        e, v, s, b = add(e, named(g.edges)), add(v, named(g.nodes)), add(s, named(seed)), add(b, named(base))
        t = add(t, named(target)) if target is not None else None
    after = run(Graph(e, v), s, **dynamics).drop("signal")
    out = compare_states(b, after, target=t, k=k)
    return out.withColumn("scenario", F.substring_index("graph_id", "|", -1)).withColumn("graph_id", F.regexp_replace("graph_id", r"\|[^|]*\z", ""))


def _scenarios(graph: Graph, kind: str, max_edges: int | None) -> DataFrame:
    """(graph_id, i, j): nodes (i = j) or the edges of most weight."""
    if kind not in ("nodes", "mutations", "edges"):
        raise GraphError(f"unknown kind of scan {kind!r}")
    if kind != "edges":
        return graph.nodes.select("graph_id", F.col("node").alias("i"), F.col("node").alias("j"))
    up = upper_edges(graph.edges)
    if max_edges is not None:
        up = up.withColumn("turn", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("weight"), "src", "dst"))).where(F.col("turn") <= max_edges)
    return up.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"))


def fan(graph: Graph, seed: DataFrame, tasks: DataFrame, kernel: Callable, schema: str, parts: int = 32) -> DataFrame:
    """kernel(matrix, ids, x0, tasks as (i, j) places) for parts of the tasks, each with its graph."""
    tasks = tasks.select("graph_id", F.pmod(F.xxhash64("i", "j"), F.lit(parts)).alias("part"), "i", "j")
    used = tasks.select("graph_id", "part").distinct()
    rows = graph.edges.join(used, "graph_id").select("graph_id", "part", F.lit("e").alias("kind"), "src", "dst", "weight")
    rows = rows.union(graph.nodes.join(used, "graph_id").select("graph_id", "part", F.lit("v"), "node", "node", F.lit(0.0)))
    rows = rows.union(seed.join(used, "graph_id").select("graph_id", "part", F.lit("s"), "node", "node", "value"))
    rows = rows.union(tasks.select("graph_id", "part", F.lit("t"), "i", "j", F.lit(0.0)))

    def run_(table: pd.DataFrame) -> pd.DataFrame:
        e, v, s, t = (table[table["kind"] == k] for k in "evst")
        a, ids, _ = dense(e, pd.DataFrame({"node": v["src"], "label": v["src"]}))
        x0 = np.zeros(len(ids))
        np.add.at(x0, np.searchsorted(ids, s["src"]), s["weight"])
        t = t.sort_values(["src", "dst"])
        out = pd.DataFrame(kernel(a, ids, x0, list(zip(np.searchsorted(ids, t["src"]).tolist(), np.searchsorted(ids, t["dst"]).tolist(), strict=True))))
        out.insert(0, "graph_id", table["graph_id"].iloc[0])
        return out

    return rows.groupBy("graph_id", "part").applyInPandas(run_, f"graph_id string, {schema}")


def ablation_scan(graph: Graph, seed: DataFrame, *, kind: str = "edges", max_edges: int | None = None, factor: float = 0.5, model: str = "heat", steps: int = 60, dt: float = 0.1) -> DataFrame:
    """(graph_id, i, j, l1_delta, l2_delta, linf_delta, rank): each node cut off ("nodes", i = j) or mutated ("mutations": MutateNode of radius 1 and
    this factor), or each edge taken out, exactly; all edges, or the `max_edges` of most weight."""

    def kernel(a: np.ndarray, ids: np.ndarray, x0: np.ndarray, tasks: list) -> dict:
        base = evolve(a, x0[:, None], model=model, steps=steps, dt=dt)[:, 0]
        out = []
        for i, j in tasks:
            b = a.copy()
            if kind == "mutations":
                near = a[i] > 0
                near[i] = True
                b[near[:, None] | near] *= factor
            elif kind == "nodes":
                b[i] = b[:, i] = 0
            else:
                b[i, j] = b[j, i] = 0
            d = evolve(b, x0[:, None], model=model, steps=steps, dt=dt)[:, 0] - base
            out.append((ids[i], ids[j], np.abs(d).sum(), np.sqrt(d @ d), np.abs(d).max()))
        return dict(zip(("i", "j", "l1_delta", "l2_delta", "linf_delta"), zip(*out, strict=True), strict=True))

    found = fan(graph, seed, _scenarios(graph, kind, max_edges), kernel, "i int, j int, l1_delta double, l2_delta double, linf_delta double")
    # sizes that differ by rounding alone are ties
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc(F.round("l2_delta", 12)), "i", "j")))


def edge_sensitivity(graph: Graph, seed: DataFrame, target: DataFrame, *, steps: int = 60, dt: float = 0.1) -> DataFrame:
    """(graph_id, i, j, weight, derivative, absolute_derivative, predicted_delta_for_removal, score) of the objective target' x_T of Euler heat flow, for all edges."""
    both = seed.withColumn("signal", F.lit("seed")).select("graph_id", "signal", "node", "value").union(target.select("graph_id", F.lit("target"), "node", "value"))

    def kernel(a: np.ndarray, ids: np.ndarray, vectors: dict) -> dict:
        x = evolve(a, vectors.get("seed", np.zeros(len(ids)))[:, None], model="heat", steps=steps, dt=dt, keep=True)[:, :, 0]
        y = evolve(a.T, vectors.get("target", np.zeros(len(ids)))[:, None], model="heat", steps=steps, dt=dt, keep=True)[::-1, :, 0]
        i, j = np.nonzero(np.triu(a, 1) > 0)
        d = -dt * ((x[:-1, i] - x[:-1, j]) * (y[1:, i] - y[1:, j])).sum(0)
        w = a[i, j]
        return {"i": ids[i], "j": ids[j], "weight": w, "derivative": d, "absolute_derivative": np.abs(d), "predicted_delta_for_removal": -w * d, "score": np.abs(w * d)}

    return per_graph_and_signal(graph, both, kernel, "i int, j int, weight double, derivative double, absolute_derivative double, predicted_delta_for_removal double, score double")


def node_sensitivity(graph: Graph, edges: DataFrame) -> DataFrame:
    """Sums of the edges' sensitivities at their ends, by falling size of the predicted delta of removal."""
    d = F.col("derivative")
    ends = edges.select("graph_id", F.explode(F.array("i", "j")).alias("node"), "derivative", "predicted_delta_for_removal")
    s = ends.groupBy("graph_id", "node").agg(F.sum(F.abs(d)).alias("incident_abs_derivative_sum"), F.sum(d).alias("incident_signed_derivative_sum"), F.sum("predicted_delta_for_removal").alias("predicted_removal_delta"), F.max(F.abs(d)).alias("max_incident_abs_derivative"), F.count("*").alias("incident_edges"))
    from .matrices import degrees

    return degrees(graph).select("graph_id", "node", "label", "degree").join(s, ["graph_id", "node"], "left").na.fill(0).orderBy("graph_id", F.desc(F.abs("predicted_removal_delta")), "node")


def global_sensitivity(graph: Graph, seed: DataFrame, *, norm: str = "l2", steps: int = 60, dt: float = 0.1) -> DataFrame:
    """(graph_id, i, j, impact, score, rank): the size of the state's forward tangent for each edge, and times its weight."""

    def kernel(a: np.ndarray, ids: np.ndarray, x0: np.ndarray, tasks: list) -> dict:
        x = evolve(a, x0[:, None], model="heat", steps=steps, dt=dt, keep=True)[:, :, 0]
        i, j = (np.array(z) for z in zip(*tasks, strict=True))
        k, d = np.arange(len(i)), a.sum(1)[:, None]
        dx = np.zeros((len(ids), len(i)))
        for t in range(steps):
            dx = dx - dt * (d * dx - a @ dx)
            flow = dt * (x[t, i] - x[t, j])
            dx[i, k] -= flow
            dx[j, k] += flow
        size = {"l1": np.abs(dx).sum(0), "l2": np.sqrt((dx * dx).sum(0)), "linf": np.abs(dx).max(0)}[norm]
        return {"i": ids[i], "j": ids[j], "impact": size, "score": a[i, j] * size}

    found = fan(graph, seed, _scenarios(graph, "edges", None), kernel, "i int, j int, impact double, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("score"), "i", "j")))


def validate_top_edges(graph: Graph, seed: DataFrame, target: DataFrame, *, k: int = 25, steps: int = 60, dt: float = 0.1) -> DataFrame:
    """(graph_id, i, j, predicted, exact, absolute_error, relative_error, rank_predicted, rank_exact) of the k edges first by prediction."""
    edges = edge_sensitivity(graph, seed, target, steps=steps, dt=dt)
    turn = Window.partitionBy("graph_id").orderBy(F.desc("score"), "i", "j")
    top = edges.withColumn("rank_predicted", F.row_number().over(turn)).where(F.col("rank_predicted") <= k)
    packed = seed.select("graph_id", "node", "value").join(target.select("graph_id", "node", F.col("value").alias("t")), ["graph_id", "node"], "full_outer").na.fill(0.0)

    def kernel(a: np.ndarray, ids: np.ndarray, x0: np.ndarray, tasks: list) -> dict:
        base = evolve(a, x0[:, None], model="heat", steps=steps, dt=dt)[:, 0]
        rows = []
        for i, j in tasks:
            b = a.copy()
            b[i, j] = b[j, i] = 0
            d = evolve(b, x0[:, None], model="heat", steps=steps, dt=dt)[:, 0] - base
            rows += [(ids[i], ids[j], v, x) for v, x in zip(ids, d, strict=True)]
        return dict(zip(("i", "j", "node", "d"), zip(*rows, strict=True), strict=True))

    deltas = fan(graph, packed, top, kernel, "i int, j int, node int, d double")
    exact = deltas.join(target.select("graph_id", "node", F.col("value").alias("t")), ["graph_id", "node"]).groupBy("graph_id", "i", "j").agg(F.sum(F.col("d") * F.col("t")).alias("exact"))
    df = top.join(exact, ["graph_id", "i", "j"]).withColumnRenamed("predicted_delta_for_removal", "predicted")
    err = F.abs(F.col("predicted") - F.col("exact"))
    df = df.withColumn("rank_exact", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc(F.abs("exact")), "i", "j")))
    return df.select("graph_id", "i", "j", "predicted", "exact", err.alias("absolute_error"), (err / (F.abs("exact") + 1e-12)).alias("relative_error"), "rank_predicted", "rank_exact")


# The script language's variants, which give a report beside the graph


def delete_node(graph: Graph, node: int) -> tuple[Graph, DataFrame]:
    """The node's row goes and the others are numbered anew; (graph_id, node, new) is how."""
    from .prepare import induced_subgraph

    keep = graph.nodes.where(F.col("node") != int(node)).select("graph_id", "node")
    mapping = keep.withColumn("new", (F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1).cast("int"))
    return induced_subgraph(graph, keep), mapping


def scale_node(graph: Graph, node: int, factor: float) -> Graph:
    """The node's own edges times a factor, without its self loop."""
    hit = touching([node])
    e = graph.edges.where(~((F.col("src") == int(node)) & (F.col("dst") == int(node))))
    return graph.with_edges(e.withColumn("weight", F.when(hit, F.col("weight") * factor).otherwise(F.col("weight"))).where("weight <> 0"))
