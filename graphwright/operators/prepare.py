"""Projection, filtering and repair of edge frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, GraphError

KEY = ["graph_id", "src", "dst"]


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def symmetrize(edges: DataFrame, mode: str = "average") -> DataFrame:
    """average, max, min (a direction that is missing counts as 0) or none."""
    if mode == "none":
        return edges
    one = edges.groupBy(*KEY).agg(F.sum("weight").alias("weight"))
    both = one.union(reversed_(one).where("src <> dst"))
    ends = both.groupBy(*KEY)
    lone = (F.count("*") == 1) & (F.first("src") != F.first("dst"))
    if mode == "average":
        w = F.when(F.first("src") == F.first("dst"), F.first("weight")).otherwise(F.sum("weight") / 2)
    elif mode == "max":
        w = F.when(lone, F.greatest(F.max("weight"), F.lit(0.0))).otherwise(F.max("weight"))
    elif mode == "min":
        w = F.when(lone, F.least(F.min("weight"), F.lit(0.0))).otherwise(F.min("weight"))
    else:
        raise GraphError(f"unknown mode {mode!r}")
    return ends.agg(w.alias("weight")).where("weight <> 0")


def sanitize(graph: Graph, *, mode: str = "average", remove_self_loops: bool = True, clip_negative: bool = True, clip_first: bool = True) -> Graph:
    """No self loops, no negative weights, both directions equal. clip_first: negatives go before the directions are joined."""
    e = graph.edges
    if remove_self_loops:
        e = e.where("src <> dst")
    clip = lambda df: df.withColumn("weight", F.greatest("weight", F.lit(0.0))) if clip_negative else df
    e = symmetrize(clip(e), mode) if clip_first else clip(symmetrize(e, mode))
    return graph.with_edges(e.where("weight <> 0"))


def clip_weights(edges: DataFrame, low: float = 0.0, high: float | None = None) -> DataFrame:
    w = F.greatest("weight", F.lit(float(low)))
    return edges.withColumn("weight", F.least(w, F.lit(float(high))) if high is not None else w).where("weight <> 0")


def upper_edges(edges: DataFrame, tolerance: float = 0.0) -> DataFrame:
    return edges.where((F.col("src") < F.col("dst")) & (F.col("weight") > tolerance))


def edge_list(edges: DataFrame, *, tolerance: float = 0.0, upper_only: bool = True) -> DataFrame:
    """In row-major order."""
    kept = edges.where((F.col("src") < F.col("dst")) if upper_only else (F.col("src") != F.col("dst")))
    return kept.where(F.col("weight") > tolerance).orderBy(*KEY)


def mean_upper_edges(edges: DataFrame) -> DataFrame:
    """Pairs i < j with a positive weight either way, weighted by the mean of both directions."""
    pairs = edges.where("src <> dst").groupBy("graph_id", F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"))
    got = pairs.agg((F.sum("weight") / 2).alias("weight"), F.max("weight").alias("m")).where("m > 0")
    return got.select("graph_id", F.col("i").alias("src"), F.col("j").alias("dst"), "weight")


def induced_subgraph(graph: Graph, keep: DataFrame, *, reindex: bool = True) -> Graph:
    """Nodes in keep(graph_id, node) and the edges between them, numbered anew from 0 in their order."""
    v = graph.nodes.join(keep.select("graph_id", "node").distinct(), ["graph_id", "node"], "left_semi")
    if not reindex:
        e = graph.edges
        for end in ("src", "dst"):
            e = e.join(v.select("graph_id", F.col("node").alias(end)), ["graph_id", end], "left_semi")
        return graph.with_edges(e, v)
    v = v.withColumn("new", (F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1).cast("int"))
    e = graph.edges
    for end in ("src", "dst"):
        e = e.join(v.select("graph_id", F.col("node").alias(end), F.col("new").alias(f"new_{end}")), ["graph_id", end])
    e = e.select("graph_id", F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "weight")
    return graph.with_edges(e, v.select("graph_id", F.col("new").alias("node"), "label"))


def weight_to_cost(edges: DataFrame, strategy: str = "inverse", eps: float = 1e-12) -> DataFrame:
    """edges with cost: inverse, negative_log, affinity (median weight over weight) or unit."""
    w, lo = F.col("weight"), F.lit(eps)
    if strategy == "unit":
        return edges.withColumn("cost", F.lit(1.0))
    if strategy == "inverse":
        return edges.withColumn("cost", 1 / F.greatest(w, lo))
    stats = edges.where("weight > 0").groupBy("graph_id").agg(F.max("weight").alias("top"), F.median("weight").alias("mid"))
    df = edges.join(stats, "graph_id")
    if strategy == "negative_log":
        cost = -F.ln(F.least(F.greatest(w / F.col("top"), lo), F.lit(1.0))) + lo
    elif strategy == "affinity":
        cost = F.col("mid") / F.greatest(w, lo)
    else:
        raise GraphError(f"unknown strategy {strategy!r}")
    return df.withColumn("cost", cost).drop("top", "mid")


def strongest(edges: DataFrame, k: int) -> DataFrame:
    """The k undirected edges of most weight in each graph; ties by ends."""
    turn = Window.partitionBy("graph_id").orderBy(F.desc("weight"), "src", "dst")
    return upper_edges(edges).withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def soft_threshold(x: Column, tau: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - tau, F.lit(0.0))
