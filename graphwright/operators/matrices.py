"""Degrees, Laplacians, transition and modularity matrices as entry frames (graph_id, i, j, value), and products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, GraphError
from . import triangles

EPS = 1e-12


def degrees(graph: Graph) -> DataFrame:
    """(graph_id, node, label, degree, links): weighted row sums and counts of positive weights; isolated nodes have 0."""
    if graph.upper is None:
        ends = graph.edges.select("graph_id", F.col("src").alias("node"), "weight")
    else:  # both ends of each edge in one pass: the edges are made once
        ends = graph.upper.select("graph_id", F.explode(F.array("src", "dst")).alias("node"), "weight")
    sums = ends.groupBy("graph_id", "node").agg(F.sum("weight").alias("degree"), F.count_if(F.col("weight") > 0).alias("links"))
    return graph.nodes.join(sums, ["graph_id", "node"], "left").na.fill(0.0, ["degree"]).na.fill(0, ["links"])


def graph_summary(graph: Graph, tolerance: float = 0.0) -> DataFrame:
    """(graph_id, nodes, edges, density, volume, degree_min, degree_max, degree_mean, degree_std)."""
    d = degrees(graph).groupBy("graph_id").agg(
        F.count("*").alias("nodes"), F.sum("degree").alias("volume"), F.min("degree").alias("degree_min"), F.max("degree").alias("degree_max"),
        F.avg("degree").alias("degree_mean"), F.stddev_pop("degree").alias("degree_std"),
    )
    m = graph.edges.where((F.col("src") < F.col("dst")) & (F.col("weight") > tolerance)).groupBy("graph_id").agg(F.count("*").alias("edges"))
    pairs = F.col("nodes") * (F.col("nodes") - 1) / 2
    out = d.join(m, "graph_id", "left").na.fill(0, ["edges"])
    return out.withColumn("density", F.coalesce(F.try_divide(F.col("edges"), pairs), F.lit(0.0)))


def canonical_kind(kind: str) -> str:
    k = kind.strip().lower().replace("_", "-")
    for name, also in {"unnormalized": ("combinatorial", "laplacian", "standard"), "normalized": ("symmetric", "sym"), "random-walk": ("rw", "randomwalk")}.items():
        if k == name or k in also:
            return name
    raise GraphError(f"unknown kind of Laplacian {kind!r}")


def laplacian_entries(graph: Graph, kind: str = "unnormalized", *, isolated_diagonal: float = 0.0) -> DataFrame:
    """D - A, I - D^-1/2 A D^-1/2 or I - D^-1 A. isolated_diagonal: what a node without edges has on the normalised diagonal."""
    kind = canonical_kind(kind)
    d = degrees(graph).select("graph_id", "node", "degree")
    ends = graph.edges.join(d.withColumnsRenamed({"node": "src", "degree": "di"}), ["graph_id", "src"]).join(d.withColumnsRenamed({"node": "dst", "degree": "dj"}), ["graph_id", "dst"])
    if kind == "unnormalized":
        off, diagonal = -F.col("weight"), F.col("degree")
    elif kind == "normalized":
        off = F.when((F.col("di") > EPS) & (F.col("dj") > EPS), -F.col("weight") / F.sqrt(F.col("di") * F.col("dj"))).otherwise(0.0)
        diagonal = F.when(F.col("degree") > EPS, 1.0).otherwise(isolated_diagonal)
    else:
        off = F.when(F.col("di") > EPS, -F.col("weight") / F.col("di")).otherwise(0.0)
        diagonal = F.lit(1.0)
    rows = ends.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), off.alias("value"))
    return rows.union(d.select("graph_id", "node", "node", diagonal)).groupBy("graph_id", "i", "j").agg(F.sum("value").alias("value"))


def transition_entries(graph: Graph, *, self_loops: bool = False, cost: DataFrame | None = None, beta: float = 0.0) -> DataFrame:
    """D^-1 A; rows of isolated nodes are empty, or self loops. With cost (edges with a cost) weights are A exp(-beta cost)."""
    e = graph.edges if cost is None else cost.select("graph_id", "src", "dst", (F.col("weight") * F.exp(-beta * F.col("cost"))).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("graph_id", "src"))
    rows = e.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.when(total > EPS, F.col("weight") / total).otherwise(0.0).alias("value")).where("value <> 0")
    if not self_loops:
        return rows
    lone = graph.nodes.join(rows.select("graph_id", F.col("i").alias("node")).distinct(), ["graph_id", "node"], "left_anti")
    return rows.union(lone.select("graph_id", "node", "node", F.lit(1.0)))


def modularity_entries(graph: Graph) -> DataFrame:
    """A - d d' / volume for every pair of a graph's nodes (N^2 rows: for graphs whose matrix is wanted whole)."""
    d = degrees(graph).select("graph_id", "node", "degree")
    volume = d.groupBy("graph_id").agg(F.sum("degree").alias("volume"))
    left = d.join(volume, "graph_id").withColumnsRenamed({"node": "i", "degree": "di"})
    pairs = left.join(d.withColumnsRenamed({"node": "j", "degree": "dj"}), "graph_id")
    a = graph.edges.select("graph_id", F.col("src").alias("i"), F.col("dst").alias("j"), "weight")
    expected = F.when(F.col("volume") > EPS, F.col("di") * F.col("dj") / F.col("volume")).otherwise(0.0)
    return pairs.join(a, ["graph_id", "i", "j"], "left").select("graph_id", "i", "j", (F.coalesce("weight", F.lit(0.0)) - expected).alias("value"))


def product(entries: DataFrame, signals: DataFrame) -> DataFrame:
    """One matrix-vector step: (graph_id, signal, node, value). Rows that no entry reaches are absent."""
    right = signals.select("graph_id", "signal", F.col("node").alias("j"), F.col("value").alias("x"))
    return entries.join(right, ["graph_id", "j"]).groupBy("graph_id", "signal", F.col("i").alias("node")).agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def triangle_support(graph: Graph) -> DataFrame:
    """(graph_id, src, dst, weight, support) of edges src < dst: how many nodes are neighbours of both."""
    return triangles.support(graph)


def matrix_summary(graph: Graph) -> DataFrame:
    """(graph_id, n, min, max, mean, std, frobenius, nnz, density) over all N^2 cells, zeros counted."""
    n = graph.nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    s = graph.edges.groupBy("graph_id").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.sum("weight").alias("s"), F.sum(F.col("weight") ** 2).alias("q"), F.count("*").alias("nnz"))
    df = n.join(s, "graph_id", "left").na.fill(0)
    cells = F.col("n") * F.col("n")
    mean = F.col("s") / cells
    zero = F.col("nnz") < cells
    return df.select(
        "graph_id", "n",
        F.when(zero, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min"), F.when(zero, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max"),
        mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / cells - mean * mean)).alias("std"), F.sqrt("q").alias("frobenius"), "nnz", (F.col("nnz") / cells).alias("density"),
    )
