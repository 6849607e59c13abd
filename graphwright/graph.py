"""Weighted graphs as frames.

edges(graph_id, src, dst, weight) hold both directions of an undirected edge and no zero weights; nodes(graph_id, node, label) hold every
node, isolated ones too. One pair of frames may hold any number of graphs: all operators work per graph_id, so many graphs spread over the cluster.
Kernels that need a dense matrix run one graph per task and refuse graphs of over MAX_DENSE nodes; the others are joins and aggregates.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "graph_id string, src int, dst int, weight double"
NODES = "graph_id string, node int, label string"
MAX_DENSE = 5000


class GraphError(ValueError):
    """A graph that an operator cannot work on."""


@dataclass
class Graph:
    edges: DataFrame
    nodes: DataFrame
    name: str = "graph"
    meta: dict = field(default_factory=dict)
    #: Each edge once, src < dst, where the graph was made from such; saves what only needs one direction from making both.
    upper: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @staticmethod
    def from_edges(edges: DataFrame, nodes: DataFrame | None = None, *, graph_id: str = "g", name: str = "graph", meta: dict | None = None, both: bool = False, ordered: bool = False) -> Graph:
        """edges: (src, dst, weight), each once unless both; ordered: and src < dst. nodes: (node[, label]); without it, the ends of the edges."""
        e = edges if "graph_id" in edges.columns else edges.withColumn("graph_id", F.lit(graph_id))
        e = e.select("graph_id", F.col("src").cast("int"), F.col("dst").cast("int"), F.col("weight").cast("double"))
        upper = e.where("weight <> 0") if ordered else None
        if not both:
            e = e.union(e.where("src <> dst").select("graph_id", "dst", "src", "weight"))
        if nodes is None:
            nodes = e.select("graph_id", F.col("src").alias("node")).union(e.select("graph_id", "dst")).distinct()
        v = nodes if "graph_id" in nodes.columns else nodes.withColumn("graph_id", F.lit(graph_id))
        label = F.col("label").cast("string") if "label" in v.columns else F.col("node").cast("string")
        return Graph(e.where("weight <> 0"), v.select("graph_id", F.col("node").cast("int"), label.alias("label")), name, dict(meta or {}), upper)

    @staticmethod
    def from_matrix(spark: SparkSession, matrix: np.ndarray, *, labels: list[str] | None = None, graph_id: str = "g", name: str = "graph", meta: dict | None = None) -> Graph:
        """Any square finite matrix as it is; sanitise() makes it a proper graph."""
        a = np.asarray(matrix, float)
        if a.ndim != 2 or a.shape[0] != a.shape[1]:
            raise GraphError("the matrix must be square")
        if not np.isfinite(a).all():
            raise GraphError("the matrix must be finite")
        i, j = np.nonzero(a)
        e = spark.createDataFrame(pd.DataFrame({"graph_id": graph_id, "src": i.astype("int32"), "dst": j.astype("int32"), "weight": a[i, j]}), EDGES)
        names = labels if labels and len(labels) == len(a) else [str(k) for k in range(len(a))]
        v = spark.createDataFrame(pd.DataFrame({"graph_id": graph_id, "node": np.arange(len(a), dtype="int32"), "label": names}), NODES)
        return Graph(e, v, name, dict(meta or {}))

    def with_edges(self, edges: DataFrame, nodes: DataFrame | None = None, suffix: str = "") -> Graph:
        return Graph(edges.select("graph_id", "src", "dst", "weight"), self.nodes if nodes is None else nodes, self.name + suffix, dict(self.meta))

    def validate(self) -> Graph:
        """Raises on weights that aren't finite and on ends that aren't nodes."""
        bad = self.edges.where(F.isnan("weight") | (F.abs("weight") == float("inf")) | F.col("weight").isNull())
        if not bad.isEmpty():
            raise GraphError("weights must be finite")
        ends = self.edges.select("graph_id", F.col("src").alias("node")).union(self.edges.select("graph_id", "dst"))
        if not ends.join(self.nodes, ["graph_id", "node"], "left_anti").isEmpty():
            raise GraphError("edges must end at nodes")
        return self

    def count(self) -> int:
        return self.nodes.count()

    def labels(self) -> list[str]:
        return [r[0] for r in self.nodes.orderBy("graph_id", "node").select("label").collect()]

    def resolve(self, node: int | str) -> int:
        """A node by index, label or integer-looking string."""
        hit = self.nodes.where((F.col("label") == str(node)) | (F.col("node").cast("string") == str(node))).orderBy((F.col("label") == str(node)).cast("int").desc() if isinstance(node, str) else (F.col("node").cast("string") == str(node)).cast("int").desc()).select("node").first()
        if hit is None:
            raise GraphError(f"no node {node!r}")
        return hit[0]

    def to_matrix(self) -> np.ndarray:
        """The dense matrix of the one graph in these frames, on the driver."""
        return dense(self.edges.toPandas(), self.nodes.toPandas())[0]


def dense(edges: pd.DataFrame, nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjacency matrix, node ids in order and labels."""
    v = nodes.sort_values("node")
    ids = v["node"].to_numpy()
    if len(ids) > MAX_DENSE:
        raise GraphError(f"{len(ids)} nodes are too many for a dense matrix; use the join forms")
    a = np.zeros((len(ids), len(ids)))
    if len(edges):
        np.add.at(a, (np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"])), edges["weight"].to_numpy(float))
    return a, ids, v["label"].to_numpy()


def per_graph(graph: Graph, kernel: Callable, schema: str) -> DataFrame:
    """kernel(matrix, node ids, labels) gives the columns of the schema but graph_id, for each graph in a task of its own."""

    def run(key: tuple, edges: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(kernel(*dense(edges, nodes)))
        out.insert(0, "graph_id", key[0])
        return out

    return graph.edges.groupBy("graph_id").cogroup(graph.nodes.groupBy("graph_id")).applyInPandas(run, f"graph_id string, {schema}")


def per_graph_and_signal(graph: Graph, signals: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """kernel(matrix, node ids, {signal name: vector}) for each graph; signals(graph_id, signal, node, value), missing values are 0."""
    rows = graph.edges.select("graph_id", F.lit("e").alias("kind"), "src", "dst", "weight", F.lit("").alias("text"))
    rows = rows.union(graph.nodes.select("graph_id", F.lit("v"), "node", "node", F.lit(0.0), "label"))
    rows = rows.union(signals.select("graph_id", F.lit("s"), "node", "node", "value", "signal"))

    def run(table: pd.DataFrame) -> pd.DataFrame:
        e, v, s = (table[table["kind"] == k] for k in "evs")
        a, ids, _ = dense(e, pd.DataFrame({"node": v["src"], "label": v["text"]}))
        vectors = {}
        for name, part in s.groupby("text", sort=True):
            x = np.zeros(len(ids))
            at = np.searchsorted(ids, part["src"])
            ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == part["src"].to_numpy())
            x[at[ok]] = part["weight"].to_numpy()[ok]
            vectors[name] = x
        out = pd.DataFrame(kernel(a, ids, vectors))
        out.insert(0, "graph_id", table["graph_id"].iloc[0])
        return out

    return rows.groupBy("graph_id").applyInPandas(run, f"graph_id string, {schema}")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names; where it names none, one machine gets a folder of its own and a cluster is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise GraphError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
