"""Connected components of an edge list by contraction to stars, and the one way to cut lineage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that a partition holds before it contracts them.
EDGES = 1 << 20
STAR = "a long, b long"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each has ended: nothing reads them again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that the session names."""
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints. Where the session names none, one machine (tests) gets a folder of its own; a cluster is refused."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition to (node, least node that these edges reach); nodes that are the least themselves are left out."""
    held, size = [], 0
    for batch in batches:
        held.append(np.array([batch.column(0), batch.column(1)], np.int64).reshape(2, -1))
        size += batch.num_rows
        if size > EDGES:
            held = [contracted(*np.concatenate(held, axis=1))]
            size = held[0].shape[1] // 2  # a part that does not shrink is not contracted again for each batch
    a, b = contracted(*np.concatenate(held, axis=1)) if held else np.zeros((2, 0), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def contracted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(node, least node of its component) of all nodes but the least ones, as two rows."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(where, 2)
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return np.array([nodes[rest], nodes[label[rest]]], np.int64).reshape(2, -1)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that the edges (a, b) reach, for every id on an edge to another.

    Partitions contract their edges to stars. Then, in each round, edges step on to what their lower end points to, and all edges of an
    upper end meet and are contracted again, until nothing changes: paths are halved. A node of many links has one edge a
    partition as upper end; as lower end it is met by a join whose sides are both shuffled, so that Spark can split it.
    """
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    met = lambda df: settled(df.repartition("a").mapInArrow(stars, STAR))
    now = met(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(stars, STAR))
    before = sign(now)
    while before[0]:
        least = settled(now.groupBy("a").agg(F.min("b").alias("m")))
        now = met(now.join(least.select(F.col("a").alias("b"), "m").hint("shuffle_merge"), "b", "left").select("a", F.coalesce("m", "b").alias("b")))
        after = sign(now)
        if after == before:
            break
        before = after
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    return roots.select(F.col("a").alias("id"), "component").union(now.select("b", "b").distinct())
