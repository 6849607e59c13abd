"""Triangles of each edge, by blocks of nodes that hold their out-lists and are sent those of others.

Edges point to the larger end. A node's out-list (its larger neighbours) goes to each block that has one of them, once and whole from there on, so the
shuffle carries at most an edge once per block, and one list of 4-byte ids in place of a row for each wedge. In a block, of the two lists of an edge
the shorter is looked up in the other: never more than the sum of least degrees over the edges, whatever hubs there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, settled

#: Edges of a block: at most (but one node's list stays whole), and at least.
MOST, LEAST = 1 << 22, 1 << 16
#: Blocks that small graphs are cut into, where LEAST allows.
BLOCKS = 24
#: Candidates that are looked up at a time.
CHUNK = 1 << 21
SENT = "block int, kind int, graph_id string, node int, near array<int>"
FOUND = "graph_id string, node int, near array<int>, n array<long>"


def keyed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One 64-bit key of two 32-bit numbers, in their order."""
    return (high.astype(np.int64) << 32) + low.astype(np.int64) + (1 << 31)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, so many as length, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are in the sorted keys, and where."""
    at = np.searchsorted(keys, wanted)
    hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == wanted) if len(keys) else np.zeros(0, np.int64)
    return hit, at[hit]


class Block:
    """Out-lists of a block's nodes: heads (graph, node) in order, their lists one after the other."""

    def __init__(self, rows: list[tuple[str, int, np.ndarray]]):
        rows.sort(key=lambda x: x[:2])
        self.names = sorted({r[0] for r in rows})
        self.number = {name: k for k, name in enumerate(self.names)}
        self.graph = np.array([self.number[r[0]] for r in rows], np.int64)
        self.node = np.array([r[1] for r in rows], np.int64)
        self.heads = keyed(self.graph, self.node)
        self.start = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int64)
        self.near = np.concatenate([r[2] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.keys = keyed(np.repeat(np.arange(len(rows)), np.diff(self.start)), self.near)
        self.count = np.zeros(len(self.near), np.int64)

    def meet(self, graph: np.ndarray, start: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Lists of other nodes, each sorted: how many triangles each entry is on. Edges of the block are counted on the way."""
        row = np.repeat(np.arange(len(graph)), np.diff(start))
        mine, n = keyed(row, near), np.zeros(len(near), np.int64)
        edge, b = found(self.heads, keyed(graph[row], near))
        rest, own = start[row[edge] + 1] - edge - 1, self.start[b + 1] - self.start[b]
        cost = np.cumsum(np.minimum(rest, own))
        low = 0
        while low < len(edge):
            high = max(low + 1, int(np.searchsorted(cost, (cost[low - 1] if low else 0) + CHUNK, "right")))
            for shorter in (True, False):
                k = low + np.flatnonzero((own[low:high] <= rest[low:high]) == shorter)
                size = (own if shorter else rest)[k]
                which = np.repeat(k, size)
                if shorter:
                    t = spread(self.start[b[k]], size)
                    hit, j = found(mine, keyed(row[edge[which]], self.near[t]))
                    t = t[hit]
                else:
                    j = spread(edge[k] + 1, size)
                    hit, t = found(self.keys, keyed(b[which], near[j]))
                    j = j[hit]
                np.add.at(n, edge[which[hit]], 1)
                np.add.at(n, j, 1)
                np.add.at(self.count, t, 1)
            low = high
        return n


def rows_of(names: list[str], graph: np.ndarray, node: np.ndarray, start: np.ndarray, near: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Entries that are on a triangle, as lists again."""
    on = n > 0
    size = np.add.reduceat(np.append(on, False).astype(np.int64), start[:-1])[: len(graph)] if len(graph) else np.zeros(0, np.int64)
    size = np.where(np.diff(start) > 0, size, 0)
    some = size > 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(size[some])]).astype(np.int32))
    lists = (pa.ListArray.from_arrays(offsets, pa.array(x[on], t)) for x, t in ((near, pa.int32()), (n, pa.int64())))
    return pa.RecordBatch.from_arrays([pa.array([names[g] for g in graph[some]], pa.string()), pa.array(node[some], pa.int32()), *lists], names=["graph_id", "node", "near", "n"])


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    start = column.offsets.to_numpy().astype(np.int64)
    return start - start[0], column.flatten().to_numpy(zero_copy_only=False)


def sender(cuts: list[tuple[str, int]]):
    """Out-lists to their own block (kind 0), and to each other block that has an entry, from that entry on (kind 1)."""
    by_graph: dict[str, tuple[int, np.ndarray]] = {}
    for k, (name, _) in enumerate(cuts):
        if name not in by_graph:
            by_graph[name] = (k, np.array([v for g, v in cuts if g == name], np.int64))
    names = sorted(by_graph)

    def blocks(name: str, nodes: np.ndarray) -> np.ndarray:
        """How many cuts are not over (name, node)."""
        before, own = by_graph.get(name) or (sum(len(by_graph[g][1]) for g in names if g < name), np.zeros(0, np.int64))
        return before + np.searchsorted(own, nodes, "right")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            graph, node, (start, near) = batch.column(0).to_pylist(), batch.column(1).to_numpy(), lists_of(batch.column(2))
            held, size = [], 0
            for k, name in enumerate(graph):
                own = near[start[k] : start[k + 1]]
                home = int(blocks(name, node[k : k + 1])[0])
                to = blocks(name, own)
                first = np.flatnonzero(np.diff(to, prepend=-1))
                held.append((home, 0, name, node[k], own))
                held += [(int(to[i]), 1, name, node[k], own[i:]) for i in first if to[i] != home and i + 1 < len(own)]
                size += len(own) * (1 + len(first))
                if size > CHUNK or k + 1 == len(graph):
                    c = list(zip(*held, strict=True))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c[4]])]).astype(np.int32)), pa.array(np.concatenate(c[4]), pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.int32()), lists], names=["block", "kind", "graph_id", "node", "near"])
                    held, size = [], 0

    return send


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SENT by block and kind to entries with their triangles."""
    held: list[tuple[str, int, np.ndarray]] = []
    block, at = None, None

    def ended() -> Iterator[pa.RecordBatch]:
        if block is not None:
            for low in range(0, len(block.heads), 8192):
                high = min(low + 8192, len(block.heads))
                s = block.start[low : high + 1]
                yield rows_of(block.names, block.graph[low:high], block.node[low:high], s - s[0], block.near[s[0] : s[-1]], block.count[s[0] : s[-1]])

    def opened() -> Block:
        new = Block(held)
        for low in range(0, len(new.heads), 8192):
            s = new.start[low : min(low + 8192, len(new.heads)) + 1]
            new.count[s[0] : s[-1]] += new.meet(new.graph[low : low + 8192], s - s[0], new.near[s[0] : s[-1]])
        held.clear()
        return new

    for batch in batches:
        number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(number, prepend=number[:1]) != 0) | (np.diff(kind, prepend=kind[:1]) != 0)) if len(number) else []
        for low, high in zip([0, *edges], [*edges, len(number)], strict=True):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            if number[low] != at:
                if held:
                    block = opened()
                yield from ended()
                block, at = None, number[low]
            graph, node, (start, near) = part.column(2).to_pylist(), part.column(3).to_numpy(), lists_of(part.column(4))
            if kind[low] == 0:
                held += [(g, int(node[k]), near[start[k] : start[k + 1]].copy()) for k, g in enumerate(graph)]
                continue
            if block is None:
                block = opened()
            g = np.array([block.number.get(x, -1) for x in graph], np.int64)
            n = block.meet(g, start, near)
            yield rows_of([*block.names, ""], g, node, start, near, n)
    if held:
        block = opened()
    yield from ended()


def cuts_of(lists: DataFrame, edges: int) -> list[tuple[str, int]]:
    """Ends between blocks of (graph_id, node): fine ranges of nodes, put together up to a block's edges."""
    most = min(MOST, max(LEAST, edges // BLOCKS))
    fine = lists.select("graph_id", "node", F.size("near").alias("n")).repartitionByRange(max(1, min(4096, 8 * edges // most)), "graph_id", "node")
    found = fine.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("graph_id", "node")).alias("first"), F.sum("n").alias("n")).collect()
    cuts, held = [], 0
    for r in sorted(found, key=lambda x: (x.first.graph_id, x.first.node)):
        if held and held + r.n > most:
            cuts.append((r.first.graph_id, r.first.node))
            held = 0
        held += r.n
    return cuts


def support(graph: Graph) -> DataFrame:
    """(graph_id, src, dst, weight, support) of edges src < dst of positive weight."""
    e = (graph.edges if graph.upper is None else graph.upper).where("src < dst and weight > 0")
    pairs = F.sort_array(F.collect_list(F.struct("dst", "weight")))
    near = e.groupBy("graph_id", F.col("src").alias("node")).agg(pairs.alias("s"))
    lists = settled(near.select("graph_id", "node", F.col("s.dst").alias("near"), F.col("s.weight").alias("weights")))
    edges = lists.agg(F.sum(F.size("near"))).first()[0] or 0
    cuts = cuts_of(lists, edges)
    sent = lists.select("graph_id", "node", "near").mapInArrow(sender(cuts), SENT)
    # a block is a partition, so that the largest task has one block
    met = sent.repartitionById(len(cuts) + 1, F.col("block")).sortWithinPartitions("block", "kind").mapInArrow(counted, FOUND)
    both = lists.select("graph_id", "node", "near", "weights", F.array().cast("array<long>").alias("n")).union(met.select("graph_id", "node", "near", F.array().cast("array<double>"), "n"))
    # lists travel whole and are taken apart where they arrive
    each = both.repartition(max(1, -(-edges // (MOST // 4))), "graph_id", "node").select("graph_id", F.col("node").alias("src"), F.explode(F.arrays_zip("near", "weights", "n")).alias("x"))
    return each.groupBy("graph_id", "src", F.col("x.near").alias("dst")).agg(F.max("x.weights").alias("weight"), F.coalesce(F.sum("x.n"), F.lit(0)).alias("support"))
