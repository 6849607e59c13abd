"""Embedding near-dedup: an exact metric range join over pivot cells.

Cosine of at least c between unit vectors is a distance of at most r = sqrt(2 - 2 c). Every vector belongs to the cell of its nearest
pivot. By the triangle inequality a neighbour in the cell of pivot q lies within r of both the ball of that cell and the
plane halfway between the pivots, so a vector is sent on to cell q only if d(x, q) <= radius(q) + r and
(d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= r. Cells are dealt into units of bounded size, a pair of units is compared in one of
the two, and units join independently: the unit's own vectors are held, visitors stream past in batches. Only counts and
a spanning forest of the links leave a unit, never pairs. Candidates are found in single precision with a margin, and those near the bound
are computed again in double precision.

Equal vectors are one class with a count, and stand for each other. In data without clusters (random directions in many
dimensions) the inequality removes little, and the exact join approaches all pairs: that is a property of the exact
question. Pivots come from a bounded sample (SAMPLE rows); every vector is compared.

Contract of near_duplicates: null or zero vectors and those with null, NaN or infinite components link with nothing; vectors of
different lengths don't link. Rows of one id count as vectors of their own with the same component. One row per input row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, settled

COSINE = 0.95
SAMPLE = 2048
CELL = 4096
MAX_PIVOTS = 512
UNIT = "unit int, visitor boolean, id long, n long, vector binary"
LINKS = "id long, links long, root long"


def pivots_of(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first pivots among unit vectors."""
    chosen, least = [0], sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        far = int(np.argmin(least))
        if least[far] > 1 - 1e-9:
            break
        chosen.append(far)
        least = np.maximum(least, sample @ sample[far])
    return sample[chosen]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1. Each is scaled by its largest component first, so that no square over- or underflows."""
    x = np.array(x, float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def packed(rows: DataFrame) -> DataFrame:
    """(id, n, vector): vectors as doubles in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(2).flatten(), float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "n", "vector"])

    return rows.select("id", "n", "vector").mapInArrow(run, "id long, n long, vector binary")


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(np.maximum(0, 2 - 2 * (unit_rows(x) @ pivots.T)))
    return d, d.argmin(1)


def measured(pivots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d, home = nearest(matrix(b.column(0)), pivots)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(d[np.arange(len(home)), home])], names=["cell", "far"])

    return run


def sent(pivots: np.ndarray, counts: np.ndarray, radii: np.ndarray, r: float, cell: int) -> Callable:
    parts = np.maximum(1, -(-counts // cell))
    first = np.cumsum(parts) - parts
    between = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    units_cell = np.repeat(np.arange(len(parts)), parts)
    units = np.arange(len(units_cell))
    slack = 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x, ids = matrix(b.column(2)), np.array(b.column(0))
                d, home = nearest(x, pivots)
                own = d[np.arange(len(home)), home][:, None]
                reach = (d <= radii + r + slack) & ((d * d - own * own) <= 2 * between[home] * (r + slack) + slack)
                reach[np.arange(len(home)), home] = True
                chunk = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[home]
                unit = first[home] + chunk
                there = reach[:, units_cell]
                low, high = np.minimum(unit[:, None], units), np.maximum(unit[:, None], units)
                there &= np.where((low + high) % 2 == 0, low, high) == units  # where the two units meet
                there[np.arange(len(unit)), unit] = True
                row, to = np.nonzero(there)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array(to != unit[row]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row))],
                    names=["unit", "visitor", "id", "n", "vector"],
                )

    return run


class Unit:
    """The own vectors of a unit, their counts of links and their labels."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray, cosine: float):
        self.ids, self.n, self.x, self.cosine = ids, n, unit_rows(x), cosine
        self.f32 = self.x.astype(np.float32)
        self.links = np.zeros(len(ids), np.int64)
        self.label = np.arange(len(ids))
        for at in range(0, len(ids), 512):
            hit = self.hits(x[at : at + 512])
            k = np.arange(len(hit))
            hit[k, at + k] = False
            self.links[at : at + len(hit)] += hit @ self.n
            self.join(hit, own=at)

    def hits(self, y: np.ndarray) -> np.ndarray:
        y = unit_rows(y)
        got = y.astype(np.float32) @ self.f32.T
        hit = got >= self.cosine
        i, j = np.nonzero(np.abs(got - np.float32(self.cosine)) < 1e-4)
        if len(i):
            hit[i, j] = np.einsum("ij,ij->i", y[i], self.x[j]) >= self.cosine
        return hit

    def join(self, hit: np.ndarray, own: int | None = None) -> np.ndarray:
        """Labels become one along rows of links; the first linked vector of each row, -1 if none."""
        first = np.where(hit.any(1), hit.argmax(1), -1)
        for i in np.flatnonzero(first >= 0):
            labels = self.label[hit[i]]
            least = labels.min() if own is None else min(labels.min(), self.label[own + i])
            if (labels != least).any() or own is not None and self.label[own + i] != least:
                old = np.unique(labels if own is None else np.append(labels, self.label[own + i]))
                self.label[np.isin(self.label, old)] = least
        return first

    def visit(self, ids: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple:
        hit = self.hits(y)
        self.links += n @ hit
        first = self.join(hit)
        got = np.flatnonzero(first >= 0)
        return ids[got], (hit @ self.n)[got], self.ids[first[got]]

    def close(self) -> tuple:
        root = self.ids[self.label]
        got = np.flatnonzero((self.links > 0) | (root != self.ids))
        return self.ids[got], self.links[got], root[got]


def joined(cosine: float) -> Callable:
    """Rows come sorted by unit, its own vectors first."""

    def out(ids: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], names=["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, unit = None, [], None
        for b in batches:
            units, visits = np.array(b.column(0)), np.array(b.column(1))
            edges = np.flatnonzero((np.diff(units) != 0) | (np.diff(visits.astype(int)) != 0)) + 1
            for rows in np.split(np.arange(b.num_rows), edges):
                if not len(rows):
                    continue
                part = b.slice(int(rows[0]), len(rows))
                ids, n, x = np.array(part.column(2)), np.array(part.column(3)), matrix(part.column(4))
                if units[rows[0]] != number:
                    if held:
                        unit, held = Unit(*(np.concatenate(z) for z in zip(*held, strict=True)), cosine), []
                    if unit:
                        yield out(*unit.close())
                    number, unit = units[rows[0]], None
                if not visits[rows[0]]:
                    held.append((ids, n, x))
                    continue
                if held:
                    unit, held = Unit(*(np.concatenate(z) for z in zip(*held, strict=True)), cosine), []
                if unit:
                    for at in range(0, len(ids), 1024):
                        yield out(*unit.visit(ids[at : at + 1024], n[at : at + 1024], x[at : at + 1024]))
        if held:
            unit = Unit(*(np.concatenate(z) for z in zip(*held, strict=True)), cosine)
        if unit:
            yield out(*unit.close())

    return run


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept: links are pairs of other rows with cosine of at least `cosine` (over 0)."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be over 0 and at most 1")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    valid = F.coalesce(F.col("vec_id").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda v: v != 0), F.lit(False))
    good = rows.where(valid)
    classes = settled(good.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    parts = []
    for (length,) in classes.select(F.size("vector")).distinct().collect():
        of = packed(classes.where(F.size("vector") == length))
        total = classes.where(F.size("vector") == length).count()
        sample = of.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
        pivots = pivots_of(unit_rows([np.frombuffer(r[0], "<f8") for r in sample]), max(1, min(MAX_PIVOTS, math.ceil(total / cell))))
        counts, radii = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        for c, size, far in of.select("vector").mapInArrow(measured(pivots), "cell int, far double").groupBy("cell").agg(F.count("*"), F.max("far")).collect():
            counts[c], radii[c] = size, far
        r = math.sqrt(2 - 2 * cosine)
        placed = of.mapInArrow(sent(pivots, counts, radii, r, cell), UNIT)
        n_units = int(np.maximum(1, -(-counts // cell)).sum())
        parts.append(placed.repartition(max(1, n_units), "unit").sortWithinPartitions("unit", "visitor", "id").mapInArrow(joined(cosine), LINKS))
    found = None
    for p in parts:
        found = p if found is None else found.union(p)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = settled(found)
    reach = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    stats = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(stats, "id", "left").join(reach, "id", "left").select(
        "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    hit = good.join(known, "vector").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return hit.union(rows.where(~valid).select("vec_id", F.lit(0).cast("long"), F.col("vec_id"), F.lit(True)))
