"""MinHash near-dedup by ProbMinHash over weighted word shingles, banding and exact verification.

Shingles are `shingle` consecutive words `[^\\x20\\x09-\\x0D]+` (all of them in a shorter text), weighted by how often they occur in the text. Each
shingle sends arrivals of a Poisson process with its weight as rate to random slots; a slot keeps the shingle of the first arrival, and a
shingle stops when its next arrival is later than all that the slots hold. The share of equal slots estimates the probability Jaccard
J_P(x, y) = sum over d in both of 1 / sum over e of max(x_e / x_d, y_e / y_d). Slots are banded, and rows that share a band are
candidates. Within a bucket, a maximum spanning forest by the estimate proposes one edge fewer than rows, and each edge is verified by the
exact J_P of both whole texts. What these links leave apart is swept: in every bucket with several components, each row outside the largest
one meets every row of the other components, with its whole text, and the exact J_P decides. So each pair that shares a band is
joined by verified links in the end, or was itself found below the similarity: estimates only choose what is tried first. Large buckets are dealt into parts by rows and by size, so that no
bucket is one task; rows that ask meet every part; only links leave a task, one for each component that a row joins there.

Texts with equal word sequences are one class before all that. Contract of near_duplicates: one row per input row, cluster_id is the smallest doc_id
reachable by links of at least `similarity`; null and wordless texts link with nothing; null ids neither (null cluster). Rows of
one id are one node of the links, with the links of all their texts; each row's cluster is that of its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, settled
from .hashing import U64, Rolling, mix
from .repeats import raw, word_symbols

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 16, 4
#: Rows of a bucket that are compared at once.
PART = 512
#: Shingles of a part that are compared at once.
PART_SHINGLES = 1 << 18
#: The forests propose no edge whose estimate is below the similarity by more than this; the sweep meets all pairs, whatever their estimate.
SLACK = 0.22
SKETCH = "doc_id long, content binary, size long, slots binary, bands array<long>"


def shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text by hash, and how often each occurs."""
    if not len(words):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    size = min(size, len(words))
    return np.unique(mix(Rolling(words, size).at(size)), return_counts=True)


def prob_minhash(hashes: np.ndarray, weights: np.ndarray, row: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Slots (rows x m) of weighted sets: the mixed hash of the element that arrived first."""
    first = np.full(rows * m, np.inf)
    slots = np.zeros(rows * m, U64)
    state, time = hashes.copy(), np.zeros(len(hashes))
    while len(hashes):
        state = mix(state + U64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> U64(11)).astype(float) + 0.5) * 2.0**-53) / weights
        cell = row * m + (mix(state ^ U64(0x5851F42D4C957F2D)) % U64(m)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = first[cell] == time
        slots[cell[won]] = mix(hashes[won] + U64(7))
        latest = first.reshape(rows, m).max(1)
        alive = time < latest[row]
        hashes, weights, row, state, time = (x[alive] for x in (hashes, weights, row, state, time))
    return slots.reshape(rows, m)


def sketches(shingle: int, bands: int, band_rows: int) -> Callable:
    m = bands * band_rows

    def some(ids: list, words: list[np.ndarray]) -> pa.RecordBatch:
        sets = [shingles(w, shingle) for w in words]
        h, w = (np.concatenate(x) for x in zip(*sets, strict=True))
        row = np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets])
        slots = prob_minhash(h, w.astype(float), row, len(sets), m)
        keys = np.arange(bands, dtype=U64) * U64(0xA0761D6478BD642F) + slots[:, ::band_rows]
        for k in range(1, band_rows):
            keys = mix(keys) + slots[:, k::band_rows]
        keys, prints = mix(keys).view(np.int64), (slots >> U64(56)).astype(np.uint8)
        content = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in words]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(content), pa.array([len(x) for x in words], pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["doc_id", "content", "size", "slots", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held, size = b.column(0).to_pylist(), b.column(1), [], 0
            for i in range(b.num_rows):
                words = word_symbols(raw(texts, i))
                if not len(words):
                    continue
                held.append((ids[i], words))
                size += len(words)
                if size > 1 << 17:
                    yield some(*map(list, zip(*held, strict=True)))
                    held, size = [], 0
            if held:
                yield some(*map(list, zip(*held, strict=True)))

    return run


def forest(ids: np.ndarray, prints: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Edges (a, b, estimate) of a maximum spanning forest over rows whose slots agree in a share of at least `least`."""
    n = len(ids)
    if n == 2:
        s = float((prints[0] == prints[1]).mean())
        return [(int(ids[0]), int(ids[1]), s)] if s >= least else []
    best, link, left, out = np.full(n, -1.0), np.zeros(n, np.int64), np.ones(n, bool), []
    at = 0
    for _ in range(n - 1):
        left[at] = False
        s = (prints == prints[at]).mean(1)
        better = left & (s > best)
        best[better], link[better] = s[better], at
        at = int(np.argmax(np.where(left, best, -2.0)))
        if best[at] >= least:
            out.append((int(ids[link[at]]), int(ids[at]), float(best[at])))
    return out


def forests(least: float) -> Callable:
    """(a, b): edges of the forest of each bucket and part; rows (band, part, id, slots) are sorted by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, edges = None, [], []

        def close() -> None:
            if len(held) > 1:
                edges.extend(forest(np.array([h[0] for h in held]), np.array([np.frombuffer(h[1], np.uint8) for h in held]), least))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], names=["a", "b"])

        for b in batches:
            for band, part, i, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (band, part) != key:
                    close()
                    key, held = (band, part), []
                held.append((i, p))
            if len(edges) > 1 << 14:
                yield batch()
                edges = []
        close()
        yield batch()

    return run


def candidates(rows: DataFrame, sizes: DataFrame, least: float, part: int) -> DataFrame:
    """(a, b): likely links between rows (band, id, slots) by bucket and part; what lies in different parts meets in the sweep."""
    # both sides are shuffled, so that Spark can split a bucket that many share
    dealt = rows.join(sizes.hint("shuffle_merge"), "band").select("band", own_part(F.ceil(F.col("n") / part)).alias("part"), "id", "slots")
    return settled(dealt.repartition("band", "part").sortWithinPartitions("band", "part", "id").mapInArrow(forests(least), "a long, b long")).distinct()


def own_part(parts: Column) -> Column:
    """By id and bucket, so that what one band keeps apart meets in another."""
    return F.pmod(F.xxhash64("id", "band"), parts).cast("int")


def probability_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets (sorted distinct hashes, weights)."""
    if not len(x[0]) or not len(y[0]):
        return 0.0
    keys = np.union1d(x[0], y[0])
    a, b = np.zeros(len(keys)), np.zeros(len(keys))
    a[np.searchsorted(keys, x[0])], b[np.searchsorted(keys, y[0])] = x[1], y[1]
    ratio = a / np.where(b > 0, b, 1)
    ratio[b == 0] = np.inf
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    above = a.sum() - np.cumsum(a)  # elements with a larger ratio count by a, the others by b
    upto = np.cumsum(b)
    last = np.searchsorted(ratio, ratio, side="right") - 1
    both = (a > 0) & (b > 0)
    return float((1 / (above[last][both] / a[both] + upto[last][both] / b[both])).sum())


def verified(shingle: int, similarity: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            s = np.array([probability_jaccard(shingles(word_symbols(raw(x, i)), shingle), shingles(word_symbols(raw(y, i)), shingle)) for i in range(b.num_rows)])
            keep = pa.array(s >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


class Part:
    """Texts of a part of a bucket: their shingles end to end, components (joined here as links are found), and bands."""

    def __init__(self, ids: list, labels: list, asks: list, bands: list, sets: list):
        self.ids, self.asks, self.bands, self.sets = np.array(ids, np.int64), np.array(asks, bool), np.array(bands, np.int64), sets
        self.labels, self.joined = np.array(labels, np.int64), {}
        self.hashes = np.concatenate([h for h, _ in sets])
        self.shares = np.concatenate([w / w.sum() for _, w in sets])
        self.row = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])

    def links(self, i: int, label: int, bands: np.ndarray, band: int, own: tuple, similarity: float) -> Iterator[tuple[int, int]]:
        """Components that verified links of this text join. Pairs that share an earlier band meet there; of two texts that ask, the later id does."""
        while label in self.joined:
            label = self.joined[label]
        first = int(np.flatnonzero(bands == band)[0])
        other = (self.labels != label) & ~(self.asks & (self.ids > i)) & ~(self.bands[:, :first] == bands[:first]).any(1)
        if not other.any():
            return
        h, w = own
        at = np.minimum(np.searchsorted(h, self.hashes), len(h) - 1)
        both = np.flatnonzero((h[at] == self.hashes) & other[self.row])
        # two sets agree in no more than the lesser shares of what both have
        bound = np.bincount(self.row[both], np.minimum(self.shares[both], (w / w.sum())[at[both]]), len(self.ids))
        for k in np.argsort(-bound, kind="stable")[: int((bound >= similarity - 1e-9).sum())].tolist():
            theirs = int(self.labels[k])
            if theirs != label and probability_jaccard(own, self.sets[k]) >= similarity - 1e-12:
                high, low = max(theirs, label), min(theirs, label)
                self.joined[high] = low
                self.labels[self.labels == high] = low
                label = low
                yield high, low


def sweep(shingle: int, similarity: float) -> Callable:
    """Rows (band, part, guest, id, asks, c, bands, text) sorted by these: of a part of a bucket, first its rows, then the guests that ask. To (a, b): components that verified links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part, a, b = None, [], None, [], []
        for batch in batches:
            band, number, guest, ids, asks, c = (batch.column(k).to_pylist() for k in range(6))
            bands, texts = np.array(batch.column(6).flatten(), np.int64).reshape(batch.num_rows, -1), batch.column(7)
            for i in range(batch.num_rows):
                if (band[i], number[i]) != key:
                    key, held, part = (band[i], number[i]), [], None
                own = shingles(word_symbols(raw(texts, i)), shingle)
                if not guest[i]:
                    held.append((ids[i], c[i], asks[i], bands[i], own))
                    continue
                if part is None and held:
                    part, held = Part(*map(list, zip(*held, strict=True))), []
                for x, y in part.links(ids[i], c[i], bands[i], band[i], own, similarity) if part else ():
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []

    return run


def apart(classes: DataFrame, texts: DataFrame, reach: DataFrame, shingle: int, similarity: float, part: int) -> DataFrame:
    """(a, b): components that links join which the verified ones left apart within a bucket. texts: (id, text) of the rows that share a band with another."""
    state = classes.join(reach, "id", "left").select("id", "size", "bands", F.coalesce("component", "id").alias("c"), F.explode("bands").alias("band"))
    tally = state.groupBy("band", "c").agg(F.count("*").alias("n"), F.sum("size").alias("s")).groupBy("band").agg(F.max(F.struct("n", "c"))["c"].alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k"))
    tally = settled(tally.where("k > 1").select("band", "top", F.ceil(F.greatest(F.col("n") / part, F.col("s") / PART_SHINGLES)).cast("int").alias("parts")))
    # both sides are shuffled, so that Spark can split a bucket that many share
    live = state.join(tally.hint("shuffle_merge"), "band").select("id", "band", "parts", (F.col("c") != F.col("top")).alias("asks"), "c", "bands")
    rows = settled(live).join(texts.hint("shuffle_merge"), "id")
    held = rows.select("band", own_part(F.col("parts")).alias("part"), F.lit(0).alias("guest"), "id", "asks", "c", "bands", "text")
    # rows that ask go to every part of their bucket
    asking = rows.where("asks").select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("guest"), "id", "asks", "c", "bands", "text")
    met = held.union(asking).repartition("band", "part").sortWithinPartitions("band", "part", "guest", "id")
    return settled(met.mapInArrow(sweep(shingle, similarity), "a long, b long"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS, part: int = PART) -> DataFrame:
    """doc_id, cluster_id, n_same (rows of equal words, itself included), kept (doc_id = cluster_id)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = rows.where("doc_id is not null")
    sketch = settled(texts.mapInArrow(sketches(shingle, bands, band_rows), SKETCH))
    classes = settled(sketch.groupBy("content").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.any_value("size").alias("size"), F.any_value("slots").alias("slots"), F.any_value("bands").alias("bands")))
    banded = classes.select(F.explode("bands").alias("band"), "id", "slots")
    sizes = settled(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    ends = settled(banded.select("band", "id").join(sizes.hint("shuffle_merge"), "band").select("id").distinct())
    # rows of one id count with each of their texts
    sharers = settled(texts.select(F.col("doc_id").alias("id"), "text").join(ends, "id", "left_semi").dropDuplicates(["id", "text"]))
    edges = candidates(banded, sizes, similarity - SLACK, part)
    pairs = edges.join(sharers.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(sharers.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    links = settled(pairs.select("a", "b", "x", "y").mapInArrow(verified(shingle, similarity), "a long, b long"))
    reach = settled(components(links))
    more = apart(classes, sharers, reach, shingle, similarity, part)
    if not more.isEmpty():
        merged = settled(components(more))
        moved = reach.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        reach = moved.union(merged.join(reach, "id", "left_anti").select("id", "component"))
    known = classes.join(reach, "id", "left").select("content", "n", F.coalesce("component", "id").alias("cluster_id"))
    grouped = sketch.select("doc_id", "content").join(known, "content").select("doc_id", "cluster_id", F.col("n").alias("n_same"))
    lone = rows.where(F.col("doc_id").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return grouped.union(lone.select("doc_id", F.col("doc_id"), F.lit(1).cast("long"))).select("doc_id", "cluster_id", "n_same", F.coalesce(F.col("doc_id") == F.col("cluster_id"), F.lit(True)).alias("kept"))
