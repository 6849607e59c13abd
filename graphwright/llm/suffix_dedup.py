"""Suffix-array dedup by prefix-free parsing.

Texts are parsed at rolling-hash triggers into phrases (see repeats): a dictionary of distinct phrases, and a parse that says which
documents have them. The suffix array of the dictionary, to a depth of `width` bytes and by letter, puts equal windows of all phrases
side by side, and the parse gives the earliest document of each run: all later ones lose these bytes.
Phrases of triggers that no other document contests are settled whole and aren't sorted. suffix_order() gives the full order of a
bounded set of texts from the same two arrays.

Contract of remove_repeated_bytes: whole texts as UTF-8 (null: empty). A byte goes if a string of `width` bytes
covers it that also starts in a document with a smaller id. Rows of one id don't remove each other; a null id counts as
the largest. One row per input row; other columns aren't read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import BLOCK_BYTES, HOT, raw, remove_repeats

WIDTH = 50
GRAM = 24
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return data.tobytes()
    keep = np.ones(len(data), bool)
    for s, e in zip(starts, ends, strict=True):
        keep[s:e] = False
    return data[keep].tobytes()


def _finish(digest: bool):
    def run(ids, texts, spans) -> pa.Table:
        rows = []
        for i, doc in enumerate(ids.tolist()):
            data, (starts, ends) = raw(texts, i), spans(i)
            kept = kept_bytes(data, starts, ends)
            row = (doc, len(data), int((ends - starts).sum()), len(starts))
            rows.append((*row, hashlib.sha256(kept).hexdigest()) if digest else (*row, kept, starts.tolist(), ends.tolist()))
        names = [x.split()[0] for x in (DIGEST if digest else SCHEMA).split(", ")]
        kinds = [pa.int64()] * 4 + ([pa.string()] if digest else [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())])
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def remove_repeated_bytes(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", digest: bool = False, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), and the kept bytes with the spans, or their digest."""
    if not 1 <= gram <= width:
        raise ValueError("gram must be from 1 to width")
    out = remove_repeats(docs, _finish(digest), DIGEST if digest else SCHEMA, width=width, gram=gram, doc_id=doc_id, text=text, block_bytes=block_bytes, hot=hot)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != (1 << 63) - 1, F.col("doc_id")))


def suffix_order(texts: list[bytes], *, window: int = 8, modulus: int = 16) -> np.ndarray:
    """Suffix array of the texts joined by zero bytes (texts hold none), by prefix-free parsing.

    A phrase ends where the rolling hash of the last `window` bytes is 0 modulo `modulus`, and the next starts with those
    bytes. The phrases are ranked by sorting the dictionary, the parse's suffixes by doubling; a suffix of the corpus is
    ordered by its phrase suffix, then by the rank of what follows in the parse. For one bounded set of texts, in memory.
    """
    joined = b"\0".join(texts) + b"\0"
    data = np.frombuffer(joined, np.uint8)
    n = len(data)
    cuts, value, power = [0], 0, pow(257, window, (1 << 61) - 1)
    for i in range(n):
        value = (value * 257 + int(data[i]) + 1) % ((1 << 61) - 1)
        if i >= window:
            value = (value - (int(data[i - window]) + 1) * power) % ((1 << 61) - 1)
        if i >= window - 1 and value % modulus == 0 and i + 1 < n:
            cuts.append(i + 1)
    # phrase k runs from the trigger that closes phrase k - 1 to the end of its own; no phrase suffix of `window` bytes or
    # more is a prefix of another, so they can be ordered by themselves
    bounds = [(max(0, c - window), e) for c, e in zip(cuts, [*cuts[1:], n], strict=True)]
    rank = {p: i for i, p in enumerate(sorted({joined[s:e] for s, e in bounds}))}
    parse = suffix_ranks(np.array([rank[joined[s:e]] for s, e in bounds]))
    suffixes: dict[bytes, list[tuple[int, int]]] = {}
    for k, (s, e) in enumerate(bounds):
        last = k + 1 == len(bounds)
        for i in range(s if k == 0 else s + 1, n if last else e - window + 1):
            suffixes.setdefault(joined[i:e], []).append((-1 if last else int(parse[k + 1]), i))
    return np.array([i for key in sorted(suffixes) for _, i in sorted(suffixes[key])])


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Rank of every suffix of an integer sequence, by doubling; a sequence's end comes first."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    size = 1
    while size < n:
        after = np.full(n, -1)
        after[:-size] = rank[size:]
        order = np.lexsort((after, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if rank.max() == n - 1:
            break
        size *= 2
    return rank
