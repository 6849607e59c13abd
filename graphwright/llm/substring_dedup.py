"""Substring dedup by Rabin-Karp hashes of fixed-length windows of words.

Words are `[^\\x20\\x09-\\x0D]+`, hashed to 64 bits; the rolling hash of every window of `width` words is taken. A block of documents sends its distinct hashes to
their buckets, Spark counts in how many blocks each stands (groupBy and count), and a bucket tells each block which of its windows an earlier document
has. Windows that repeat within a block are settled there. Repeated windows merge into maximal removal intervals. A window that a third of all
documents share is one entry a block. Windows are told apart by 64 bits: n of them match falsely at a chance of about n^2 / 2^65.

Contract: whole texts (null: no words). A word goes if a window of `width` words of its document covers it whose words also
start in a document with a smaller id. Rows of one id don't remove each other; a null id counts as the largest. One row per
input row; other columns aren't read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U64, Rolling, mix, release, word_spans
from .repeats import BLOCK_BYTES, NO_ID, bucket_of, chunks, dealt, distinct, merged, ordered, planes, raw, unplanes, within, word_symbols

WIDTH = 50
#: Tasks that buckets are dealt to at most, where the session asks for no more.
MAX_TASKS = 20_000
#: From a block to a bucket: distinct hashes of windows in rising order, and for each the least document of the block. Back: places in there.
ASKED = "dest int, block int, prints array<long>, docs binary"
TOLD = "block int, bucket int, places binary"
SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, starts array<long>, ends array<long>, text_sha256 string"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def kept_words(data: bytes, removed: tuple[np.ndarray, np.ndarray]) -> tuple[int, bytes]:
    """How many words a text has, and those outside the removed intervals of words, joined by one space."""
    words = data.split()  # splits at the same six separators
    for s, e in zip(*(x.tolist()[::-1] for x in removed), strict=True):
        del words[s:e]
    return len(words), b" ".join(words)


def trimmed_text(data: bytes, removed: tuple[np.ndarray, np.ndarray]) -> str:
    """The text without the removed words and the white space after each; the text itself if none goes."""
    if not len(removed[0]):
        return data.decode()
    starts, ends = word_spans(np.frombuffer(data, np.uint8))
    out, at = [], 0
    for s, e in zip(*(x.tolist() for x in removed), strict=True):
        out.append(data[at : starts[s]])
        at = starts[e] if e < len(starts) else len(data)
    return b"".join([*out, data[at:]]).decode()


def _finish(digest: bool):
    def run(ids, texts, spans) -> pa.Table:
        rows = []
        for i, doc in enumerate(ids.tolist()):
            data, cut = raw(texts, i).tobytes(), spans(i)
            gone = int((cut[1] - cut[0]).sum())
            n, kept = kept_words(data, cut)
            rows.append((doc, n + gone, gone, hashlib.sha256(kept).hexdigest()) if digest else (doc, n + gone, gone, trimmed_text(data, cut), cut[0].tolist(), cut[1].tolist(), hashlib.sha256(data).hexdigest()))
        names = [x.split()[0] for x in (DIGEST if digest else SCHEMA).split(", ")]
        kinds = [pa.int64()] * 3 + [pa.string()] + ([] if digest else [*[pa.list_(pa.int64())] * 2, pa.string()])
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


class Windows:
    """All windows of a block: row of the text, place, and the distinct hashes with the first window of each."""

    def __init__(self, table: pa.Table, width: int):
        self.ids, self.texts = ordered(table)
        rows, at, prints = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for x, pieces in chunks(self.texts, word_symbols, width):
            where, counts = within(pieces), pieces[:, 3]
            value = Rolling(x, width).at(width)[where]
            rows.append(np.repeat(pieces[:, 0].astype(np.int32), counts))
            at.append(where + np.repeat(pieces[:, 1] - pieces[:, 2], counts))
            prints.append(mix(value, value))
        self.row, self.at, prints = (np.concatenate(x) for x in (rows, at, prints))
        self.first, self.number = distinct(prints)
        self.prints = prints[self.first]

    def edges(self, buckets: int) -> np.ndarray:
        """Where each bucket's hashes begin: these rise, and so do their buckets."""
        return np.searchsorted(bucket_of(self.prints, buckets), np.arange(buckets + 1))


def ask(width: int, buckets: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        w = Windows(table, width)
        docs, edge = w.ids[w.row[w.first]], w.edges(buckets)
        to = np.flatnonzero(np.diff(edge)).astype(np.int32)
        prints = pa.ListArray.from_arrays(pa.array(np.append(edge[to], len(w.prints)).astype(np.int32)), pa.array(w.prints.view(np.int64)))
        bodies = [planes(docs[edge[k] : edge[k + 1]]) for k in to]
        out = pa.table([pa.array(to), pa.array(np.full(len(to), table["block"][0].as_py(), np.int32)), prints, pa.array(bodies, pa.binary())], names=["dest", "block", "prints", "docs"])
        del w
        release()
        return out

    return run


def tell(key: tuple, asked: pa.Table, repeated: pa.Table) -> pa.Table:
    """Which windows of each block an earlier document has, of those that stand in several blocks."""
    hot, blocks, found = np.sort(repeated["print"].to_numpy().view(U64)), asked["block"].to_pylist(), []
    for prints, body in zip(asked["prints"].combine_chunks(), asked["docs"], strict=True):
        x, docs = prints.values.to_numpy().view(U64), unplanes(body.as_buffer(), len(prints))
        at = np.minimum(np.searchsorted(hot, x), max(0, len(hot) - 1))
        place = np.flatnonzero(hot[at] == x) if len(hot) else np.zeros(0, np.int64)
        found.append((at[place], docs[place], place))
    least = np.full(len(hot), NO_ID)
    for which, docs, _ in found:
        np.minimum.at(least, which, docs)
    rows = [(block, key[0].as_py(), place[docs > least[which]].astype("<u4").tobytes()) for block, (which, docs, place) in zip(blocks, found, strict=True)]
    columns = list(zip(*(r for r in rows if r[2]), strict=True)) or [[]] * 3
    release()
    return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["block", "bucket", "places"])


def settle(width: int, buckets: int, finish: Callable) -> Callable:
    def run(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        w = Windows(table, width)
        edge, gone = w.edges(buckets), np.zeros(len(w.first), bool)
        for bucket, places in zip(told["bucket"].to_pylist(), told["places"], strict=True):
            gone[edge[bucket] + np.frombuffer(places.as_buffer(), "<u4")] = True
        doc = w.ids[w.row]
        hit = np.flatnonzero(gone[w.number] | (doc > doc[w.first][w.number]))
        row, start, end = merged(w.row[hit], w.at[hit], np.full(len(hit), width))
        edge, ids, texts = np.searchsorted(row, np.arange(len(w.ids) + 1)), w.ids, w.texts
        del w, doc, hit, gone
        out = finish(ids, texts, lambda i: (start[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]]))
        release()
        return out

    return run


def remove_repeated_words(docs: DataFrame, *, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", digest: bool = False, with_digest: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, and the trimmed text with the removed intervals of words (with_digest: and the digest of the whole text), or the kept words' digest."""
    if width < 1:
        raise ValueError("width must be 1 at least")
    blocks, n = dealt(docs, doc_id, text, block_bytes)
    by_block = blocks.groupBy("block")
    # about one bucket a task, so that the table of counts that a task holds is small
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n, MAX_TASKS))
    asked = by_block.applyInArrow(ask(width, n), ASKED).repartition(tasks, "dest")
    # both uses name all columns and stay where the hashes were dealt to, so that these are shuffled once
    there = F.when((F.col("block") >= 0) & (F.octet_length("docs") > 0), F.col("prints"))
    repeated = asked.select("dest", F.explode(there).alias("print")).groupBy("dest", "print").agg(F.count("*").alias("blocks")).where("blocks > 1").select("dest", "print")
    told = asked.groupBy("dest").cogroup(repeated.groupBy("dest")).applyInArrow(tell, TOLD)
    out = by_block.cogroup(told.groupBy("block")).applyInArrow(settle(width, n, _finish(digest)), DIGEST if digest else SCHEMA)
    out = out if digest or with_digest else out.drop("text_sha256")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def trimmed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", width: int = WIDTH) -> DataFrame:
    """The table with repeated passages cut from its texts, and n_chars (if it has that column) counted anew.

    Documents that lose all their words go; those that lose none keep their text as it is. Rows of one id and text are cut alike; rows of one id with
    other texts, and rows without an id (the largest), each by their own text.
    """
    cut = remove_repeated_words(docs, width=width, doc_id=doc_id, text=text, with_digest=True).where("n_removed > 0")
    # a cut belongs to an id and the text that it was taken from
    cut = cut.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("text_sha256").alias("__print"), F.col("kept_text").alias("__kept"), F.col("n_words").alias("__n"), F.col("n_removed").alias("__gone"))
    own = (F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)) == F.col("__id")) & (F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256) == F.col("__print"))
    out = docs.join(cut.dropDuplicates(["__id", "__print"]), own, "left").where("__gone is null or __gone < __n")
    changed = F.coalesce(F.col("__kept"), F.col(text))
    fresh = {text: changed, n_chars: F.when(F.col("__kept").isNull(), F.col(n_chars)).otherwise(F.length("__kept")).cast(dict(docs.dtypes).get(n_chars, "long"))}
    return out.select(*(fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns))
