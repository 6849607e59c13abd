"""Token counts of documents in flat token files, by a separator scan.

A flat token file is a run of unsigned 16- or 32-bit ids in which every document ends with one identifier, with no index. It is read in
blocks of fixed size that know nothing of documents. In each block the end-of-document identifier is searched for in one vectorised comparison; a block
yields how many tokens stand before its first end, after its last, and between the ends inside. What a document left in earlier blocks is
stitched on by a prefix scan over the blocks of a file: the running count of ends numbers the documents, and the tails since the
last block with an end are summed up.

flat_blocks() writes documents as such files (blocks as rows of a table, cut without regard to documents; ids are hashed words, end
0), with the ids of the documents of each file in order, which the counts alone can't tell. scan() takes blocks from there, or from any
files by read_blocks().

Contract: null texts are empty documents of 0 tokens; tokens after a file's last end are reported under complete = false if there are
any; empty files have no documents. A token that an id of 2 bytes straddles is no case: blocks are whole ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import settled
from .hashing import U64
from .repeats import raw, word_symbols

END = 0
BLOCK_IDS = 1 << 18
FLAT = "file long, block long, body binary, docs array<long>"


def word_ids(words: np.ndarray) -> np.ndarray:
    """Ids 1 to 65,535 of hashed words."""
    return (words % U64(65535) + U64(1)).astype("<u2")


def flat_blocks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, block, body, docs): each partition is a file, cut into blocks of block_ids ids; docs: ids of the documents that end in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, size, number, file = [], [], 0, 0, None

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, owners, size, number
            ids = np.concatenate(held) if held else np.zeros(0, "<u2")
            at = 0
            while len(ids) - at >= block_ids or last and at < len(ids):
                part = ids[at : at + block_ids]
                ends = int((part == END).sum())
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([part.tobytes()], pa.binary()), pa.array([owners[:ends]], pa.list_(pa.int64()))], names=["file", "block", "body", "docs"])
                owners, number, at = owners[ends:], number + 1, at + block_ids
            held, size = [ids[at:]], max(0, len(ids) - at)

        for b in batches:
            for i, doc in enumerate(b.column(1).to_pylist()):
                file = b.column(0)[i].as_py() if file is None else file
                ids = word_ids(word_symbols(raw(b.column(2), i)))
                held += [ids, np.array([END], "<u2")]
                owners.append(doc)
                size += len(ids) + 1
                if size >= block_ids:
                    yield from cut(False)
        if file is not None:
            yield from cut(True)

    rows = docs.select(F.spark_partition_id().cast("long").alias("file"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, FLAT)


def read_blocks(spark: SparkSession, path: str, *, block_bytes: int = 4 << 20) -> DataFrame:
    """(file, block, body) of the flat files under a path, through Spark's own reader; file is the path. A file is one row there, of 2 GB at most; its
    blocks are cut out of it before they become rows, so that none carries the file."""
    if block_bytes % 4:
        raise ValueError("blocks must hold whole ids")
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "content")
    starts = F.sequence(F.lit(0), F.floor((F.length("content") - 1) / block_bytes).cast("int"))
    blocks = F.transform(starts, lambda k: F.substring(F.col("content"), k * block_bytes + 1, F.lit(block_bytes)))
    return files.select("file", F.posexplode(blocks).alias("block", "body")).withColumn("block", F.col("block").cast("long"))


def scanned(dtype: str, end: int):
    names = ["file", "block", "n_ends", "head", "tail", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for body in b.column(2):
                ids = np.frombuffer(body.as_buffer(), dtype) if body.is_valid else np.zeros(0, dtype)
                ends = np.flatnonzero(ids == end)
                if len(ends):
                    rows.append((len(ends), int(ends[0]), int(len(ids) - ends[-1] - 1), np.diff(ends) - 1))
                else:
                    rows.append((0, 0, len(ids), np.zeros(0, np.int64)))
            n, head, tail, inner = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(list(inner), pa.list_(pa.int64()))], names=names)

    return run


def scan(blocks: DataFrame, *, dtype: str = "<u2", end: int = END) -> DataFrame:
    """(file, ordinal, n_tokens, complete): the documents of each file in order. blocks: (file, block, body)."""
    kind = dict(blocks.dtypes)["file"]
    found = blocks.select("file", "block", "body").mapInArrow(scanned(dtype, end), f"file {kind}, block long, n_ends long, head long, tail long, inner array<long>")
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.sum("n_ends").over(order), F.lit(0)))
    # blocks that begin in one document have one number of ends before them
    since = Window.partitionBy("file", "before").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.lag(F.when(F.col("n_ends") > 0, F.col("tail"))).over(Window.partitionBy("file").orderBy("block"))
    # the tail of the block with the last end, and whole blocks since then
    found = found.withColumn("carried", F.coalesce(carried, F.lit(0)))
    opened = F.coalesce(F.first("carried").over(Window.partitionBy("file", "before").orderBy("block")), F.lit(0))
    passed = F.coalesce(F.sum(F.when(F.col("n_ends") == 0, F.col("tail"))).over(since), F.lit(0))
    found = found.withColumn("carry", F.when(F.col("before") > 0, opened).otherwise(0) + passed)
    last = Window.partitionBy("file").orderBy(F.desc("block"))
    ended = found.where("n_ends > 0").select("file", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("k", "n_tokens"), "before")
    done = ended.select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    rest = found.withColumn("turn", F.row_number().over(last)).where("turn = 1").select("file", (F.col("before") + F.col("n_ends")).alias("ordinal"), F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens"), F.lit(False).alias("complete"))
    return done.union(rest.where("n_tokens > 0"))


def document_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, n_tokens: documents written as flat token files, then counted by the scan alone and matched by order."""
    flat = settled(flat_blocks(docs, doc_id=doc_id, text=text, block_ids=block_ids))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = flat.select("file", "block", "docs").withColumn("before", F.coalesce(F.sum(F.size("docs")).over(order), F.lit(0)))
    names = names.select("file", "before", F.posexplode("docs").alias("k", "doc_id")).select("file", (F.col("before") + F.col("k")).cast("long").alias("ordinal"), "doc_id")
    return names.join(scan(flat), ["file", "ordinal"]).select("doc_id", "n_tokens")
