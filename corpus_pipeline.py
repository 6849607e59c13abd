"""Corpus pipeline: quality rules, near-dedup, substring dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphwright.llm import bpe, minhash_dedup, mixing, quality_rules, substring_dedup
from graphwright.llm.components import shared_folder
from graphwright.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays; equal rows of one id and text stay once, null ids aren't compared."""
    kept = minhash_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    stay = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return stay.unionByName(docs.where("doc_id is null"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; n_chars is counted anew. Documents left without words go."""
    return substring_dedup.trimmed(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's budget reads it, once at least."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and the digest of the decoded bytes."""
    return bpe.encode_verified(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring", substring), ("mixture", mixture), ("tokens", tokens)]

#: Hash orders and signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = shared_folder(spark)
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
