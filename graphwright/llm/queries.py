"""The queries of the operators in this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, lm_score, minhash_dedup, mixing, quality_rules, substring_dedup, suffix_dedup, token_counts, url_filter

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"), digest=True)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(table(spark, sf_dir, "documents"), digest=True)


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=["doc_id"])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_array_dedup, op2_embedding_near_dedup, op3_quality_rules, op4_minhash_near_dedup, op5_substring_dedup, op6_byte_level_bpe, op7_source_mixing, op8_lm_scoring, op9_token_counts, op10_url_filter, pipeline)
    return {f.__name__: f for f in found}


OP9_SQL = r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
FROM documents
"""


OP2_SQL = """
WITH RECURSIVE p AS (
  SELECT a.vec_id i, b.vec_id j FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
reach AS (SELECT vec_id i, vec_id c FROM embeddings UNION SELECT p.j, reach.c FROM reach JOIN p ON p.i = reach.i),
root AS (SELECT i, min(c) c FROM reach GROUP BY i),
n AS (SELECT i, count(*) n FROM p GROUP BY i)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(c AS BIGINT) AS component_id, vec_id = c AS kept
FROM embeddings JOIN root ON root.i = vec_id LEFT JOIN n ON n.i = vec_id
"""

#: Windows of k symbols that start in an earlier document, merged into spans (doc_id, s, e) of starts and ends.
_SPANS = """
f AS (SELECT k, min(doc_id) m FROM win GROUP BY k),
hit AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50 gap FROM win JOIN f USING (k) WHERE doc_id > m),
isle AS (SELECT doc_id, p, count(*) FILTER (gap) OVER (PARTITION BY doc_id ORDER BY p) g FROM hit),
span AS (SELECT doc_id, min(p) s, max(p) + 50 e FROM isle GROUP BY doc_id, g)
"""

OP1_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) k FROM t, range(0, n - 49) r(p)),
{_SPANS},
ends AS (SELECT doc_id, s, e FROM span UNION ALL SELECT doc_id, n, n FROM t),
cut AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 0) b FROM ends),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) h FROM cut JOIN t USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - s) removed, count(*) spans FROM span GROUP BY doc_id)
SELECT t.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

OP5_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 50], ' ') k FROM t, range(0, len(w) - 49) r(p)),
{_SPANS},
gone AS (SELECT doc_id, i FROM span, range(s, e) r(i)),
each AS (SELECT doc_id, i, w[i + 1] x FROM t, range(0, len(w)) r(i)),
left_ AS (SELECT * FROM each ANTI JOIN gone USING (doc_id, i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) k, count(*) n FROM left_ GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": OP1_SQL, "op2_embedding_near_dedup": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op9_token_counts": OP9_SQL}
