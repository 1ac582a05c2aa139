"""Registered queries of this subpackage, with the SQL of those that SQL can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import conversations, exact_dedup, langid, lm_trie, mixture, near_dedup, packing, quality, sharding, simhash, topk, toxicity, vector_codes
from headway.llm.common import crc_of_id, table
from headway.session import scratch


def op1_lm_trie(spark: SparkSession, folder: str) -> DataFrame:
    held = "coalesce(crc32(cast(doc_id as string)), 0) % 7 = 2"
    out = lm_trie.score(table(spark, folder, "documents"), f"NOT ({held})")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "digest-index")
    index = exact_dedup.DigestIndex(spark, "digests_" + path[-32:], path).open()
    out = index.ingest(table(spark, folder, "documents"))
    index.close()
    return out


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    out = mixture.mix(table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = langid.identify(docs, langid.train(docs))
    return out.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = quality.score(docs, quality.train(docs, table(spark, folder, "labels")))
    return out.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted")


def op8_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.top_k(rows, rows.filter("vec_id % 100 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))
    return out.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", "predicted", "passages")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(vector_codes.vectors_of(table(spark, folder, "embeddings")))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


QUERIES = {
    "op1_lm_trie": op1_lm_trie,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_top_k": op8_top_k,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_simhash": op13_simhash,
}

ORACLES = {
    "op2_exact_dedup": OP2_SQL,
    "op3_source_mix": mixture.ORACLE,
    "op8_top_k": OP8_SQL,
    "op12_vector_codes": vector_codes.ORACLE,
}
