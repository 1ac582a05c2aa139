"""From raw documents to packed sequences: toxicity, exact copies, near copies, source mix, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from headway.llm import exact_dedup, mixture, near_dedup, packing, toxicity
from headway.llm.common import stored, table
from headway.session import scratch

TOKENIZER = "word_bpe_49k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model rejects."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text."""
    path = scratch(spark, "digest-index")
    index = exact_dedup.DigestIndex(spark, "digests_" + path[-32:], path).open()
    kept = exact_dedup.kept_rows(docs, index.ingest(docs))
    index.close()
    return kept


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, similarity 0.8)."""
    return near_dedup.kept_rows(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources get their target weights."""
    return mixture.mixed_rows(docs, mixture.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in the packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("source_mix", mixture_stage),
    ("best_fit_packing", packing_stage),
]

#: Near duplicates, learned scores and tokens can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again by the next.

    Null texts count as empty and are packed as one token, if the mix takes them; null sources are a
    source of their own. A row is known by id and text: rows that repeat both, or differ in id only,
    are left once; an id that occurs with several texts keeps those that nothing else resembles, and
    rows without an id are exact but never near copies. Ties go to the larger id among exact and to
    the smaller one among near copies. An empty table gives no rows. Further columns are carried up to
    the packing stage, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
