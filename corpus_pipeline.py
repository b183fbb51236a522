"""Corpus pipeline: documents -> clean, distinct, uncontaminated texts -> token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns the documents it keeps, with the columns of ``docs``; the last returns
the ids' digests.  ``run`` writes each stage's result to the shared checkpoint
folder and reads it back as the next stage's input, so the loss of an executor
never repeats an earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from revmine.llm import byte_bpe, near_dup, phrase_index, quality_rank, rule_ledger
from revmine.llm.common import learnable, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry score accepts."""
    return quality_rank.accept(docs, quality_rank.fit(docs, table(spark, sf_dir, "labels"), train=learnable()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy."""
    return rule_ledger.accept(docs, rule_ledger.PRODUCTION)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return near_dup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too much benchmark text."""
    return phrase_index.decontaminate(docs, table(spark, sf_dir, "benchmark"), nulls_apart=True)


def byte_bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that is left."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(docs, path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe_ids),
]

#: a fitted classifier cannot be stated in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out
