"""Queries opN_<name> of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from revmine.llm import (
    byte_bpe, chat_examples, importance, license_scan, near_dup, oracles, phrase_index, quality_rank, rule_ledger, secret_links, token_files, toxicity,
    url_digests, whitening)
from revmine.llm.common import learnable, stored, table

#: entry, verdict
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: hosts on the block list, with all their pages
BLOCKED_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com"]

#: words in which all distinct words of a benchmark item count as near
NEAR_SPAN = 100

PROBE_TEXT = "\\### Assistant: </turn> ok"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return token_files.read_token_files(files)


def op2_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rank.fit(docs, table(spark, sf_dir, "labels"), train=learnable())
    return quality_rank.score(docs, model).select(
        F.col("id").alias("doc_id"), (~learnable("id")).alias("held_out"), "score",
        (F.col("score") >= quality_rank.THRESHOLD_SCORE).cast("int").alias("predicted"))


def op3_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(rule_ledger.ledger(table(spark, sf_dir, "documents")), "ledger")
    return rule_ledger.verdicts(rows, rule_ledger.PRODUCTION).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = phrase_index.build_index(table(spark, sf_dir, "documents"))
    return phrase_index.verdicts(index, phrase_index.phrase_matches(index, table(spark, sf_dir, "benchmark")))


def op4_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = phrase_index.build_index(table(spark, sf_dir, "documents"))
    return phrase_index.proximity_counts(index, phrase_index.proximity_matches(index, table(spark, sf_dir, "benchmark"), span=NEAR_SPAN))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return chat_examples.digests(chat_examples.format_chats(turns.unionByName(probe)))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"),
        F.array_join(F.col("windows").cast("array<string>"), ",").alias("first_windows"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=learnable())
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"), (~learnable("id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_digests.judge(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS).withColumnRenamed("id", "page_id")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.digests(secret_links.spans(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_quality_rank, op3_rule_ledger, op4_phrase_index, op4_proximity, op5_near_dup, op6_chat_examples,
    op7_license_scan, op8_byte_bpe, op9_toxicity, op10_url_digests, op11_importance_resample, op12_secret_links, op13_whitening)}

ORACLES = {
    "op3_rule_ledger": oracles.OP3, "op4_phrase_index": oracles.OP4, "op4_proximity": oracles.op4_proximity(NEAR_SPAN), "op5_near_dup": oracles.OP5,
    "op6_chat_examples": oracles.op6(PROBE_TEXT), "op7_license_scan": oracles.op7(license_scan.TEMPLATES),
    "op10_url_digests": oracles.op10(URL_RULES, BLOCKED_HOSTS),
    "op11_importance_resample": oracles.op11(importance.N_BUCKETS),
    "op12_secret_links": oracles.op12(secret_links),
}
