"""One query for each operator, over its whole table with production parameters, and its SQL where SQL can tell the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat, decontaminate, mixing, ngram_join, quality, row_patterns, sharding, substring_dedup, superminhash, token_counts, toxicity, url_filters, vector_codes
from factloom.llm.common import shared_folder, table
from factloom.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), said)
    return chat.digest(chat.format_trees(chat.thread(rows.union(planted))))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, touched = sharding.resharded(table(spark, sf_dir, "documents"), carry=("text", "lang", "source", "n_chars"))
    written = sharding.rewritten(placed, touched, f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")
    return written.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_patterns.digest(row_patterns.row_patterns(table(spark, sf_dir, "clicks")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_url_filters, op3_benchmark_decontamination, op4_mix_sources, op5_chat_formatting, op6_substring_dedup, op7_sharding, op8_toxicity, op9_quality_rules, op10_token_counts, op11_row_patterns, op12_vector_codes, op13_superminhash)}
