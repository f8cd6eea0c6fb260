"""The queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm import decontaminate, embeddings, lines, minhash, packing, substring, suffix, tokencount, toolcalls, toxicity
from amberline.llm.scratch import Scratch
from amberline.llm.sql import SQL


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels, Scratch(spark, "op7"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return minhash.near_duplicates(docs, Scratch(spark, "op8"), words=2, percent=80)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op1"), 0.9)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, Scratch(spark, "op2"), vocabulary("word_bpe_49k.json"))


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return toolcalls.link(calls, results, toolcalls.REPLY, Scratch(spark, "op3"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, items).drop("spans", "items")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = lines.line_dedup(docs, Scratch(spark, "op5"))
    return out.select("doc_id", "n_lines", F.col("n_lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring.substring_dedup(docs, Scratch(spark, "op6"), texts=False).drop("kept")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix.suffix_dedup(docs, Scratch(spark, "op9"), kept=False).drop("kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokencount.token_counts(docs, tokencount.unigram_vocabulary(vocabulary("piece_bpe_32k.model")))


_QUERIES = [op1_embedding_near_dedup, op2_best_fit_packing, op3_tool_call_linking, op4_benchmark_decontamination, op5_line_dedup, op6_substring_dedup, op7_toxicity, op8_minhash_near_dedup, op9_suffix_array_dedup, op10_token_counts]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
