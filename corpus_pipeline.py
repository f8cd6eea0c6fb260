"""The corpus pipeline: stages that each turn a documents table into the next.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.llm import decontaminate, lines, minhash, packing, toxicity
from amberline.llm.registry import vocabulary
from amberline.llm.scratch import Scratch

TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; the model learns from the labelled ones that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out(), Scratch(spark, "stage-toxicity"))
    scored = toxicity.add_score(docs, model, "_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat or nearly repeat an earlier one; n_chars follows."""
    out = lines.line_dedup(docs, Scratch(spark, "stage-lines"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    judged = minhash.near_duplicates(docs, Scratch(spark, "stage-minhash"), words=5, percent=80)
    return docs.join(judged.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, Scratch(spark, "stage-packing"), vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_documents),
    ("best_fit_packing", pack_documents),
]

#: SQL cannot express tokenising, packing or the trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to packed pieces."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
