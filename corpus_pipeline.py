"""The corpus pipeline: its stages, each one of the text operators, applied in order to the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm import bpe, decontaminate, near_dup, pii, quality
from ticklake.llm.common import discard, materialize, table
from ticklake.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays."""
    return near_dup.drop_near_duplicates(docs, k=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, exact or edited, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows the new text."""
    return pii.mask_personal_data(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.lit(0)).cast("long")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with its size in tokens and whether decoding gives the text back."""
    out = bpe.bpe_round_trip(docs, tokenizer("byte_bpe_50k.json"), keep=("lang", "source", "n_chars"), with_text=False)
    return out.select("doc_id", "lang", "source", "n_chars", bpe.n_tokens("token_ids").alias("n_tokens"), "token_ids", F.col("same").alias("round_trip"))


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("decontaminate", decontaminate_stage), ("pii", pii_stage), ("bpe", bpe_stage)]

#: Its stages learn models and align texts, which SQL can't express; tests hold each stage's operator against brute force,
#: and run() against the stages' rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written before the next one reads them, and go after that."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            out = materialize(out, f"stage-{name}")
            discard(docs)
        docs = out
    return docs
