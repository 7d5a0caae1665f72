"""The queries of the text operators, each over its whole table, with production parameters.

SQL stands only where DuckDB can express a query over whole tables; the others are tested by brute force.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, html_text, lm_score, near_dup, pii, quality, secret_scan, token_counts
from .common import spans_text, table

def tokenizer(name: str) -> str:
    """A public tokenizer's file, read at run time and never copied; TICKLAKE_TOKENIZERS may name another folder."""
    if folder := os.environ.get("TICKLAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _span_report(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts by kind, the digest of the spans of these kinds, and all spans as text."""
    of_kinds = lambda *some: F.filter("spans", lambda s: s["kind"].isin(*some))
    own = of_kinds(*kinds)
    counts = [F.size(of_kinds(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(spans_text(own).cast("binary"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of equal and similar documents (three words, 0.85); see near_duplicates() for nulls, repeats and empty texts."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text; a null or empty text has none, its base_sha256 is that of no bytes."""
    return _span_report(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.KINDS)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th; see nearest() for vectors that take no part, ties and repeats."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text by counts of the training part; a null or empty text is its end alone; a null id is held out."""
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to; a null or empty text has none, and the digests of no bytes."""
    out = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", bpe.n_tokens("token_ids").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; a null or empty one has the score of zero statistics; a null id is held out."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text; a null or empty text has none, its base_sha256 is that of no bytes."""
    return _span_report(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.KINDS)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text; a null or empty one has none."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; a null or empty page has the text ''."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, exact or edited; null and empty texts hold none."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_near_dup, op2_secrets, op3_ann, op4_lm_score, op5_bpe, op6_quality, op7_pii, op8_token_counts, op9_html_text, op10_decontaminate)}
ORACLES: dict[str, str] = {}
