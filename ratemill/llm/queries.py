"""Queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratemill.llm import exact, langid, linkrank, mixing, near, pieces, secrets, suffix, tiff, tiff_write, toxicity
from ratemill.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give every source its tempered share of 90 % of all tokens."""
    return mixing.chosen(table(spark, sf_dir, "documents"), **mixing.PRODUCTION).select("doc_id", "source", "n_tokens", "n_rows")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 and more words that occur more than once."""
    return suffix.passages(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.filter_urls(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.model(docs))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so every embedding is first rendered as a TIFF of four pages; the decoder sees only the files."""
    return tiff.decode(tiff_write.of_embeddings(table(spark, sf_dir, "embeddings")), "vec_id", "tiff")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id of its group of near copies, and whether it stays."""
    return near.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "keep")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest doc_id that has its text, and whether it stays."""
    return exact.owners(table(spark, sf_dir, "documents")).select("doc_id", "owner_id", "keep")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.model(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.model(docs, table(spark, sf_dir, "labels")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_suffix_dedup, op3_url_filters, op4_language_id, op5_tiff, op6_near_dedup, op7_exact_dedup, op8_secret_scan, op9_toxicity, op10_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": """
            SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS owner_id,
                   text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS keep
            FROM documents""",
    }
