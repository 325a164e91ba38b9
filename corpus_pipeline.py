"""A corpus pipeline: five stages, each a function of (spark, docs, sf_dir) that gives the next one's docs.

Every stage works on all rows that its predecessor kept, and is written as Parquet and read again between stages.
All but the last return the columns of documents, and further ones of docs, whatever their names.

Defined results: each stage treats NULLs, empty and very long texts, ties, repeated rows and empty tables as its operator says:
rows with NULL text are not toxic, no copies of anything, cost no tokens, and are encoded as NULL; empty texts are one
another's copies; of equals the smallest doc_id stays.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ratemill.llm import exact, mixing, near, pieces, toxicity
from ratemill.llm.common import table
from ratemill.session import remove, shared_folder, ship


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it is fitted on all labelled rows of the whole table.
    NULL texts and, where nothing is labelled, all texts stay."""
    net = toxicity.model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, net)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest doc_id, NULL last; all with NULL text."""
    return exact.dedup(docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, NULL last; all with NULL text."""
    return near.dedup(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 90 % of all tokens, of which every source has its tempered share; NULL is a source, too. Documents without tokens
    stay, repeated rows stay or go together."""
    return mixing.mix(docs, **mixing.PRODUCTION)


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces and round_trip of each document; NULL for NULL text, no pieces for an empty one."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact),
    ("near_dedup", stage_near),
    ("mixing", stage_mixing),
    ("sentencepiece", stage_pieces),
]

#: No stage but the second can be put in SQL: they hold a trained model, seeded sketches and a foreign vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    ship(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(remove, spark, folder)
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        last = name
    return docs
