"""The documents table, cleaned and packed: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.llm import credentials, exact, language, packing, simhash
from pairsieve.llm.queries import BYTES, documents
from pairsieve.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-centroid model, fitted on the labelled ones, accepts.

    NULL, empty and letterless texts go; repeated rows share their fate.
    """
    return language.keep_accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (up to A-Z case) the one with the largest id.

    NULL and empty texts are equal; a NULL id is the smallest; of rows that repeat id and text one stays.
    """
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints (3-word shingles) link within 3 bits the one with the smallest id.

    NULL and empty texts have fingerprint zero and link like others; a NULL id comes last; of rows that repeat id and text one stays.
    """
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a marker and ``n_chars`` that of the new text; a NULL text keeps its ``n_chars``."""
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return credentials.redact(docs).withColumn("n_chars", length)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 tokens; NULL and empty texts give the end id, repeated rows a piece each."""
    return packing.pack(docs, BYTES)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: SQL can express neither the model nor the fingerprints nor the tokens; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
