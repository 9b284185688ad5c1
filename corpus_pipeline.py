"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it kept or changed of docs, with the columns
of ``documents``; the last returns the mix's manifest (which documents to read, and how many times).
Between stages the documents are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, language_id, mixing, pii, simhash
from lattica.llm.common import Written, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or with a score below 0.5 go."""
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the mix: chosen documents and how many times each is used."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", deduplicate),
    ("decontaminate", decontaminated),
    ("pii", redacted),
    ("source_mixing", mixed),
]

#: SQL has no trained networks, fingerprints or checksums; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir), name).read()
    return STAGES[-1][1](spark, docs, sf_dir)
