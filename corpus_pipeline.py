"""A corpus pipeline: quality, near duplicates, personal data, mixing, encoding."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from rollbook.llm import bpe, jaccard, mixing, pii, rules
from rollbook.llm.tables import documents, stage, table

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.passing(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redacted(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and forms have tempered shares."""
    return mixing.sampled(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with the digest of the text they decode to."""
    return bpe.encode(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("quality rules", good_documents),
    ("near duplicates", one_of_near_copies),
    ("personal data", without_personal_data),
    ("mixing", mixed_sources),
    ("encoding", token_ids),
]

#: Not expressible in SQL: the field, the n-gram model and the merges. Stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
