"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import bpe, credentials, digest, edits, jaccard, maxent, mixing, pages, phrases, pii, rules, spelling, subwords
from rollbook.llm.tables import documents, table


#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_edits(documents(spark, sf_dir))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    note = F.concat_ws(" ", F.lit(""), "lang", "source")
    return edits.recounted(docs.withColumn("edits", edits.example_edits(docs["text"], note)), f"{TOKENIZERS}/byte_bpe_50k.json")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scored(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.classified(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(documents(spark, sf_dir), k=3, num=90, den=100)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scanned(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spellings(documents(spark, sf_dir))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_personal_data": op2_personal_data,
    "op3_bpe": op3_bpe,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_model": op6_language_model,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_source_mixing": op8_source_mixing,
    "op9_main_text": op9_main_text,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_secret_scan": op11_secret_scan,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE: dict[str, str] = {
    "op8_source_mixing": mixing.oracle_sql(),
    "op11_secret_scan": credentials.oracle_sql(),
    "op12_spelling_variants": spelling.oracle_sql(),
    "op13_phrase_collocations": phrases.oracle_sql(),
}
