"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import languages, licenses, line_rules, packing, parsing, pieces, privacy, quality, secrets, simhash
from quire.llm.common import documents, table


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexadecimal(F.col("f0")).alias("fingerprint"), "component_id")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(documents(spark, sf_dir, "doc_id", "text", "source"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return languages.identify(docs, languages.train(docs))


def op9_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.scan(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.with_edits(documents(spark, sf_dir))


QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_packing": op2_packing,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_languages": op6_languages,
    "op7_secrets": op7_secrets,
    "op8_fingerprints": op8_fingerprints,
    "op9_privacy": op9_privacy,
    "op10_quality": op10_quality,
}
SQL: dict[str, str] = {"op1_line_frequency": line_rules.SQL, "op4_licenses": licenses.SQL, "op9_privacy": privacy.SQL}
