"""Registered queries of the text operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumidex.llm import ann, bpe, chat, chatrepair, ibf, langid, licenses, linededup, mixing, sharding, simhash, urlfilter, veccodes
from lumidex.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_report(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibf.version_report(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbour_report(table(spark, sf_dir, "embeddings"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatrepair.repair_report(table(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.code_report(table(spark, sf_dir, "embeddings"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_report(table(spark, sf_dir, "pages"))


QUERIES = [op1_licenses, op2_sharding, op3_line_dedup, op4_byte_bpe, op5_mixing, op6_chat, op7_simhash, op8_language, op9_fingerprints, op10_neighbours, op11_repair, op12_vector_codes, op13_url_filter]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licenses": licenses.license_sql(),
        "op3_line_dedup": linededup.line_sql(),
        "op5_mixing": mixing.mixing_sql(),
        "op6_chat": chat.chat_sql(),
        "op12_vector_codes": veccodes.code_sql(),
        "op13_url_filter": urlfilter.url_sql(),
    }
