"""The operators bound to the given tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from portolan.llm import bpe, conversations, decontaminate, exact, mixing, passages, pii, secrets, simhash, suffixes, toxicity, urls, variants

#: The ranks that op2 and the pipeline encode with.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(table(spark, folder, "documents"))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest(table(spark, folder, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op3_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"), every_hash=True)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_shared_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.shared_passages(table(spark, folder, "documents"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digest(table(spark, folder, "documents"))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.digest(table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.digest(table(spark, folder, "documents"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.digest(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_byte_bpe,
        op3_simhash_dedup,
        op4_exact_dedup,
        op5_decontamination,
        op6_shared_passages,
        op7_url_filter,
        op8_suffix_dedup,
        op9_personal_data,
        op10_toxicity,
        op11_source_mix,
        op12_spelling_variants,
        op13_conversation_trie,
    )
}
ORACLES: dict[str, str] = {
    "op1_secret_scan": secrets.ORACLE,
    "op4_exact_dedup": exact.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op7_url_filter": urls.ORACLE,
    "op8_suffix_dedup": suffixes.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
    "op13_conversation_trie": conversations.ORACLE,
}
