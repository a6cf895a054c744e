"""Named queries of the text operators, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, divergence, licenses, mixing, neardup, quality, secrets, shards, sql, substrings, tokens, topk, toxicity, trie
from .common import table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def token_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the documents' token files and return what is read back from them."""
    place, index = tokens.write_tokens(docs, tokenizer_path(), END_ID)
    return tokens.read_tokens(spark, place, index)


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_report(spark, table(spark, folder, "documents"))


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(table(spark, folder, "documents"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document that holds benchmark passages."""
    found = decontamination.decontamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.where("contaminated")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(table(spark, folder, "documents"))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = shards.sharded(table(spark, folder, "documents"))
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op11_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_inner_products(table(spark, folder, "embeddings"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files, op2_near_duplicates, op3_quality, op4_toxicity, op5_licenses, op6_mixing,
        op7_decontamination, op8_secrets, op9_substrings, op10_shards, op11_top_products,
        op12_prefix_trie, op13_divergence,
    )
}

SQL: dict[str, str] = {
    "op3_quality": sql.quality_sql(),
    "op5_licenses": sql.licenses_sql(),
    "op6_mixing": sql.mixing_sql(),
    "op9_substrings": sql.substrings_sql(),
    "op11_top_products": sql.topk_sql(),
    "op12_prefix_trie": sql.trie_sql(),
    "op13_divergence": sql.divergence_sql(),
}
