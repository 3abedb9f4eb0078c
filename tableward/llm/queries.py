"""The numbered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableward.llm import fingerprints, hard_negatives, jaccard_join, merkle, minhash, mixing, packing, quality, sharding, substring_dedup, suffix_dedup, token_counts, tool_calls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    return token_counts.count_sections(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that repeat a smaller doc_id, over 50-byte strings."""
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 4-word shingles at 85 %."""
    return jaccard_join.digest(_table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of each conversation, tool calls and results linked, ordered, validated and as canonical JSON."""
    return tool_calls.formatted(_table(spark, sf_dir, "conversations"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and how alike they are."""
    return fingerprints.digest(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that repeat a smaller doc_id, over windows of 50 words."""
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of each document and whether it stays."""
    judged = quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return sharding.digest(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives just below the positives of every hundredth vector."""
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 5-word shingles at 85 %, and which documents stay."""
    return minhash.digest(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in a hash tree over all sources, and whether a changed text is found out."""
    return merkle.audited(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_suffix_array_dedup,
        op3_ngram_jaccard_join,
        op4_chat_formatting,
        op5_document_fingerprints,
        op6_substring_dedup,
        op7_quality_rules,
        op8_packing,
        op9_mixing,
        op10_sharding,
        op11_hard_negatives,
        op12_minhash_dedup,
        op13_merkle_manifest,
    )
}
