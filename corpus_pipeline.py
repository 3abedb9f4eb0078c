"""The corpus pipeline: documents through five stages, each written as Parquet before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of ``documents``.

1. quality rules: documents that the base rules or the isolation forest reject go;
2. n-gram Jaccard join: of each group of near duplicates the smallest doc_id stays, by five-word shingles at 0.8;
3. suffix-array dedup: bytes of 50-byte strings that an earlier document has are cut out of the texts, by whole characters;
4. mixing: texts are repeated (up to three times), cut or left out so that the sources come near their targets;
5. packing: the pieces of all texts in sequences of 1024 tokens, with their token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableward.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from tableward.session import keep

#: Word shingles and percent of similarity of the stage for near duplicates.
SHINGLE_WORDS = 5
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, words=SHINGLE_WORDS, percent=PERCENT)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", mixing_sources),
    ("packing", pack),
]

#: No SQL: the forest and the tokenizer can't be expressed; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
