"""The training-data pipeline: documents to packed sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept; all but the last give the columns of
``documents``. Null and empty texts are judged like others (the quality rules drop them), rows with null or repeated ids
are rows of their own except that near-duplicates leave one row of each group, and extra columns pass through. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberfield.llm import classifier, packing, pii, quality_rules, simhash
from emberfield.llm.common import Stages, table

#: The tokenizer, whose added tokens count, and the ranks of its vocabulary.
PACKING_TOKENIZER, PACKING_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of two thirds of the ids, scores 0.5 or better."""
    return classifier.passing(docs, table(spark, sf_dir, "labels"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the compression bands reject."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by tags."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in sequences of at most 1024 tokens."""
    added = packing.added_tokens(public_tokenizers.path(PACKING_TOKENIZER))
    return packing.pack(docs, public_tokenizers.path(PACKING_RANKS), added=added)[1]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_filter),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack_sequences),
]

#: The classifier is fitted and the ids come from a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stages = table(spark, sf_dir, "documents"), Stages(spark)
    for name, stage in STAGES[:-1]:
        kept = stages.write(stage(spark, docs, sf_dir))
        stages.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
