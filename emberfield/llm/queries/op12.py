"""Alignment of a byte-level and a piece tokenizer over all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberfield.llm.alignment import align_documents
from emberfield.llm.catalog import register
from emberfield.llm.common import table

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)
    found, _ = align_documents(table(spark, sf_dir, "documents"), paths)
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"
    )
