"""Packing of all documents into sequences of at most 1024 tokens."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberfield.llm.catalog import register
from emberfield.llm.common import table
from emberfield.llm.packing import added_tokens, pack

#: The file of the contract, whose added tokens count, and the ranks of its vocabulary, which give the same ids otherwise.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = added_tokens(public_tokenizers.path(TOKENIZER))
    _, placed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), added=added)
    return placed
