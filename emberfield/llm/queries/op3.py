"""Language-model scores of all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberfield.llm.catalog import register
from emberfield.llm.common import table
from emberfield.llm.lm import score_documents


@register("op3_lm_score")
def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
