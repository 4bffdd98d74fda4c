"""Quality scores of all documents."""

from pyspark.sql import DataFrame, SparkSession

from emberfield.llm.catalog import register
from emberfield.llm.classifier import score_documents
from emberfield.llm.common import table


@register("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
