"""Secrets in all documents."""

from pyspark.sql import DataFrame, SparkSession

from emberfield.llm.catalog import register
from emberfield.llm.common import table
from emberfield.llm.secrets import scan


@register("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
