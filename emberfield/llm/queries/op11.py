"""WARC records of all pages: written, normalised to a member per record, and read back by the offset index."""

from pyspark.sql import DataFrame, SparkSession

from emberfield.llm import warc
from emberfield.llm.catalog import register
from emberfield.llm.common import Stages, table

SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
    SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p
), v AS (
    SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT)) AS fives FROM d
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(fives, lambda f: array_to_string(list_transform([32768, 1024, 32, 1], lambda p:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (f // p) % 32 AS BIGINT), 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM v
"""


@register("op11_warc", SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark)
    streams, archives = stages.folder("streams"), stages.folder("archives")
    warc.write_archives(table(spark, sf_dir, "pages"), streams)
    warc.normalise(spark, streams, archives, consume=True)
    stages.remove(streams)
    found = warc.read_archives(spark, archives, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
