"""The ten best documents of every benchmark item."""

from pyspark.sql import DataFrame, SparkSession

from emberfield.llm.catalog import register
from emberfield.llm.common import table
from emberfield.llm.ranked import rank_documents

SQL = r"""
WITH lowered AS (
    SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (
    SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
), whole AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM lengths
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, whole GROUP BY term, docs
), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l)))) AS BIGINT) AS score
    FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@register("op13_ranked_search", SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
