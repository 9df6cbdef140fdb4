"""Query op8: exact deduplication of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchbook.llm.base import query, table
from matchbook.llm.exact import exact_dedup

SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text_sha256, doc_id) AS nth
      FROM t WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND nth = 1) AS kept, text_sha256 FROM g
"""


@query("op8_exact_dedup", SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
