"""Query op12: token counts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchbook.llm.base import query, table
from matchbook.llm.op9 import vocabulary
from matchbook.llm.tokencount import token_counts

VOCABULARY = "byte_bpe_50k.json"


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and whether there are more than 512, of every whole text."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))
