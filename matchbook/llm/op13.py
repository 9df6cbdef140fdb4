"""Query op13: spelling variants of the words of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchbook.llm.base import query, table
from matchbook.llm.spelling import spelling_variants


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its near words counted, its form and its root."""
    return spelling_variants(table(spark, sf_dir, "documents"))
