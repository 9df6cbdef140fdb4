"""Query op10: repeated passages of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchbook.llm.base import query, table
from matchbook.llm.substrings import remove_repeats


@query("op10_repeated_passages")
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
