"""Query op5: all documents mixed to the target weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchbook.llm.base import query, table
from matchbook.llm.mixing import mix_sizes


@query("op5_source_mixing")
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
