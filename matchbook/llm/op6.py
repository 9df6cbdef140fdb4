"""Query op6: quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm import quality
from matchbook.llm.base import crc_mod, query, table


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
