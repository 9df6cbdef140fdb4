"""Query op3: the language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm import langid
from matchbook.llm.base import crc_mod, query, table


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = crc_mod(F.col("doc_id"), 5) == 0
    net = langid.train(docs, ~held)
    return langid.identify(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")
