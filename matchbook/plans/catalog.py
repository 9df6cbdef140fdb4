"""Every registered query, by importing the modules that define them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchbook.plans import (  # noqa: F401
    checking,
    compressing,
    deciding,
    evaluation,
    reranking,
    searching,
    splitting,
    storing,
    studies,
)
from matchbook.session import ship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return searching.open_set_search(spark, sf_dir)
