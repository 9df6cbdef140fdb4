"""The observation model and its mapping from the ``embeddings`` table.

An observation is one boxed sighting: an ordinal (the tie-breaking order), a key
whose prefix names the frame, an identity, a camera, a box and a vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.functions.text import frame_of

#: Identities that never appear in the gallery, which makes the search open-set.
HELD_OUT = (8, 9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    key = F.concat(F.lit("f"), F.expr("vec_id div 2").cast("string"), F.lit("#"), (v % 2).cast("string"))
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            v.alias("ord"),
            key.alias("key"),
            F.col("label").cast("long").alias("vehicle_id"),
            (v % 4 + 1).cast("int").alias("camera_id"),
            ((v * 37) % 900).cast("double").alias("x"),
            ((v * 53) % 500).cast("double").alias("y"),
            (180 + (v * 17) % 400).cast("double").alias("w"),
            (140 + (v * 29) % 300).cast("double").alias("h"),
            F.col("embedding").alias("emb"),
        )
        .withColumn("frame", frame_of(F.col("key")))
    )


def query_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).filter(F.col("ord") % 5 == 0)


def gallery_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).filter((F.col("ord") % 5 != 0) & ~F.col("vehicle_id").isin(*HELD_OUT))


def second_space(df: DataFrame) -> DataFrame:
    """A second embedding space of the same observations: dimensions 33 to 64."""
    return df.withColumn("emb", F.slice("emb", 33, 32))
