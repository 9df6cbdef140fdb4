"""Paired resampling over identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions.text import seeded_order
from matchbook.operators import ranks


def paired_drop(deltas: DataFrame, repeats: int, seed: int = 0) -> DataFrame:
    """Mean of ``delta`` with a 95 % interval from resampled identities.

    ``deltas`` has ``vehicle_id`` and ``delta``, one row per query. Each repeat draws as
    many identities as there are, with replacement; only identity totals are resampled,
    so a frequent identity is one row.
    """
    totals = deltas.groupBy("vehicle_id").agg(F.sum("delta").alias("s"), F.count(F.lit(1)).alias("c"))
    ids = ranks.running(totals, "vehicle_id", "vehicle_id").withColumn("slot", F.col("rank") - 1)
    draws = ids.select("slot", "total").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).select(
        "b", (seeded_order(seed, F.col("b"), F.col("slot")) % F.col("total")).alias("slot"))
    means = (
        draws.groupBy("b", "slot").agg(F.count(F.lit(1)).alias("m"))
        .join(ids.select("slot", "s", "c"), "slot")
        .groupBy("b").agg((F.sum(F.col("m") * F.col("s")) / F.sum(F.col("m") * F.col("c"))).alias("v"))
    )
    ci = ranks.quantiles(means, "v", {"ci_low": 0.025, "ci_high": 0.975}).drop("n")
    whole = deltas.agg(
        F.avg("delta").alias("mean_drop"), F.count(F.lit(1)).alias("n_queries"),
        F.countDistinct("vehicle_id").alias("n_identities"))
    both = whole.unionByName(ci, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
