"""Second-stage scoring of a shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rescore(short: DataFrame, alpha: float | Column, base: str = "score", heavy: str = "heavy") -> DataFrame:
    """Blend two scores inside a shortlist; both are brought to [0, 1] within the query.

    The new score lies above the lowest base score of the shortlist, so everything
    below the shortlist keeps its order. ``alpha`` must be in [0, 1].
    """
    if not isinstance(alpha, Column):
        if not 0.0 <= alpha <= 1.0:
            raise ValueError("alpha must lie in [0, 1]")
        alpha = F.lit(float(alpha))
    w = Window.partitionBy("q_ord")

    def to_unit(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return (F.col(c) - lo) / F.greatest(hi - lo, F.lit(1e-9))

    mixed = alpha * to_unit(heavy) + (1.0 - alpha) * to_unit(base)
    order = Window.partitionBy("q_ord").orderBy(F.desc("rescored"), F.asc("g_ord"))
    return short.withColumn("rescored", F.min(base).over(w) + 1.0 + mixed).withColumn(
        "pos", F.row_number().over(order)
    )


def margin_of(short: DataFrame, sim: str = "sim") -> DataFrame:
    """Cosine gap between the first and second emitted candidate: ``q_ord, margin``."""
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col(sim)))
    return short.filter(F.col("pos") <= 2).groupBy("q_ord").agg((at(1) - at(2)).alias("margin"))
