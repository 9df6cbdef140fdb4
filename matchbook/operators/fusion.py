"""Combining rankings and score columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_list(top: DataFrame, out: str) -> DataFrame:
    """Each query's short ranking as an array of gallery ordinals."""
    return (
        top.groupBy("q_ord")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "g_ord"))).alias("_l"))
        .select("q_ord", F.col("_l.g_ord").alias(out))
    )


def merge_keeping_prefix(a: Column, b: Column, prefix: int) -> Column:
    """The first ``prefix`` of ``a``, then ``b`` without repeats, then the rest of ``a``; same length as ``a``."""
    head = F.slice(a, 1, prefix)
    return F.slice(F.concat(head, F.array_except(b, head), F.array_except(F.array_except(a, head), b)), F.lit(1), F.size(a))


def top_regions(df: DataFrame, grid: str, width: int, count: int) -> DataFrame:
    """Cells of a row-major grid that stand out most above the grid's mean."""
    cells = df.select("ord", F.posexplode(grid).alias("cell", "v"), grid)
    mean = F.aggregate(grid, F.lit(0.0), lambda acc, x: acc + x) / F.size(grid)
    w = Window.partitionBy("ord").orderBy(F.desc("contribution"), F.asc("cell"))
    return (
        cells.withColumn("contribution", F.col("v") - mean)
        .withColumn("_pos", F.row_number().over(w))
        .filter(F.col("_pos") <= count)
        .withColumn("row_index", F.expr(f"cell div {width}"))
        .withColumn("col_index", (F.col("cell") % width).cast("long"))
        .withColumn("cell", F.col("cell").cast("long"))
    )
