"""Operation-log summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.operators.ranks import quantile_rows


def summarise(log: DataFrame, width: str = "1 day") -> DataFrame:
    """Per window and phase: operations, error rate, exact median and 95th percentile of duration."""
    rows = log.select(F.window("ts", width)["start"].alias("start"), "phase", "duration_ms", "failed")
    base = rows.groupBy("start", "phase").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("failed").cast("int").cast("double")).alias("error_rate"))
    q = quantile_rows(rows, "duration_ms", [0.5, 0.95], ["start", "phase"])
    wide = q.groupBy("start", "phase").agg(F.max(F.when(F.col("p") < 0.9, F.col("x"))).alias("p50"), F.max(F.when(F.col("p") > 0.9, F.col("x"))).alias("p95"))
    return base.join(wide, ["start", "phase"])


def summarise_stream(log: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """The streaming form: late rows are dropped past the watermark, percentiles are sketched."""
    return (
        log.withWatermark("ts", lateness).groupBy(F.window("ts", width), "phase")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("failed").cast("int").cast("double")).alias("error_rate"),
             F.percentile_approx("duration_ms", 0.5, 10000).alias("p50"), F.percentile_approx("duration_ms", 0.95, 10000).alias("p95"))
        .select(F.col("window.start").alias("start"), "phase", "n", "error_rate", "p50", "p95")
    )
