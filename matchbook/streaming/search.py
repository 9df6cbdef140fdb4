"""A stream of queries against a fixed gallery snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.operators.refusal import accepts
from matchbook.operators.similarity import Plan, nearest
from matchbook.session import ship


def search_batch(queries: DataFrame, gallery: DataFrame, k: int, threshold: float, min_eligible: int = 10, plan: Plan = Plan()) -> DataFrame:
    """Ranked candidates with the decision; a query with too few eligible rows gives one error row."""
    top = nearest(queries, gallery, max(k, min_eligible), plan, q_carry=["key"], g_carry=["key"])
    per = Window.partitionBy("q_ord")
    rows = top.withColumn("_n", F.count(F.lit(1)).over(per)).withColumn("_best", F.max("sim").over(per))
    good = rows.filter((F.col("_n") >= min_eligible) & (F.col("pos") <= k)).select(
        "q_ord", "q_key", "pos", "g_key", "sim", accepts(F.col("_best"), threshold).alias("accepted"), F.lit(None).cast("string").alias("error"))
    ok = rows.filter(F.col("_n") >= min_eligible).select(F.col("q_ord").alias("ord")).distinct()
    bad = queries.join(ok, "ord", "left_anti").select(
        F.col("ord").alias("q_ord"), F.col("key").alias("q_key"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("g_key"),
        F.lit(None).cast("double").alias("sim"), F.lit(False).alias("accepted"), F.lit("too few eligible gallery rows").alias("error"))
    return good.unionByName(bad)


def search_stream(queries: DataFrame, gallery: DataFrame, out: str, checkpoint: str, k: int = 10, threshold: float = 0.55, min_eligible: int = 10):
    """Start the stream; results of batch n are written to ``out/batch=n``.

    A query's result depends on itself and the snapshot only, so any batching gives the
    same rows; a repeated batch overwrites its own folder, which makes replays harmless.
    """

    def run(batch: DataFrame, n: int) -> None:
        ship(batch.sparkSession)
        search_batch(batch, gallery, k, threshold, min_eligible).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
