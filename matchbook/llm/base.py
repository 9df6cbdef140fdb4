"""Shared helpers: tables, stored stages, the registry of this folder, running totals."""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.session import durable, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows that one bucket of a running total holds on average.
BUCKET_ROWS = 1 << 15


#: Rows of whole texts that travel to a Python worker at once.
ARROW_ROWS = 2048


def prepare(spark: SparkSession) -> None:
    """Make the package importable in workers and bound the texts that one Arrow batch holds."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def query(name: str, sql: str | None = None):
    """Register a query of this folder; ``sql`` is its definition over the same tables."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage once to the shared folder and read it back."""
    return durable(df, f"llm-{name}")


def shards_for(rows: int, per_shard: int) -> int:
    return max(1, math.ceil(rows / per_shard))


def crc_mod(id_col: Column, k: int) -> Column:
    """crc32 of the id written as text, modulo ``k``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % k


def in_task(spark: SparkSession, fn: Callable[[], object]) -> object:
    """Result of a bounded fit, computed in one task (workers run array code single-threaded)."""

    def run(batches):
        for _ in batches:
            yield pd.DataFrame({"out": [pickle.dumps(fn())]})

    return pickle.loads(spark.range(0, 1, 1, 1).mapInPandas(run, "out binary").first()["out"])


def running_total(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], rows: int, also: DataFrame | None = None) -> DataFrame:
    """Add, per new column of ``values``, the sum of its source column over the rows before this one.

    Rows of one key are spread over buckets by a hash of ``order``, so a key that holds a third
    of the table is summed by many tasks. The order is (bucket, order): fixed, but not sorted by
    ``order`` overall. Only bucket totals of a key (rows / BUCKET_ROWS of them) meet in one task.
    ``also`` has one row per key; its other columns are joined to the bucket totals and added.
    """
    n = shards_for(rows, BUCKET_ROWS)
    cut = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    sums = [F.sum(c).alias(f"_s_{out}") for out, c in values.items()]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_bucket").agg(*sums)
    zero = F.lit(0).cast("long")
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"),
                            *[F.coalesce(F.sum(f"_s_{out}").over(before), zero).alias(f"_o_{out}") for out in values])
    extra = [] if also is None else [c for c in also.columns if c not in keys]
    if also is not None:
        named = also.select(*[F.col(k).alias(f"_a_{k}") for k in keys], *extra)
        offsets = offsets.join(named, functools.reduce(lambda a, b: a & b, [F.col(f"_k_{k}").eqNullSafe(F.col(f"_a_{k}")) for k in keys]))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.select("*", *[F.coalesce(F.sum(c).over(inside), zero).alias(f"_i_{out}") for out, c in values.items()])
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = ranked.join(offsets, same)
    return joined.select(*df.columns, *extra, *[(F.col(f"_i_{out}") + F.col(f"_o_{out}")).alias(out) for out in values])
