"""Global ranks, running sums and exact quantiles without a single sorting task.

A window over a whole table would sort everything in one task. Here values are
cut into order-preserving slices (equi-depth split points, with heavy values in
slices of their own, cut again by the tie-breaking ordinal), each slice is ranked
by itself, and the few slice totals supply the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.session import durable

#: Rows one slice should hold, and the least number of slices (a power of four).
SLICE_ROWS = 1 << 19
FEWEST = 16
TIE_WIDTH = 1 << 20


def _slice_count(rows: int) -> int:
    n = FEWEST
    while n * SLICE_ROWS < rows:
        n *= 4
    return n


def _split_points(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Equi-depth split points of ``_v`` per key, ascending: a bounded sketch."""
    points = _doubles([i / n for i in range(1, n)])
    return df.groupBy(*keys).agg(F.percentile_approx("_v", points, F.lit(10000)).alias("_splits"))


def _doubles(values: Sequence[float]) -> Column:
    return F.split(F.lit(",".join(repr(float(x)) for x in values)), ",").cast("array<double>") if len(values) else F.array().cast("array<double>")


def _sliced(df: DataFrame, value: str, tie: str, keys: list[str], descending: bool) -> DataFrame:
    """Add ``_v``, ``_slice`` and ``_sub``: order-preserving slices of a stored table."""
    base = df.withColumn("_v", F.col(value).cast("double") * (-1.0 if descending else 1.0))
    n = _slice_count(df.count())
    width = math.isqrt(n)
    splits = _split_points(base, keys, n)
    if keys:
        # Stored, so that every reader sees the same split points.
        cut = base.join(durable(splits, "splits"), keys)
        points = F.col("_splits")
    else:
        # One bounded array; as a literal it is the same for every reader.
        found = splits.first()["_splits"] or []
        cut = base
        points = _doubles(found)
    # How many split points lie below the value: first among every width-th, then inside one group.
    if keys:
        coarse = F.transform(F.sequence(F.lit(width), F.lit(n - width), F.lit(width)), lambda i: F.get(points, i - 1))
    else:
        coarse = _doubles(found[width - 1 :: width])
    below = lambda some: F.size(F.filter(some, lambda s: s < F.col("_v")))
    cut = cut.withColumn("_group", below(coarse))
    under = F.col("_group") * width + below(F.slice(points, F.col("_group") * width + 1, width))
    heavy = F.coalesce(F.get(points, F.col("_under")) == F.col("_v"), F.lit(False))
    return (
        cut.withColumn("_under", under)
        .withColumn("_slice", 2 * F.col("_under") + heavy.cast("int"))
        .withColumn("_sub", F.when(F.col("_slice") % 2 == 1, F.expr(f"{tie} div {TIE_WIDTH}")).otherwise(F.lit(0)).cast("long"))
        .drop("_splits", "_group", "_under")
    )


def _offsets(cut: DataFrame, keys: list[str], sums: Sequence[str]) -> DataFrame:
    """Per slice: rows and sums before it, inside it and in total. Only slice totals meet in one task."""
    slice_keys = [*keys, "_slice", "_sub"]
    totals = cut.groupBy(*slice_keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_n_{c}") for c in sums])
    part = keys or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy("_slice", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    return totals.select(
        *slice_keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("total"),
        *[F.col(f"_n_{c}") for c in sums],
        *[F.coalesce(F.sum(f"_n_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_n_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )


def running(
    df: DataFrame,
    value: str,
    tie: str,
    keys: Sequence[str] = (),
    descending: bool = False,
    sums: Sequence[str] = (),
    settled: bool = False,
) -> DataFrame:
    """Add ``rank`` (from 1), ``total`` rows, and ``run_<c>``/``total_<c>`` for each column in ``sums``.

    ``tie`` is a non-negative integer ordinal that orders equal values, ascending.
    The input is read several times; pass ``settled`` if it is already a stored table.
    """
    if not settled:
        df = durable(df, "ranked")
    keys = list(keys)
    cut = _sliced(df, value, tie, keys, descending)
    slice_keys = [*keys, "_slice", "_sub"]
    inside = Window.partitionBy(*slice_keys).orderBy("_v", tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.select(
        "*", F.row_number().over(inside).alias("_rn"), *[F.sum(c).over(upto).alias(f"_run_{c}") for c in sums]
    ).join(_offsets(cut, keys, sums).drop(*[f"_n_{c}" for c in sums]), slice_keys)
    return ranked.select(
        *df.columns,
        (F.col("_before") + F.col("_rn")).alias("rank"),
        F.col("total"),
        *[(F.col(f"_before_{c}") + F.col(f"_run_{c}")).alias(f"run_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )


def quantile_rows(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per key and probability: ``p, x, n``.

    Equal values are counted before anything is sorted, NULLs are ignored, and only the
    few slices that hold a wanted position are sorted at all.
    """
    keys = list(keys)
    counted = durable(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_tie", F.lit(0).cast("long")),
        "counted",
    )
    cut = _sliced(counted, "_x", "_tie", keys, False)
    slice_keys = [*keys, "_slice", "_sub"]
    wanted = F.array(*[F.lit(float(p)) for p in probs])

    def held(first, last, n):
        has = lambda i: (i >= first) & (i < last)
        return F.filter(wanted, lambda p: has(F.floor(p * (n - 1))) | has(F.ceil(p * (n - 1))))

    slices = _offsets(cut, keys, ["_c"])
    here = held(F.col("_before__c"), F.col("_before__c") + F.col("_n__c"), F.col("total__c"))
    slices = slices.filter(F.size(here) > 0).select(*slice_keys, F.col("_before__c").alias("_b"), F.col("total__c").alias("n"))
    upto = Window.partitionBy(*slice_keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.join(slices, slice_keys).withColumn("_hi", F.col("_b") + F.sum("_c").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    hit = rows.select(*keys, "_x", "_lo", "_hi", "n", F.explode(held(F.col("_lo"), F.col("_hi"), F.col("n"))).alias("p"))
    at = F.col("p") * (F.col("n") - 1)
    inside = lambda i: (i >= F.col("_lo")) & (i < F.col("_hi"))
    found = hit.groupBy(*keys, "p", "n").agg(
        F.max(F.when(inside(F.floor(at)), F.col("_x"))).alias("_a"),
        F.max(F.when(inside(F.ceil(at)), F.col("_x"))).alias("_b"),
    )
    frac = at - F.floor(at)
    return found.select(*keys, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("x"), "n")


def quantiles(df: DataFrame, value: str, named: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """The same quantiles as one row per key, one column per name, plus ``n``."""
    rows = quantile_rows(df, value, sorted(set(named.values())), keys)
    return rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.abs(F.col("p") - float(p)) < 1e-12, F.col("x"))).alias(name) for name, p in named.items()],
    )
