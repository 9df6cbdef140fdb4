"""Vector arithmetic as JVM-side Column expressions.

Every fold runs in element order in double precision, so a value does not depend
on how rows are batched or partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column, floor: float = 1e-12) -> Column:
    """L2-normalised copy of a vector column."""
    v = doubles(v)
    # A one-element array carries the norm into the lambda, so it is folded once per row.
    return F.flatten(
        F.transform(F.array(F.greatest(norm(v), F.lit(floor))), lambda n: F.transform(v, lambda x: x / n))
    )


def cosine_distance(cos: Column) -> Column:
    """Squared euclidean distance of two unit vectors from their cosine."""
    return 2.0 - 2.0 * cos


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def all_finite(v: Column) -> Column:
    return F.forall(v, finite)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, s) -> Column:
    s = F.lit(s) if isinstance(s, (int, float)) else s
    return F.transform(a, lambda x: x * s)


def mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)


def std_of(v: Column) -> Column:
    """Population standard deviation of one row's array."""
    return F.flatten(
        F.transform(
            F.array(mean_of(v)),
            lambda m: F.array(
                F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(v))
            ),
        )
    )[0]


def vector_sum(df, keys, vec: str, weight: Column | None = None, out: str = "total"):
    """Element-wise (weighted) sum of the vectors of each key.

    The sum is taken per (key, dimension), so partial sums combine before the
    shuffle and a key holding a third of all rows costs one row per map task.
    """
    w = F.lit(1.0) if weight is None else weight
    return (
        df.select(*keys, w.alias("_w"), F.posexplode(doubles(F.col(vec))).alias("_d", "_x"))
        .groupBy(*keys, "_d")
        .agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_d", "_s"))).alias("_a"))
        .select(*keys, F.col("_a._s").alias(out))
    )
