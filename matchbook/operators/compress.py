"""Vector compression: fits, codes and size accounting."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.functions.vectors import vector_sum
from matchbook.operators.ranks import quantiles


def moments(df: DataFrame, vec: str = "emb") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and second-moment matrix of a vector column.

    Each task adds up its own rows; only D + 1 rows of D numbers reach the driver.
    """

    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows == 0:
                continue
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            m = flat.reshape(b.num_rows, -1)
            m1 = np.column_stack([m, np.ones(len(m))])
            gram = m1.T @ m1
            total = gram if total is None else total + gram
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "row": pa.array(list(total), type=pa.list_(pa.float64()))})

    parts = df.select(F.col(vec)).mapInArrow(partial, "i long, row array<double>")
    rows = vector_sum(parts, ["i"], "row").orderBy("i").collect()
    full = np.array([r["total"] for r in rows])
    n = int(round(full[-1, -1]))
    return n, full[-1, :-1] / n, full[:-1, :-1] / n


@dataclass(frozen=True)
class LinearMap:
    """``(x - mean) @ weights``; ``eigenvalues`` and ``explained`` describe a principal fit."""

    mean: np.ndarray
    weights: np.ndarray
    eigenvalues: np.ndarray | None = None
    explained: float | None = None


def fit_pca(df: DataFrame, d: int, whiten: bool = False, eps: float = 1e-6, vec: str = "emb") -> LinearMap:
    """Principal directions from the n - 1 covariance; whitening divides by sqrt(eigenvalue + eps)."""
    n, mean, second = moments(df, vec)
    cov = (second - np.outer(mean, mean)) * (n / max(1, n - 1))
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][:d]
    kept = np.maximum(values[top], 0.0)
    w = vectors[:, top]
    # The sign of a direction is free: make its largest entry positive.
    w = w * np.sign(w[np.abs(w).argmax(axis=0), np.arange(w.shape[1])])
    if whiten:
        w = w / np.sqrt(kept + eps)
    return LinearMap(mean, w, kept, float(kept.sum() / max(values.sum(), 1e-12)))


def project(df: DataFrame, linear: LinearMap, vec: str = "emb", out: str = "z", normalise: bool = False) -> DataFrame:
    """Add the mapped vector; one matrix product per Arrow batch."""
    mean, w = linear.mean, linear.weights
    names = [c for c in df.columns if c != out]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{out}` array<double>"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            flat = b.column(vec).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            z = (flat.reshape(b.num_rows, -1) - mean) @ w
            if normalise:
                z = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-12)
            cols = [b.column(c) for c in names] + [pa.array(list(z), type=pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=names + [out])

    return df.select(*names).mapInArrow(run, schema)


def gallery_adaptation(g: DataFrame, center: float, power: float) -> LinearMap:
    """Subtract part of the gallery mean and flatten its spectrum; the same map serves queries."""
    n, mean, second = moments(g)
    c = mean * center
    m = second - np.outer(mean, c) - np.outer(c, mean) + np.outer(c, c)
    values, vectors = np.linalg.eigh(m)
    s = np.maximum(values, 0.1 * values.mean()) ** (-power)
    return LinearMap(c, (vectors * (s / np.median(s))) @ vectors.T)


@dataclass(frozen=True)
class Variant:
    """A named storage variant: f32, f16, pca<d>[w] with f16, i8 or bin codes, or pq<m>."""

    kind: str
    d: int | None = None
    m: int | None = None
    whiten: bool = False

    @staticmethod
    def parse(name: str) -> "Variant":
        if name in ("f32", "f16"):
            return Variant(name)
        hit = re.fullmatch(r"(pcaw?)(\d+)(?:_(i8|bin))?", name)
        if hit:
            return Variant(hit[3] or "f16", int(hit[2]), None, hit[1] == "pcaw")
        hit = re.fullmatch(r"pq(\d+)", name)
        if hit:
            return Variant("pq", None, int(hit[1]))
        raise ValueError(f"unknown variant {name}")

    def bytes_per_vector(self, dim: int) -> int:
        return {"f32": 4 * dim, "f16": 2 * (self.d or dim), "i8": self.d or 0, "bin": -(-(self.d or 0) // 8), "pq": self.m or 0}[self.kind]


#: The variants that are compared unless others are named.
NAMED = ("f32", "f16", "pca256", "pcaw256", "pca128_i8", "pca64_i8", "pca256_bin", "pca128_bin", "pq32", "pq16")


def fitting(names: Sequence[str], dim: int, rows: int) -> list[str]:
    """The variants that vectors of ``dim`` numbers and a fit on ``rows`` rows allow."""
    parsed = {n: Variant.parse(n) for n in names}
    return [n for n, v in parsed.items() if (v.d is None or v.d <= min(dim, rows - 1)) and (v.m is None or dim % v.m == 0)]


def variant_columns(name: Column, dim: int) -> list[Column]:
    """The same parsing as Column expressions: kind, d, m, whiten and bytes."""
    pca = r"^(pcaw?)(\d+)(?:_(i8|bin))?$"
    is_pca, is_pq = name.rlike(pca), name.rlike(r"^pq\d+$")
    suffix = F.regexp_extract(name, pca, 3)
    d = F.when(is_pca, F.regexp_extract(name, pca, 2).cast("int"))
    m = F.when(is_pq, F.regexp_extract(name, r"^pq(\d+)$", 1).cast("int"))
    kind = F.when(name.isin("f32", "f16"), name).when(is_pca, F.when(suffix == "", "f16").otherwise(suffix)).when(is_pq, "pq")
    size = (
        F.when(kind == "f32", 4 * dim).when(kind == "f16", 2 * F.coalesce(d, F.lit(dim))).when(kind == "i8", d)
        .when(kind == "bin", F.ceil(d / 8)).when(kind == "pq", m))
    return [kind.alias("kind"), d.alias("d"), m.alias("m"), F.coalesce(is_pca & name.startswith("pcaw"), F.lit(False)).alias("whiten"), size.cast("long").alias("bytes")]


def int8_scale(df: DataFrame, vec: str = "z") -> float:
    """One scale for all values: the 0.999 quantile of their size over 127."""
    flat = df.select(F.explode(vec).alias("v")).select(F.abs("v").alias("v"))
    return quantiles(flat, "v", {"q": 0.999}).first()["q"] / 127.0 + 1e-12


def int8_codes(vec: Column, scale: float) -> Column:
    return F.transform(vec, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / scale))).cast("tinyint"))


def sign_words(vec: Column, d: int) -> Column:
    """Sign bits packed into 64-bit words, first value in the lowest bit."""
    word = lambda w: F.aggregate(
        F.reverse(F.slice(vec, 64 * w + 1, min(64, d - 64 * w))), F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
    return F.array(*[word(w) for w in range(-(-d // 64))])


def hamming_similarity(a: Column, b: Column, d: int) -> Column:
    ham = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return 1.0 - ham / float(d)


def fit_product_codes(df: DataFrame, m: int, dim: int, k: int = 256, seed: int = 0, vec: str = "emb") -> list[KMeansModel]:
    """A codebook of k centroids for each of m equal parts of the vector."""
    if dim % m:
        raise ValueError("the number of parts must divide the dimension")
    part = dim // m
    models = []
    for i in range(m):
        rows = df.select(array_to_vector(F.slice(F.col(vec).cast("array<double>"), i * part + 1, part)).alias("features"))
        models.append(KMeans(k=k, seed=seed + i, maxIter=10).fit(rows))
    return models


def product_decoded(df: DataFrame, models: list[KMeansModel], dim: int, vec: str = "emb") -> DataFrame:
    """Codes and the vectors they decode to: adds ``codes`` and replaces ``vec``."""
    part = dim // len(models)
    centers = [np.array(mdl.clusterCenters()) for mdl in models]
    names = [c for c in df.columns if c != vec]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{vec}` array<double>", "codes array<int>"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column(vec).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            codes, out = [], []
            for i, c in enumerate(centers):
                d = ((x[:, None, i * part:(i + 1) * part] - c[None]) ** 2).sum(axis=2)
                code = d.argmin(axis=1)
                codes.append(code)
                out.append(c[code])
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(list(np.hstack(out)), type=pa.list_(pa.float64())), pa.array(list(np.stack(codes, 1).astype(np.int32)), type=pa.list_(pa.int32()))],
                names=names + [vec, "codes"])

    return df.select(*names, vec).mapInArrow(run, schema)
