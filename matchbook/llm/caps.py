"""Near-duplicate vectors by spherical-cap filters with structured codes and list decoding.

A filter direction is the concatenation of one code word per block of coordinates, so CODE words
in each of BLOCKS blocks make CODE**BLOCKS directions. A vector (after a fixed rotation) passes
every filter whose direction has an inner product of at least ``height`` with it. These are found
without looking at all directions: block sums are combined two and two, sums that cannot reach
the height are dropped, and the rest is met in the middle. Vectors that share a filter are
compared: first by half-precision copies, whose inner products are off by less than SLACK, and
where that leaves the decision open by the full vectors in double precision.

The number of directions grows with the number of vectors of a dimension, so a filter holds about
as many vectors at every size. The height is where random vectors pass LIST filters of this very
code, and a pair just similar enough is missed by a code with a probability that is measured on
random pairs (it depends on the cosine alone, since the rotation is random). Codes are added until
all of them miss such a pair with a probability of at most MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.base import shards_for, stored
from matchbook.llm.links import components

COSINE = 0.9
#: Expected filters per vector and code, and blocks of a direction.
LIST, BLOCKS = 24, 2
#: Largest probability that a pair at COSINE shares no filter, and random pairs it is measured on.
MISS, TRIALS = 1e-4, 1000
#: More than the error of an inner product of two unit vectors rounded to 11 significant bits.
SLACK = 0.002
#: Entries per shard, and vectors of one filter from which it is cut into tiles.
SHARD_ENTRIES, TILE = 40_000, 2048
SEED = 19


class Code:
    """One random product code for vectors of ``dim`` coordinates; without a height it measures its own."""

    def __init__(self, dim: int, vectors: int, number: int, height: float | None = None):
        self.blocks = min(BLOCKS, dim)
        self.size = max(3, math.ceil(max(1, vectors) ** (1 / self.blocks)))
        rng = np.random.default_rng([SEED, number, dim])
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.edges = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.words = []
        for a, b in zip(self.edges[:-1], self.edges[1:]):
            w = rng.normal(size=(self.size, b - a)) if b - a > 1 else np.array([[1.0], [-1.0]])
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(self.blocks))

        self.miss = None
        if height is None:
            self._tune(rng)
        else:
            self.height = height

    def _tune(self, rng: np.random.Generator) -> None:
        """Height at which random vectors pass LIST filters, and the share of pairs at COSINE that share none.

        A code that misses most pairs gets longer lists.
        """
        x, off = rng.normal(size=(2, TRIALS, self.edges[-1]))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        off -= (off * x).sum(axis=1, keepdims=True) * x
        y = COSINE * x + math.sqrt(1 - COSINE**2) * off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
        y /= np.linalg.norm(y, axis=1, keepdims=True)  # of one coordinate: x itself
        filters = math.prod(len(w) for w in self.words)
        left, right = self._sums(x[: max(20, min(200, 4_000_000 // self.size))])
        right.sort(axis=1)
        wanted = LIST
        while True:
            low, high = -1.0, 1.0
            for _ in range(24):
                middle = (low + high) / 2
                passed = np.mean([right.shape[1] * len(a) - np.searchsorted(b, middle - a).sum() for a, b in zip(left, right)])
                low, high = (middle, high) if passed >= min(wanted, filters / 2) else (low, middle)
            self.height = low
            (i, f), (j, g) = self.decode(x), self.decode(y)
            met = np.unique(np.intersect1d(i * filters + f, j * filters + g) // filters)
            self.miss = (TRIALS - len(met) + 1) / (TRIALS + 1)
            if self.miss <= 0.5 or wanted >= filters / 2:
                return
            wanted *= 2

    def _sums(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of rows with the words of the left and of the right blocks."""
        x = unit @ self.rotation
        sums = [x[:, a:b] @ w.T for a, b, w in zip(self.edges[:-1], self.edges[1:], self.words)]
        half = max(1, self.blocks // 2)
        return self._outer(sums[:half]), self._outer(sums[half:]) if sums[half:] else np.zeros((len(x), 1))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and filter number of every filter that a row of ``unit`` passes."""
        step = max(1, min(1000, 4_000_000 // self.size))
        parts = [self._decode(unit[at : at + step]) for at in range(0, len(unit), step)]
        rows = [row + at * step for at, (row, _) in enumerate(parts)]
        return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *[found for _, found in parts]])

    def _decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = self._sums(unit)
        width = right.shape[1]
        rows, found = [], []
        for i in range(len(unit)):
            best_l, best_r = left[i].max(), right[i].max()
            a = np.flatnonzero(left[i] >= self.height - best_r)
            b = np.flatnonzero(right[i] >= self.height - best_l)
            if not len(a) or not len(b):
                continue
            b = b[np.argsort(right[i][b])]
            begin = np.searchsorted(right[i][b], self.height - left[i][a])
            count = len(b) - begin
            at = np.repeat(np.arange(len(a)), count)
            inside = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + begin[at]
            found.append(a[at] * width + b[inside])
            rows.append(np.full(len(at), i))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(found)

    @staticmethod
    def _outer(sums: list[np.ndarray]) -> np.ndarray:
        out = sums[0]
        for s in sums[1:]:
            out = (out[:, :, None] + s[:, None, :]).reshape(len(out), -1)
        return out


def heights(dim: int, vectors: int) -> list[float]:
    """Heights of as many codes as it takes to miss a pair at COSINE with a probability of at most MISS."""
    out, miss = [], 1.0
    while miss > MISS:
        code = Code(dim, vectors, len(out))
        out.append(code.height)
        miss *= code.miss
    return out


def _matrix(vectors) -> np.ndarray:
    """Unit vectors of one dimension as rows, in double precision."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(key: np.ndarray, node: np.ndarray, unit: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Distinct pairs (smaller node, larger node, 1 if surely linked) among rows that share a key.

    ``side`` (0 left, 1 right, 2 both) limits the pairs of a tile to those across its sides.
    """
    order = np.argsort(key, kind="stable")
    bounds = np.append(np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))), len(order)) if len(order) else np.zeros(1, int)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a < 2:
            continue
        rows = order[a:b]
        for at in range(0, len(rows), 512):
            near = unit[rows[at : at + 512]] @ unit[rows].T
            i, j = np.nonzero(near >= COSINE - SLACK)
            x, y, sure = rows[at : at + 512][i], rows[j], near[i, j] >= COSINE + SLACK
            whole = (side[x] == 2) & (side[y] == 2) & (node[x] < node[y])
            keep = whole | (side[x] == 0) & (side[y] == 1) & (node[x] != node[y])
            if keep.any():
                p, q = node[x[keep]], node[y[keep]]
                out.append(np.stack([np.minimum(p, q), np.maximum(p, q), sure[keep]], axis=1))
        if len(out) > 256:
            out = [np.unique(np.concatenate(out), axis=0)]
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose cosine in double precision is high enough."""
    for t in batches:
        keep = np.array([np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y)) >= COSINE for x, y in zip(t["va"], t["vb"])], bool)
        yield t.loc[keep, ["a", "b"]]


def _in_range(v: Column) -> Column:
    """The vector, times a power of two if its squares could leave the range of doubles."""
    top = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    half = F.floor(F.log2(top) / 2)  # two factors, since one alone could leave the range
    factor = F.pow(F.lit(2.0), -half)
    return F.when((top > 2.0**400) | (top < 2.0**-400), F.transform(v, lambda x: x * factor * factor)).otherwise(v)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing and are
    components of their own; so do vectors with a null id (null component). Only vectors of equal
    dimension are compared. Equal vectors are one node with a count. Rows that share an id are
    one node and do not count each other. An empty table gives no rows; other columns are ignored.
    """
    v = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), _in_range(v)).alias("v")), "vectors")
    nodes = stored(rows.filter(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("v")), "nodes")

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tuned = [heights(int(dim), int(n)) for dim, n in zip(batch["dim"], batch["n"])]
            yield pd.DataFrame({"dim": batch["dim"], "n": batch["n"], "heights": tuned})

    dims = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).mapInPandas(plan, "dim int, n long, heights array<double>")
    tuned = {r["dim"]: (r["n"], r["heights"]) for r in dims.collect()}  # one row per dimension

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[tuple[int, int], Code] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                n, levels = tuned[dim]
                for at in range(0, len(part), 1000):
                    some = part.iloc[at : at + 1000]
                    unit = _matrix(some["v"])
                    for number, height in enumerate(levels):
                        code = codes.setdefault((dim, number), codes.get((dim, number)) or Code(int(dim), n, number, height))
                        row, found = code.decode(unit)
                        key = (found * len(levels) + number) * 4096 + (int(dim) % 4096)
                        yield pd.DataFrame({"key": key, "node": some["node"].to_numpy()[row], "v": [x.tobytes() for x in unit.astype("<f2")[row]]})

    entries = stored(nodes.select("node", "v", "dim").mapInPandas(decode, "key long, node long, v binary"), "filters")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    sizes = stored(sizes.withColumn("tiles", F.ceil(F.col("held") / TILE).cast("int")), "filter-sizes")
    met = entries.join(sizes, "key")
    # A filter of many vectors is cut into blocks; each pair of blocks is compared somewhere else.
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("node", "v", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
                     F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"))
    shards = shards_for(entries.count(), SHARD_ENTRIES)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        width = part["v"].str.len().to_numpy()
        out = []
        for w in np.unique(width):  # vectors of one dimension
            some = part[width == w]
            unit = np.frombuffer(b"".join(some["v"]), "<f2").reshape(len(some), -1).astype(np.float32)
            out.append(_pairs(some["tile"].to_numpy(), some["node"].to_numpy(), unit, some["side"].to_numpy()))
        pairs = np.concatenate(out) if out else np.empty((0, 3), np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "sure": pairs[:, 2].astype(bool)})

    found = met.withColumn("shard", F.pmod("tile", F.lit(shards))).groupBy("shard").applyInPandas(compare, "a long, b long, sure boolean")
    found = stored(found.distinct(), "vector-pairs")
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("v").alias("v" + c))
    open_ = found.filter("not sure").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    checked = open_.select("a", "b", "va", "vb").mapInPandas(_verify, "a long, b long")
    links = stored(found.filter("sure").select("a", "b").unionByName(checked).distinct(), "vector-links")
    count = nodes.select(F.col("node").alias("b"), "n").groupBy("b").agg(F.sum("n").alias("n"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(stored(count, "node-counts"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    named = nodes.select("v", "node", "n").join(others, F.col("node") == F.col("a"), "left").join(
        components(links).withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
    named = stored(named.select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vector-nodes")
    linked = F.col("v").isNotNull()
    component = F.when(linked, F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.join(named, "v", "left").select(
        "vec_id", F.coalesce(F.when(linked, F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
