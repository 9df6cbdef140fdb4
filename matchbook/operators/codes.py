"""Search on product codes.

A row is stored as one byte per part of its vector: the nearest centroid of that part. A query
block builds one table of inner products per part (rows x centroids), and the score of a row is
the sum of the entries its bytes name; the full vectors are touched only for the short list of
each query, whose scores are then exact. Books are parts x centroids x part size numbers, so
their size does not depend on the gallery.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions.vectors import doubles, dot, unit
from matchbook.operators.compress import fit_product_codes
from matchbook.operators.similarity import Block, Plan, _matrix, blocked
from matchbook.session import durable

#: Centroids of one part: what a byte can name.
CENTROIDS = 256


def books_of_rows(g: DataFrame, m: int, dim: int, k: int = CENTROIDS) -> list[np.ndarray]:
    """Books whose centroids are the parts of the ``k`` rows of the lowest ordinals."""
    if dim % m:
        raise ValueError("the number of parts must divide the dimension")
    rows = g.select("ord", unit(F.col("emb")).alias("v")).orderBy("ord").limit(k).collect()
    return np.split(np.array([r["v"] for r in rows], np.float64).reshape(-1, dim), m, axis=1)


def fitted_books(g: DataFrame, m: int, dim: int, k: int = CENTROIDS, seed: int = 0) -> list[np.ndarray]:
    """Books of centres fitted to the parts of all rows."""
    rows = durable(g.select("ord", unit(F.col("emb")).alias("emb")), "units")
    return [np.array(model.clusterCenters()) for model in fit_product_codes(rows, m, dim, k, seed)]


def encoded(g: DataFrame, books: Sequence[np.ndarray]) -> DataFrame:
    """``g`` with ``emb`` replaced by ``code``, the nearest centroid of each part (ties: the lower one)."""
    names = [c for c in g.columns if c != "emb"]
    schema = ", ".join([f"`{c}` {g.schema[c].dataType.simpleString()}" for c in names] + ["code binary"])
    part = books[0].shape[1]

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column("emb").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            code = np.empty((len(x), len(books)), np.uint8)
            for i, book in enumerate(books):
                gap = np.zeros((len(x), len(book)))
                for d in range(part):
                    gap += (x[:, i * part + d, None] - book[None, :, d]) ** 2
                code[:, i] = gap.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array([c.tobytes() for c in code], pa.binary())], names=names + ["code"])

    return g.withColumn("emb", unit(F.col("emb"))).select(*names, "emb").mapInArrow(run, schema)


def decoded(rows: DataFrame, books: Sequence[np.ndarray]) -> DataFrame:
    """``rows`` with ``code`` replaced by ``emb``, the centroids it names."""
    names = [c for c in rows.columns if c != "code"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + ["emb array<double>"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            x = np.hstack([book[code[:, i]] for i, book in enumerate(books)])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(list(x), pa.list_(pa.float64()))], names=names + ["emb"])

    return rows.mapInArrow(run, schema)


class CodeBlock(Block):
    """A query block against a block of codes: scores are sums of table entries, proposed by products with the decoded rows."""

    def __init__(self, q: pa.Table, g: pa.Table, plan: Plan, books: Sequence[np.ndarray]):
        self.books = books
        super().__init__(q, g, plan)

    def _score(self) -> np.ndarray:
        x, part = _matrix(self.q["emb"], self.plan.normalise), self.books[0].shape[1]
        self.code = np.frombuffer(b"".join(self.g["emb"].to_pylist()), np.uint8).reshape(self.g.num_rows, -1)
        self.tables = []
        for i, book in enumerate(self.books):
            entries = np.zeros((len(x), len(book)))
            for d in range(part):
                entries += x[:, i * part + d, None] * book[None, :, d]
            self.tables.append(entries)
        return x @ np.hstack([book[self.code[:, i]] for i, book in enumerate(self.books)]).T

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s = np.zeros(len(i))
        for entries, code in zip(self.tables, self.code.T):
            s += entries[i, code[j]]
        return s


class CodeIndex:
    """A gallery version as product codes. ``rows`` holds the codes, ``vectors`` the table re-scored from."""

    def __init__(self, g: DataFrame, m: int, dim: int, books: Sequence[np.ndarray] | None = None, seed: int = 0):
        self.books = list(books) if books is not None else fitted_books(g, m, dim, seed=seed)
        self.vectors = g
        self.rows = durable(encoded(g, self.books), "codes")
        self.bytes_per_vector = len(self.books)

    def pool(self, q: DataFrame, size: int, plan: Plan = Plan()) -> DataFrame:
        """The ``size`` best rows of each query by their codes: ``q_ord, g_ord, sim, pos``."""
        books = self.books
        schema = T.StructType([T.StructField("q_ord", T.LongType()), T.StructField("g_ord", T.LongType()), T.StructField("sim", T.DoubleType())])

        def body(b: Block) -> dict:
            i, j, s = b.top(size)
            return {"q_ord": b.qo[i], "g_ord": b.go[j], "sim": s}

        # A block reads the codes in the place of the vectors.
        found = blocked(q, self.rows.withColumnRenamed("code", "emb"), plan, schema, body, make=lambda a, b, p: CodeBlock(a, b, p, books))
        w = Window.partitionBy("q_ord").orderBy(F.desc("sim"), F.asc("g_ord"))
        return found.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= size)

    def search(self, q: DataFrame, k: int, size: int | None = None, plan: Plan = Plan()) -> DataFrame:
        """Top-k of each query's pool (10 k rows unless ``size`` says otherwise) by exact scores: ``q_ord, g_ord, sim, pos``."""
        return self.rescored(q, durable(self.pool(q, size or 10 * k, plan).select("q_ord", "g_ord"), "code-pool"), k, plan)

    def rescored(self, q: DataFrame, pool: DataFrame, k: int, plan: Plan = Plan()) -> DataFrame:
        """Top-k of a given pool (q_ord, g_ord) by exact scores: ``q_ord, g_ord, sim, pos``."""
        side = lambda df, key, out: df.select(F.col("ord").alias(key), (unit(F.col("emb")) if plan.normalise else doubles(F.col("emb"))).alias(out))
        pairs = pool.join(side(q, "q_ord", "_q"), "q_ord").join(side(self.vectors, "g_ord", "_g"), "g_ord")
        w = Window.partitionBy("q_ord").orderBy(F.desc("sim"), F.asc("g_ord"))
        scored = pairs.select("q_ord", "g_ord", dot(F.col("_q"), F.col("_g")).alias("sim"))
        return scored.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
