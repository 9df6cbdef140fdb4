"""Extension points: embedding functions and nearest neighbours of a table of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions.vectors import all_finite, norm, unit


def embed(df: DataFrame, column: str, function: Callable[[list], np.ndarray], dimension: int) -> DataFrame:
    """Apply a user's batch function to a column; the vectors must be finite, nonzero and of the given size."""
    names = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["emb array<double>"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            out = np.asarray(function(b.column(column).to_pylist()), dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(list(out), type=pa.list_(pa.float64()))], names=names + ["emb"])

    ok = (F.size("emb") == dimension) & all_finite(F.col("emb")) & (norm(F.col("emb")) > 1e-8)
    return df.mapInArrow(run, schema).withColumn("emb", F.when(ok, unit(F.col("emb"))).otherwise(
        F.raise_error(F.lit("embedding function returned an unusable vector")).cast("array<double>")))


#: Rows of a query block that one call of the table function compares; a gallery block has WIDER times as many.
BLOCK, WIDER = 1024, 8


@F.udtf(returnType="q_ord long, g_ord long, sim double", useArrow=True)
class Knn:
    """Table function: of a block of queries and a block of gallery rows, the k best per query.

    Arguments are the ordinals and the concatenated vectors of both blocks, and k. The matrix
    product only proposes rows; those that may be among the best are scored in dimension order.
    """

    def eval(self, q_ords, q_flat, g_ords, g_flat, k):
        from matchbook.operators.similarity import fold

        def matrix(flat, ords):
            m = np.asarray(flat, np.float64).reshape(len(ords), -1)
            return m / np.maximum(np.sqrt(fold(m, m)), 1e-12)[:, None]

        q_ords, g_ords, k = np.asarray(q_ords), np.asarray(g_ords), min(int(k), len(g_ords))
        if k < 1:
            return
        q, g = matrix(q_flat, q_ords), matrix(g_flat, g_ords)
        scores = q @ g.T
        i, j = np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, [-k]] - 1e-9)
        sims = fold(q[i], g[j])
        order = np.lexsort((g_ords[j], -sims, i))
        best = order[np.arange(len(i)) - np.searchsorted(i, i) < k]  # i is sorted, so places count within a query
        yield from zip(q_ords[i[best]].tolist(), g_ords[j[best]].tolist(), sims[best].tolist())


def _blocks(df: DataFrame, side: str, size: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // size))
    rows = F.sort_array(F.collect_list(F.struct("ord", "emb")))
    cut = df.groupBy(F.pmod(F.xxhash64("ord"), F.lit(n).cast("long")).alias(f"{side}_block")).agg(rows.alias("r"))
    return cut.select(f"{side}_block", F.col("r.ord").alias(f"{side}_ords"), F.flatten("r.emb").alias(f"{side}_flat")), n


def knn_lateral(q: DataFrame, g: DataFrame, k: int) -> DataFrame:
    """k nearest gallery rows of every query row, ``q_ord, pos, g_ord, sim``, from SQL.

    ``knn`` is registered as a table function and called LATERAL on every pair of a query block and
    a gallery block, of about BLOCK and WIDER * BLOCK rows whatever the tables hold; a window keeps the k best
    of all blocks. A worker turns all rows of an Arrow batch into lists at once, so there are as many
    partitions as pairs of blocks, and a task gets few of them however large the tables are. Ties go to the lower ordinal; fewer than k gallery rows give fewer rows. The
    gallery is sent once per query block and never comes to the driver.
    """
    spark = q.sparkSession
    spark.udtf.register("knn", Knn)
    queries, m = _blocks(q, "q", BLOCK)
    gallery, n = _blocks(g, "g", WIDER * BLOCK)
    asked = queries.withColumn("g_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    met = asked.hint("merge").join(gallery, "g_block").repartition(m * n, "q_block", "g_block")
    return spark.sql(
        """SELECT q_ord, pos, g_ord, sim FROM (
             SELECT k.*, row_number() OVER (PARTITION BY k.q_ord ORDER BY k.sim DESC, k.g_ord) AS pos
             FROM {met} b, LATERAL knn(b.q_ords, b.q_flat, b.g_ords, b.g_flat, {k}) k)
           WHERE pos <= {k}""", met=met, k=k)
