"""Approximate neighbour search and its quality."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.vectors import dot, unit
from matchbook.operators.similarity import Plan, nearest, nearest_in_cells
from matchbook.session import durable


def agreement(lists: DataFrame, k: int) -> DataFrame:
    """Share of the true k neighbours found, and how often the true first is found at 1 and at k."""
    first = F.element_at("truth", 1)
    rate = lambda c: F.avg(c.cast("int").cast("double"))
    return lists.agg(
        F.avg(F.size(F.array_intersect("truth", "found")) / k).alias("agreement"),
        rate(F.element_at("found", 1) == first).alias("planted_at_1"),
        rate(F.array_contains("found", first)).alias("planted_at_10"),
    )


def cell_count(rows: int) -> int:
    """Cells of an index: the square root of its rows, so that cells and their number grow alike."""
    return max(1, math.isqrt(rows))


def fit_cells(g: DataFrame, n_cells: int, seed: int = 0) -> KMeansModel:
    """Cell centres of a gallery, fitted on the unit vectors of all its rows."""
    rows = g.select(array_to_vector(unit(F.col("emb"))).alias("features"))
    return KMeans(k=max(2, n_cells), seed=seed, maxIter=10).fit(rows)


#: Queries on which the number of probes is measured, and standard errors kept off the wanted recall.
MEASURED, MARGIN = 256, 3.0


def _cell_order(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each row of ``x`` from the nearest centre to the farthest."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = (centres**2).sum(axis=1)[None] - 2.0 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")


def _cells(df: DataFrame, model: KMeansModel, probes: int) -> DataFrame:
    """Rows with their ``probes`` nearest cells; the centres are a bounded k x D matrix."""
    centres = np.array(model.clusterCenters())
    names = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["_cells array<int>"])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column("emb").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            near = _cell_order(x, centres)[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [pa.array(list(near), type=pa.list_(pa.int32()))], names=names + ["_cells"])

    return df.mapInArrow(run, schema).withColumn("cell", F.explode("_cells")).drop("_cells")


class CellIndex:
    """A gallery version cut into cells: centres fitted once, every row stored with its cell.

    ``radius`` is the largest angle between a cell's centre and its rows; with it a cell that
    cannot hold a wanted score is never visited.
    """

    def __init__(self, g: DataFrame, n_cells: int | None = None, seed: int = 0):
        model = fit_cells(g, n_cells or cell_count(g.count()), seed)
        centres = np.array(model.clusterCenters())
        self.rows = durable(_cells(g, model, 1), "cells")
        self.model = model
        self.units = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        centre = F.element_at(F.lit(self.units.tolist()).cast("array<array<double>>"), F.col("cell") + 1)
        cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(unit(F.col("emb")), centre)))
        radius = self.rows.groupBy("cell").agg(F.max(F.acos(cosine)).alias("r")).collect()  # one row per cell
        self.radius = np.full(len(centres), -np.inf)
        for r in radius:
            self.radius[r["cell"]] = r["r"]

    def probes_for(self, q: DataFrame, k: int, recall: float = 0.9, plan: Plan = Plan()) -> int:
        """Fewest probes with which ``search`` finds this share of the true ``k`` neighbours.

        The share is measured against exact search: on all queries up to MEASURED, beyond that on
        as many of them, where MARGIN standard errors of the mean are kept as a distance.
        """
        total = q.count()
        some = durable(q.orderBy(F.xxhash64("ord"), "ord").limit(MEASURED), "measured")
        true = nearest(some, self.rows, k, plan).select("q_ord", "g_ord")
        cells = true.join(self.rows.select(F.col("ord").alias("g_ord"), "cell"), "g_ord").select("q_ord", "cell").collect()  # k rows a query
        vectors = {r["ord"]: r["emb"] for r in some.select("ord", "emb").collect()}
        at = {o: i for i, o in enumerate(vectors)}
        if not cells:
            return 1
        place = np.argsort(_cell_order(np.array(list(vectors.values()), np.float64), np.array(self.model.clusterCenters())), axis=1)
        met = np.zeros(place.shape)
        for r in cells:
            met[at[r["q_ord"]], place[at[r["q_ord"]], r["cell"]]] += 1
        met = met[met.sum(axis=1) > 0]
        share = met.cumsum(axis=1) / met.sum(axis=1, keepdims=True)
        error = share.std(axis=0) / math.sqrt(len(share)) * math.sqrt(max(0.0, 1 - len(vectors) / total))
        return int(np.argmax(share.mean(axis=0) - MARGIN * error >= recall)) + 1

    def search(self, q: DataFrame, k: int, probes: int = 4, plan: Plan = Plan()) -> DataFrame:
        """Approximate top-k: exact scores inside each query's nearest cells.

        Queries that meet fewer than k eligible rows in their cells are searched in all cells.
        """
        found = durable(nearest_in_cells(_cells(q, self.model, probes), self.rows, k, plan), "found")
        full = found.groupBy("q_ord").count().filter(F.col("count") >= k).select(F.col("q_ord").alias("ord"))
        short = durable(q.join(full, "ord", "left_anti"), "short")
        rest = nearest(short, self.rows, k, plan).select("q_ord", "g_ord", "sim", "pos")
        return found.join(full.withColumnRenamed("ord", "q_ord"), "q_ord", "left_semi").select("q_ord", "g_ord", "sim", "pos").unionByName(rest)

    def complete(self, q: DataFrame, pool: DataFrame, k: int, plan: Plan = Plan(), slack: float = 1e-6) -> DataFrame:
        """Exact top-k from an approximate pool.

        The k-th score of the pool is a lower bound of the true k-th score. A row of a cell is at
        most as similar as the angle to the centre less the cell's radius allows, so only cells
        that can reach the bound are visited.
        """
        kth = pool.groupBy("q_ord").agg((F.min("sim") - slack).alias("tau"), F.count(F.lit(1)).alias("_n"))
        marked = q.join(kth.withColumnRenamed("q_ord", "ord"), "ord", "left").withColumn(
            "tau", F.when(F.col("_n") >= k, F.col("tau")).otherwise(F.lit(-9.0))).drop("_n")
        w = Window.partitionBy("q_ord").orderBy(F.desc("sim"), F.asc("g_ord"))
        found = nearest_in_cells(self._reachable(marked), self.rows, k, plan)
        return found.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)

    def _reachable(self, marked: DataFrame) -> DataFrame:
        """Queries with every cell whose rows can reach their ``tau``."""
        units, radius, names = self.units, self.radius, marked.columns
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields] + ["_cells array<int>"])

        def run(batches):
            for b in batches:
                if b.num_rows == 0:
                    continue
                x = b.column("emb").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                nearest_angle = np.maximum(np.arccos(np.clip(x @ units.T, -1, 1)) - radius, 0)
                can = (np.cos(nearest_angle) >= b.column("tau").to_numpy()[:, None] - 1e-9) & (radius > -np.inf)
                cells = [np.flatnonzero(row).astype(np.int32) for row in can]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(cells, type=pa.list_(pa.int32()))], names=names + ["_cells"])

        return marked.mapInArrow(run, schema).withColumn("cell", F.explode("_cells")).drop("_cells")


def shortlist(q: DataFrame, g: DataFrame, k: int, n_cells: int | None = None, probes: int = 4, plan: Plan = Plan(), seed: int = 0) -> DataFrame:
    """Approximate top-k over an index built for this call; keep a CellIndex to search a gallery often."""
    return CellIndex(g, n_cells, seed).search(q, k, probes, plan)
