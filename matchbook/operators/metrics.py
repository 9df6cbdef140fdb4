"""Retrieval metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.operators.search import identity_counts, valid_positives
from matchbook.operators.similarity import JUNK, STREAM_ROWS, TILE, _codes, _matrix, allowed_pairs, streamed
from matchbook.session import durable


def average_precision_at_k(
    top: DataFrame, q: DataFrame, g: DataFrame, k: int, strict: bool = False, runs: dict[str, list] | None = None
) -> DataFrame:
    """AP@k per query that has a valid positive: ``q_ord, ap, first_hit, n_valid``.

    ``top`` is the emitted list (``q_ord, pos`` and both identities and cameras). It is
    truncated before junk pairs leave, and the freed places are not refilled. ``strict``
    drops every same-camera candidate. ``runs`` names a key column of ``top`` and its
    values, to score several parameter points at once; every run counts every query.
    """
    keys = tuple(runs or ())
    w = Window.partitionBy(*keys, "q_ord").orderBy("pos")
    junk = F.col("g_camera_id") == F.col("q_camera_id")
    if not strict:
        junk = junk & (F.col("g_vehicle_id") == F.col("q_vehicle_id"))
    rel = (F.col("g_vehicle_id") == F.col("q_vehicle_id")).cast("int")
    clean = (
        top.filter(F.col("pos") <= k)
        .filter(~junk)
        .select(
            *keys,
            "q_ord",
            rel.alias("rel"),
            F.row_number().over(w).alias("at"),
            F.sum(rel).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"),
        )
        .groupBy(*keys, "q_ord")
        .agg(
            F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("at"))).alias("_s"),
            F.min(F.when(F.col("rel") == 1, F.col("at"))).alias("first_hit"),
        )
    )
    counted = valid_positives(q, g).filter(F.col("n_valid") > 0)
    for name, points in (runs or {}).items():
        counted = counted.withColumn(name, F.explode(F.array(*[F.lit(v) for v in points])))
    return (
        counted.join(clean, [*keys, "q_ord"], "left")
        .select(
            *keys,
            "q_ord",
            (F.coalesce("_s", F.lit(0.0)) / F.least(F.col("n_valid"), F.lit(k))).alias("ap"),
            "first_hit",
            "n_valid",
        )
    )


#: Scores this close may change their order by rounding: a matrix product of unit vectors errs by less.
ROUND = 1e-12

#: An integer score times LEVEL, less an ordinal, also orders rows of equal scores.
LEVEL = float(1 << 41)


class _Ranks:
    """Places of all positives of a block of queries; the rest of the gallery streams past."""

    def __init__(self, q: pa.Table, exclude, normalise: bool = True):
        self.q, self.exclude, self.normalise, self.qm = q, exclude, normalise, _matrix(q["emb"], normalise)
        self.exact = _signs(self.qm, q["ord"].to_numpy())
        vehicle = q["vehicle_id"].to_numpy()
        self.members = {v: np.flatnonzero(vehicle == v) for v in np.unique(vehicle)}
        self.found = {v: ([], []) for v in self.members}
        self.rows = None

    def see(self, side: int, g: pa.Table) -> None:
        gm, go, vehicle = _matrix(g["emb"], self.normalise), g["ord"].to_numpy(), g["vehicle_id"].to_numpy()
        allowed = allowed_pairs(self.q, g, self.exclude)
        if side == 0:
            self.exact = self.exact and _signs(gm, go)
            for v in np.unique(vehicle):
                i, j = self.members[v], np.flatnonzero(vehicle == v)
                self.found[v][0].append(np.where(allowed[np.ix_(i, j)], _fold_all(self.qm[i], gm[j]), -np.inf))
                self.found[v][1].append(go[j])
            return
        self._order()
        scores = self.qm @ gm.T
        for v, i in self.members.items():
            allowed[np.ix_(i, np.flatnonzero(vehicle == v))] = False
        scores[~allowed] = -np.inf
        self._count(np.arange(len(self.rows)), scores, allowed, gm, go, 0)

    def _count(self, of: np.ndarray, scores: np.ndarray, allowed: np.ndarray, gm: np.ndarray, go: np.ndarray, column: int) -> None:
        """Add the rows ahead of each mark of the queries ``of`` to a column of their counts; ``scores`` is overwritten."""
        width = scores.shape[1]
        if width == 0:
            return
        exact = self.exact and _signs(gm, go)
        if exact:
            scores = scores * LEVEL - go
        scores.sort(axis=1)
        for r, i in enumerate(of):
            marks, ords, ahead = self.rows[i]
            if not len(marks):
                continue
            if exact:
                ahead[column] += (width - np.searchsorted(scores[r], marks * LEVEL - ords, side="right")).astype(np.int32)
                continue
            upto = np.searchsorted(scores[r], marks, side="right")
            below, above = scores[r, np.maximum(upto - 1, 0)], scores[r, np.minimum(upto, width - 1)]
            if (np.abs(below - marks) > ROUND).all() and (np.abs(above - marks) > ROUND).all():
                ahead[column] += (width - upto).astype(np.int32)
            else:
                ahead[column] += _ahead(np.where(allowed[r], _fold_all(self.qm[i : i + 1], gm)[0], -np.inf), go, marks, ords)

    def _order(self) -> None:
        if self.rows is not None:
            return
        self.rows = [(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros((2, 0), dtype=np.int32))] * len(self.qm)
        for v, (parts, ords) in self.found.items():
            if not parts:
                continue
            ords = np.concatenate(ords)
            for at, r in enumerate(self.members[v]):
                marks = np.concatenate([part[at] for part in parts])
                order = np.lexsort((ords, -marks))[: int(np.isfinite(marks).sum())]
                self.rows[r] = (marks[order], ords[order], np.zeros((2, len(order)), dtype=np.int32))
            self.found[v] = ([], [])

    def result(self) -> dict:
        self._order()
        hit = [r for r, (marks, _, _) in enumerate(self.rows) if len(marks)]
        of, at = self.q["ord"].to_numpy(), [self._at(r, 0) for r in hit]
        return {"q_ord": of[hit], "ap": [_precision(a) for a in at],
                "first_hit": [int(a[0]) for a in at], "last_hit": [int(a[-1]) for a in at], "n_pos": [len(a) for a in at]}

    def _at(self, r: int, column: int) -> np.ndarray:
        """Places of a query's positives, the first one first."""
        ahead = self.rows[r][2][column]
        return ahead + np.arange(1, len(ahead) + 1)


class _TwoRanks(_Ranks):
    """``_Ranks`` in both protocols: without junk pairs, and without any pair of one camera.

    The positives are the same; the rows that only the first protocol ranks are those of the query's own camera. So the
    scores of both parts of the gallery are sorted once, and the counts of the second protocol are a part of the first's.
    """

    def __init__(self, q: pa.Table, normalise: bool = True):
        super().__init__(q, (JUNK,), normalise)

    def see(self, side: int, g: pa.Table) -> None:
        if side == 0:
            super().see(side, g)
            return
        self._order()
        qc, gc = _codes(self.q["camera_id"], g["camera_id"])
        vehicle = self.q["vehicle_id"].to_numpy()
        for column, other in ((0, False), (1, True)):
            for c in np.unique(qc):
                of = np.flatnonzero(qc == c)
                part = g.filter(pa.array((gc != c) if other else (gc == c)))
                gm, go, gv = _matrix(part["emb"], self.normalise) if part.num_rows else np.zeros((0, self.qm.shape[1])), part["ord"].to_numpy(), part["vehicle_id"].to_numpy()
                step = max(1, TILE // max(1, part.num_rows))
                for at in range(0, len(of), step):
                    i = of[at : at + step]
                    allowed = vehicle[i][:, None] != gv[None, :]
                    scores = self.qm[i] @ gm.T
                    scores[~allowed] = -np.inf
                    self._count(i, scores, allowed, gm, go, column)

    def result(self) -> dict:
        self._order()
        hit = [r for r, (marks, _, _) in enumerate(self.rows) if len(marks)]
        cross = [self._at(r, 1) for r in hit]
        both = [a + self.rows[r][2][0] for r, a in zip(hit, cross)]
        return {"q_ord": self.q["ord"].to_numpy()[hit], "ap": [_precision(a) for a in both], "first_hit": [int(a[0]) for a in both],
                "ap_cross": [_precision(a) for a in cross], "first_hit_cross": [int(a[0]) for a in cross]}


def _precision(at: np.ndarray) -> float:
    return float((np.arange(1, len(at) + 1) / at).mean())


def _signs(m: np.ndarray, ords: np.ndarray) -> bool:
    """Whether products of such rows are small integers, which LEVEL and an ordinal number exactly."""
    return m.shape[1] <= 2048 and bool((np.abs(ords) < LEVEL / 2).all() and (np.abs(m) == 1).all())


def _fold_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of all pairs, each summed in dimension order."""
    out = np.zeros((len(a), len(b)))
    bt = np.ascontiguousarray(b.T)
    for i in range(0, len(a), 16):
        s = out[i : i + 16]
        for d in range(a.shape[1]):
            s += a[i : i + 16, d, None] * bt[d]
    return out


def _ahead(scores: np.ndarray, go: np.ndarray, marks: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """How many rows (ordinals ascending) have a higher score than a mark, or an equal one and a lower ordinal."""
    order = np.argsort(scores, kind="stable")
    scores = scores[order]
    lo, hi = np.searchsorted(scores, marks, side="left"), np.searchsorted(scores, marks, side="right")
    ahead = len(scores) - hi
    tied = np.flatnonzero(hi > lo)
    if len(tied):
        step = len(scores) + 1
        group = np.concatenate(([0], np.cumsum(scores[1:] != scores[:-1])))
        place = np.searchsorted(group * step + order, group[lo[tied]] * step + np.searchsorted(go, ords[tied]))
        ahead[tied] += place - lo[tied]
    return ahead.astype(np.int32)


def full_average_precision(q: DataFrame, g: DataFrame, exclude=JUNK, q_rows: int = 512, cells: int = 12 << 20) -> DataFrame:
    """AP over the whole ranking: ``q_ord, ap, first_hit, last_hit, n_pos``.

    A task holds a block of queries and the scores of their positives (about ``cells`` of them at most, fewer
    queries per block if identities are large). The gallery streams past and adds to each positive the number of
    rows ahead, so neither pairs nor histograms are moved: one row per query leaves the task.
    """
    rules = (tuple(exclude),) if exclude else ()
    schema = T.StructType([T.StructField(n, T.DoubleType() if n == "ap" else T.LongType()) for n in ("q_ord", "ap", "first_hit", "last_hit", "n_pos")])
    return _past_blocks(q, g, ["vehicle_id", *(exclude or ())], q_rows, cells, schema, lambda t: _Ranks(t, rules))


def both_average_precisions(q: DataFrame, g: DataFrame, normalise: bool = True, q_rows: int = 512, cells: int = 6 << 20) -> DataFrame:
    """``full_average_precision`` in the standard and the strict cross-camera protocol, in one pass over the gallery:
    ``q_ord, ap, first_hit, ap_cross, first_hit_cross``.

    Without ``normalise``, vectors of small integers (sign codes) have exact scores: their many ties are ordered by ordinal.
    """
    schema = T.StructType([T.StructField(n, T.DoubleType() if n.startswith("ap") else T.LongType()) for n in ("q_ord", "ap", "first_hit", "ap_cross", "first_hit_cross")])
    return _past_blocks(q, g, ["vehicle_id", "camera_id"], q_rows, cells, schema, lambda t: _TwoRanks(t, normalise), 4 * STREAM_ROWS)


def _past_blocks(q: DataFrame, g: DataFrame, carry, q_rows: int, cells: int, schema: T.StructType, start, held: int = STREAM_ROWS) -> DataFrame:
    """Blocks of queries whose identities have about ``cells`` positives at most, past which the gallery streams twice, ``held`` rows at a time."""
    columns = ["ord", "emb", *dict.fromkeys(carry)]
    wanted = q.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("_q")).join(identity_counts(g, ["vehicle_id"]), "vehicle_id")
    parts = F.ceil(F.col("_q") / F.least(F.lit(q_rows), F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("_n")))))
    wanted = durable(wanted.withColumn("parts", parts.cast("int")), "identities")
    # Identities of one block share blocks by hash, twice as many as it takes on average.
    small = wanted.filter("parts = 1").agg(F.sum(F.col("_q") * F.col("_n") / cells).alias("c"), F.sum("_q").alias("q")).first()
    bins = 2 * math.ceil(max(small.c or 0, (small.q or 0) / q_rows, 1))
    block = lambda part: F.when(F.col("parts") > 1, F.xxhash64("vehicle_id", part)).otherwise(F.pmod(F.xxhash64("vehicle_id"), F.lit(bins)))
    homes = durable(wanted.select("vehicle_id", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        "vehicle_id", block(F.col("part")).alias("block")), "blocks")
    blocks = homes.select("block").distinct()
    asked = q.select(*columns).join(wanted.select("vehicle_id", "parts"), "vehicle_id")
    asked = asked.select(*columns, block(F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int")).alias("block"))
    rows = g.select(*columns)
    return streamed(asked, [rows.join(homes, "vehicle_id").select(*columns, "block"), rows.crossJoin(F.broadcast(blocks))],
                    blocks.count(), schema, start, held)


def summary(ap: DataFrame, ranks=(1, 5, 10), keys=()) -> DataFrame:
    """Mean AP, CMC at the given ranks and the number of counted queries."""
    return ap.groupBy(*keys).agg(
        F.avg("ap").alias("map"),
        *[
            F.avg(F.coalesce(F.col("first_hit") <= r, F.lit(False)).cast("int").cast("double")).alias(f"rank{r}")
            for r in ranks
        ],
        F.count(F.lit(1)).alias("n_query_valid"),
    )


def require_valid(summary_row: DataFrame) -> DataFrame:
    """Fail instead of reporting a metric over no query at all."""
    return summary_row.withColumn(
        "map",
        F.when(F.col("n_query_valid") > 0, F.col("map")).otherwise(
            F.raise_error(F.lit("no query has a valid positive in the gallery")).cast("double")
        ),
    )


def mean_inverse_negative_penalty(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg(F.col("n_pos") / F.col("last_hit")).alias("minp"), F.count(F.lit(1)).alias("n_query"))
