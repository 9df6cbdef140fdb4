"""Packing pieces into fixed-length sequences: cutting stock by column generation.

Piece lengths are counted in classes of CLASS_WIDTH tokens. A linear program over patterns (how
many pieces of each class share a sequence) is solved by column generation: a revised simplex
keeps one pattern per class, and a knapsack over the dual prices finds the pattern to bring in.
The program has one row per class, whatever the number of documents. Whole parts of the solution
become sequences; the few pieces left over are packed largest first. Pieces are then ranked
within their class, and the rank says which pattern, which sequence and which place it takes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.base import running_total, stored

CAPACITY = 2048
CLASS_WIDTH = 8


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of classes 1..len(prices) within ``capacity`` of the greatest total price."""
    n = len(prices)
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        k = min(n, room)
        found = value[room - 1 :: -1][:k] + prices[:k] if room > 1 else value[:1] + prices[:1]
        best = int(found.argmax())
        value[room], choice[room] = (found[best], best + 1) if found[best] > value[room - 1] else (value[room - 1], 0)
    pattern, room = np.zeros(n, np.int64), capacity
    while room > 0:
        if choice[room]:
            pattern[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(value[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row exchanges (array steps only; BLAS threads may hang in a driver)."""
    m = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(m)], axis=1)
    for k in range(m):
        top = k + int(np.abs(work[k:, k]).argmax())
        work[[k, top]] = work[[top, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        work -= factor[:, None] * work[k]
    return work[:, m:]


def solve(demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, in fractions, for classes 1..len(demand).

    Prices scaled down to value 1 are feasible in the dual, so the objective over the knapsack's
    value bounds the optimum from below, as does the sum of all lengths; columns are brought in until
    the bound is within ``gap`` of the objective, or within half a sequence.
    """
    used = np.flatnonzero(demand)
    if not len(used):
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    m, size = len(used), used + 1
    basis = np.diag(capacity // size).astype(float)
    wanted = demand[used] + 1e-3 * np.random.default_rng(1).random(m)  # breaks ties between pivots
    inverse, level, bound = np.diag(1.0 / np.diag(basis)), wanted / np.diag(basis), float((size * demand[used]).sum()) / capacity
    for step in range(60 * m + 200):
        duals = inverse.sum(axis=0)
        prices = np.zeros(len(demand))
        prices[used] = np.maximum(duals, 0)
        value, pattern = best_pattern(prices, capacity)
        bound = max(bound, level.sum() / max(value, 1.0))
        if value <= 1 + 1e-7 or level.sum() - bound < max(0.5, gap * bound):
            break
        enter = pattern[used].astype(float)
        move = (inverse * enter).sum(axis=1)
        ratio = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        if not np.isfinite(theta):
            break
        level = np.maximum(level - theta * move, 0)
        level[out] = theta
        basis[:, out] = enter
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        if step % 500 == 499:
            inverse = _inverse(basis)
            level = np.maximum((inverse * wanted).sum(axis=1), 0)
    patterns = np.zeros((m, len(demand)), np.int64)
    patterns[:, used] = np.rint(basis.T).astype(np.int64)
    return patterns, level


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that hold exactly the demanded pieces.

    Whole parts of the linear program first; what is left is at most the sum of its patterns and
    is packed largest first.
    """
    patterns, level = solve(demand, capacity)
    left, out = demand.copy(), []
    for pattern, times in zip(patterns, np.floor(level + 1e-6).astype(np.int64)):
        fits = min((int(left[k] // pattern[k]) for k in np.flatnonzero(pattern)), default=0)
        times = min(int(times), fits)
        if times > 0:
            out.append((pattern, times))
            left = left - times * pattern
    while left.any():
        room, pattern = capacity, np.zeros(len(demand), np.int64)
        for k in np.flatnonzero(left)[::-1]:
            n = min(int(left[k]), room // (k + 1))
            pattern[k] += n
            room -= n * (k + 1)
        held = np.flatnonzero(pattern)
        times = max(1, min(int(left[k] // pattern[k]) for k in held))
        out.append((pattern, times))
        left = left - times * pattern
    return out


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    ``order`` names the columns that tell pieces apart; rows equal in all of them may change
    places. Every piece gets one place; the offsets of a sequence have no gaps. An empty table
    gives no rows; all other columns are kept.
    """
    top = math.ceil(capacity / CLASS_WIDTH)
    base = stored(pieces.withColumn("_class", F.ceil(F.col("length") / CLASS_WIDTH).cast("int")).withColumn("_one", F.lit(1).cast("long")), "pieces")
    demand = np.zeros(top, np.int64)
    for r in base.groupBy("_class").count().collect():  # at most capacity / CLASS_WIDTH rows
        demand[r["_class"] - 1] = r["count"]
    sequence, entries, reached = 0, {k: [] for k in range(1, top + 1)}, np.zeros(top, np.int64)
    for pattern, times in plan(demand, capacity // CLASS_WIDTH):
        for k in np.flatnonzero(pattern):
            entries[int(k) + 1].append((int(reached[k]), sequence, int(pattern[k])))
            reached[k] += times * pattern[k]
        sequence += times
    spark = pieces.sparkSession
    schema = "_class int, _from array<long>, _sequence array<long>, _each array<long>"
    table = spark.createDataFrame([(k, [e[0] for e in v], [e[1] for e in v], [e[2] for e in v]) for k, v in entries.items() if v], schema)
    ranked = running_total(base, ["_class"], order, {"_rank": "_one"}, int(demand.sum()))
    placed = ranked.join(F.broadcast(table), "_class")  # one row per class
    entry = F.size(F.filter("_from", lambda x: x <= F.col("_rank")))
    placed = placed.withColumn("_entry", entry).withColumn("_in", F.col("_rank") - F.element_at("_from", F.col("_entry")))
    each = F.element_at("_each", F.col("_entry"))
    placed = placed.withColumn("sequence_id", F.element_at("_sequence", F.col("_entry")) + F.floor(F.col("_in") / each)).withColumn("_place", F.col("_in") % each)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*pieces.columns, F.col("sequence_id").cast("long").alias("sequence_id"), "offset")
