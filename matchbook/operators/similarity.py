"""Blocked similarity joins.

Comparing every query with every gallery row is quadratic in work; what is moved is smaller by the
height of a block. Both sides are cut into blocks of bounded size by a hash of the row ordinal (so
no identity, camera or group of copies can make a block large), each pair of blocks meets in one task,
and the task emits only a reduction: a partial top-k, counts, a histogram, or the pairs above a
threshold. Spark merges the partial results. Blocks are packed into one row each and meet in a
Cartesian product, so every row is shuffled once. Columns on which a pair must agree are part of the
block key, so rows that cannot meet are not brought together; then a cogroup brings the pairs of
blocks together, a gallery row is sent once per query block and a query once per gallery block, and
blocks widen before they become many.

Inside a task a matrix product proposes scores; every score that decides an
order or a threshold is recomputed by a sequential fold in double precision, so
results are identical for any block size, batch size or partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.session import durable

#: Scores closer than this to a decision boundary are recomputed exactly.
EPS = 1e-9

#: Pairs a task scores at once: a block is compared in slices of its queries.
TILE = 1 << 22

#: Pairs that are recomputed exactly at once.
EXACT_ROWS = 1 << 16

#: A search scores tiles of so many queries and gallery rows, and looks at maxima of so many rows first.
TILE_ROWS, TILE_WIDTH, TILE_GROUP = 256, 8192, 32

#: Candidates of a tile's queries that are held before only the best of them are kept.
HELD = 1 << 20

#: Tasks that the pairs of blocks are dealt to; sized by their bytes they are too few for their work.
TASKS = 64

FRAME = ("frame",)
JUNK = ("vehicle_id", "camera_id")
CAMERA = ("camera_id",)
SELF = ("ord",)


#: In a cogroup every row is sent to each block of the other side and every query gives a result per gallery block. So
#: beyond FEW blocks a side, which give enough tasks, blocks are not more but larger, up to MOST_ROWS (some tens of MB).
FEW, MOST_ROWS = 8, 1 << 15

#: The same for packed blocks of queries and of the gallery, of which only the results grow with the gallery's blocks.
FEW_PACKED = (32, 2)

#: Partitions of both sides of a Cartesian product.
SIDES = (16, TASKS // 16)


@dataclass(frozen=True)
class Plan:
    """Block sizes, and which pairs may not be compared.

    ``exclude`` lists column tuples; a pair whose values agree on all columns of
    one tuple is forbidden, and ``require`` lists columns a pair must agree on. ``self_sim`` lets a row meet itself with that score,
    whatever the exclusions say.
    """

    exclude: tuple[tuple[str, ...], ...] = (FRAME,)
    require: tuple[str, ...] = ()
    self_sim: float | None = None
    normalise: bool = True
    q_rows: int = 2048
    g_rows: int = 4096


def _matrix(col: pa.ChunkedArray, normalise: bool) -> np.ndarray:
    n = len(col)
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0 or flat.size % n:
        raise ValueError("vectors of one block must share one dimension")
    m = flat.reshape(n, -1)
    if not normalise:
        return m
    sq = np.zeros(n)
    for d in range(m.shape[1]):
        sq += m[:, d] * m[:, d]
    return m / np.maximum(np.sqrt(sq), 1e-12)[:, None]


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products, summed in dimension order."""
    s = np.zeros(len(a))
    for d in range(a.shape[1]):
        s += a[:, d] * b[:, d]
    return s


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values of both columns are."""
    if a.type != b.type:
        a, b = a.cast(pa.string()), b.cast(pa.string())
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    return both[: len(a)], both[len(a) :]


class Block:
    """One query block against one gallery block, inside a task."""

    def __init__(self, q: pa.Table, g: pa.Table, plan: Plan):
        self.q, self.g, self.plan = q, g, plan
        self.qo, self.go = q["ord"].to_numpy(), g["ord"].to_numpy()
        self.scores = self._score()
        allowed = allowed_pairs(q, g, plan.exclude)
        for c in plan.require:
            qc, gc = _codes(q[c], g[c])
            allowed &= qc[:, None] == gc[None, :]
        if plan.self_sim is not None:
            own = self.qo[:, None] == self.go[None, :]
            allowed |= own
            self._own = own
            self.scores[own] = plan.self_sim
        else:
            self._own = None
        self.self_sim = plan.self_sim
        self.allowed = allowed
        self.scores[~allowed] = -np.inf

    def _score(self) -> np.ndarray:
        """Proposed scores of all pairs; a block of other codes than vectors has its own."""
        self.qm, self.gm = _matrix(self.q["emb"], self.plan.normalise), _matrix(self.g["emb"], self.plan.normalise)
        return self.qm @ self.gm.T

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s = np.empty(len(i))
        for at in range(0, len(i), EXACT_ROWS):
            s[at : at + EXACT_ROWS] = fold(self.qm[i[at : at + EXACT_ROWS]], self.gm[j[at : at + EXACT_ROWS]])
        if self._own is not None:
            s = np.where(self._own[i, j], self.self_sim, s)
        return s

    def refine(self, near: np.ndarray) -> None:
        """Replace the proposed scores of the marked pairs by exact ones."""
        i, j = np.nonzero(near & self.allowed)
        if len(i):
            self.scores[i, j] = self.exact(i, j)

    def top(self, k: int):
        s = self.scores
        width = s.shape[1]
        if width > k:
            # The k-th best of the maxima of disjoint groups is at most the k-th best row.
            groups = 16 * k
            size = width // groups
            keep = self._reach(s[:, : size * groups].reshape(len(s), size, groups).max(axis=1), k) if size >= 4 else None
            if keep is None or np.count_nonzero(keep) > groups * len(s):
                keep = self._reach(s, k)
        else:
            keep = np.ones(s.shape, dtype=bool)
        i, j = np.nonzero(keep & self.allowed)
        e = self.exact(i, j)
        order = np.lexsort((self.go[j], -e, i))
        i, j, e = i[order], j[order], e[order]
        start = np.searchsorted(i, np.arange(len(self.qo)))
        first = (np.arange(len(i)) - start[i]) < k
        return i[first], j[first], e[first]

    def _reach(self, best: np.ndarray, k: int) -> np.ndarray:
        """Which scores are not below the k-th of ``best`` of their query."""
        kth = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
        return self.scores >= np.where(np.isfinite(kth), kth - EPS, -np.inf)[:, None]

    def at_least(self, tau: float):
        self.refine(np.abs(self.scores - tau) <= EPS)
        i, j = np.nonzero((self.scores >= tau) & self.allowed)
        return i, j, self.exact(i, j)


def group_codes(q: pa.Table, g: pa.Table, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of both sides that are equal where rows agree on all ``columns``."""
    both = np.zeros(q.num_rows + g.num_rows, dtype=np.int64)
    for c in columns:
        _, code = np.unique(np.concatenate(_codes(q[c], g[c])), return_inverse=True)
        _, both = np.unique(both * (code.max(initial=0) + 1) + code, return_inverse=True)
    return both[: q.num_rows], both[q.num_rows :]


def _meeting(a: np.ndarray, b: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of all pairs of equal values, unless there are more than ``most``."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, side="left"), np.searchsorted(b[order], a, side="right")
    n = hi - lo
    if n.sum() > most:
        return None
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]]


class Search:
    """The best rows of a gallery block for every query of a block, for one plan or several.

    Scores are proposed in single precision, a tile at a time. Their error is bounded by the lengths of the vectors, so
    what may be among the best is known, and only that is scored exactly. A query's bound grows from tile to tile.
    """

    def __init__(self, q: pa.Table, g: pa.Table, plan: Plan):
        self.q, self.g, self.plan = q, g, plan
        self.qo, self.go = q["ord"].to_numpy(), g["ord"].to_numpy()

    def top(self, k: int):
        return self.tops([(k, self.plan)])[0]

    def tops(self, wanted: Sequence[tuple[int, Plan]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query and gallery places and exact scores for every ``k`` and plan, by query, score and ordinal."""
        self.qm, self.gm = _matrix(self.q["emb"], self.plan.normalise), _matrix(self.g["emb"], self.plan.normalise)
        length = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
        lengths, longest = length(self.qm), length(self.gm).max()
        if not (lengths.max() < 1e15 and longest < 1e15):  # also for values that are no numbers
            return [self._plain(k, plan) for k, plan in wanted]
        self.error = (self.qm.shape[1] + 8) * 2.0**-23 * lengths * longest + EPS
        n, m = len(self.qo), len(self.go)
        self.width = -(-m // (-(-m // TILE_WIDTH) * TILE_GROUP)) * TILE_GROUP
        tiles = -(-m // self.width)
        a, b = self.qm.astype(np.float32), np.zeros((tiles * self.width, self.gm.shape[1]), dtype=np.float32)
        b[:m] = self.gm
        marks = [self._marks(plan, tiles) for _, plan in wanted]
        buffer = np.empty((min(n, TILE_ROWS), self.width), dtype=np.float32)
        out = [[] for _ in wanted]
        for at in range(0, n, TILE_ROWS):
            rows = slice(at, min(at + TILE_ROWS, n))
            states = [_Held(self, rows, k, plan) for k, plan in wanted]
            for t in range(tiles):
                s = np.matmul(a[rows], b[t * self.width : (t + 1) * self.width].T, out=buffer[: rows.stop - at])
                s[:, max(0, m - t * self.width) :] = -np.inf
                for state, mark in zip(states, marks):
                    undo = mark(s, rows, t)
                    state.see(s, t * self.width)
                    for i, j, old in reversed(undo):
                        s[i, j] = old
            for found, state in zip(out, states):
                found.append(state.best())
        return [tuple(map(np.concatenate, zip(*found))) for found in out]

    def _plain(self, k: int, plan: Plan):
        step, out = max(1, TILE // len(self.go)), []
        for at in range(0, len(self.qo), step):
            i, j, e = Block(self.q.slice(at, step), self.g, plan).top(k)
            out.append((i + at, j, e))
        return tuple(map(np.concatenate, zip(*out)))

    def _marks(self, plan: Plan, tiles: int):
        """A function that puts the scores of forbidden and own pairs into a tile and gives what was there."""
        few, dense, size = len(self.qo) * len(self.go) / 64, [], -(-len(self.qo) // TILE_ROWS) * tiles

        def by_tile(i, j):
            of = (i // TILE_ROWS) * tiles + j // self.width
            order = np.argsort(of, kind="stable")
            return i[order] % TILE_ROWS, j[order] % self.width, np.searchsorted(of[order], np.arange(size + 1))

        sparse = []
        for columns in plan.exclude:
            qc, gc = group_codes(self.q, self.g, columns)
            pairs = _meeting(qc, gc, few)
            sparse.append((*by_tile(*pairs), -np.inf)) if pairs else dense.append((qc, gc, np.equal))
        for c in plan.require:
            qc, gc = group_codes(self.q, self.g, (c,))
            if max(qc.max(), gc.max()) > 0:
                dense.append((qc, gc, np.not_equal))
        if plan.self_sim is not None:
            sparse.append((*by_tile(*_meeting(self.qo, self.go, np.inf)), plan.self_sim))

        def mark(s: np.ndarray, rows: slice, t: int) -> list:
            undo, w = [], min(self.width, len(self.go) - t * self.width)
            for qc, gc, rule in dense:
                i, j = np.nonzero(rule(qc[rows, None], gc[None, t * self.width : t * self.width + w]))
                undo.append((i, j, s[i, j]))
                s[i, j] = -np.inf
            for i, j, first, value in sparse:
                at = (rows.start // TILE_ROWS) * tiles + t
                i, j = i[first[at] : first[at + 1]], j[first[at] : first[at + 1]]
                undo.append((i, j, s[i, j]))
                s[i, j] = value
            return undo

        return mark


class _Held:
    """What may be among the ``k`` best rows of the queries of one tile."""

    def __init__(self, search: Search, rows: slice, k: int, plan: Plan):
        self.search, self.rows, self.k, self.plan = search, rows, k, plan
        self.error = search.error[rows]
        self.least = np.full((len(self.error), k), -np.inf, dtype=np.float32)
        self.bound = np.full(len(self.error), -np.inf, dtype=np.float32)
        self.held, self.size = [], 0
        # The maxima of disjoint groups are scores of different rows; with few groups their k-th says little.
        self.group = next((n for n in (TILE_GROUP, 16, 8, 4, 2) if search.width >= 4 * k * n), 1)

    def _raise(self, score: np.ndarray) -> None:
        low = np.nextafter((score.astype(np.float64) - 2.0 * self.error).astype(np.float32), np.float32(-np.inf))
        self.bound = np.maximum(self.bound, low)

    def see(self, s: np.ndarray, at: int) -> None:
        groups = s.shape[1] // self.group
        best = s.reshape(len(s), self.group, groups).max(axis=1)
        both = np.concatenate((self.least, best), axis=1)
        self.least = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        self._raise(self.least[:, 0])
        i, of = np.divmod(np.flatnonzero((best >= self.bound[:, None]) & (best > -np.inf)), groups)
        j = of[:, None] + groups * np.arange(self.group)[None, :]
        score = s[i[:, None], j]
        hit, place = np.nonzero((score >= self.bound[i][:, None]) & (score > -np.inf))
        self.held.append((i[hit], j[hit, place] + at, score[hit, place]))
        self.size += len(hit)
        if self.size > HELD:
            i, j, e = self._exact()
            n = np.bincount(i, minlength=len(self.bound))
            last = np.full(len(self.bound), -np.inf)
            full = np.flatnonzero(n == self.k)
            last[full] = e[np.cumsum(n)[full] - 1]
            self.held, self.size = [(i, j, e.astype(np.float32))], 0
            self._raise(last)

    def _exact(self):
        """The best of what is held, by exact scores."""
        i, j, score = map(np.concatenate, zip(*self.held))
        keep = score >= self.bound[i]
        i, j = i[keep], j[keep]
        e = np.empty(len(i))
        for at in range(0, len(i), EXACT_ROWS):
            part = slice(at, at + EXACT_ROWS)
            e[part] = fold(self.search.qm[i[part] + self.rows.start], self.search.gm[j[part]])
        if self.plan.self_sim is not None:
            e = np.where(self.search.qo[i + self.rows.start] == self.search.go[j], self.plan.self_sim, e)
        order = np.lexsort((self.search.go[j], -e, i))
        i, j, e = i[order], j[order], e[order]
        first = (np.arange(len(i)) - np.searchsorted(i, np.arange(len(self.bound)))[i]) < self.k
        return i[first], j[first], e[first]

    def best(self):
        i, j, e = self._exact()
        return i + self.rows.start, j, e


def _task(plan: Plan, schema: T.StructType, body: Callable[[Block], dict], block: Callable[..., Block], whole: bool):
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return arrow.empty_table()
        if "l_ord" in left.column_names:
            left = left.rename_columns([n.removeprefix("l_") for n in left.column_names])
            right = right.rename_columns([n.removeprefix("r_") for n in right.column_names])
        step = left.num_rows if whole else max(1, TILE // right.num_rows)
        return pa.concat_tables([table(body(block(left.slice(at, step), right, plan))) for at in range(0, left.num_rows, step)])

    def table(columns: dict) -> pa.Table:
        return pa.table(
            [
                c.cast(t.type).combine_chunks()
                if isinstance(c, pa.ChunkedArray)
                else pa.array(c, type=t.type)
                for c, t in zip((columns[t.name] for t in arrow), arrow)
            ],
            schema=arrow,
        )

    return run


def _arrow_type(t: T.DataType) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "boolean": pa.bool_(),
    }
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    return simple[t.simpleString()]


def blocked(
    q: DataFrame,
    g: DataFrame,
    plan: Plan,
    schema: T.StructType,
    body: Callable[[Block], dict],
    q_extra: Sequence[str] = (),
    g_extra: Sequence[str] = (),
    cell: str | None = None,
    together: Sequence[str] = ("ord",),
    make: Callable[..., Block] = Block,
    whole: bool = False,
    wide: bool = True,
    counted: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """Run ``body`` on every pair of blocks that can hold an allowed pair.

    Rows meet only inside their group: the values of ``plan.require`` and of the ``cell`` column
    (one group if there are neither). A group is cut into blocks by its row counts, which may be
    very unequal, so a group with a third of all rows only has more blocks. Every query block
    visits every gallery block of its group. Queries that agree on ``together`` share a block, so
    only a bounded number of them may. ``make`` builds the pair of blocks that ``body`` gets: a slice of
    the queries at a time, so that scores, masks and temporaries stay within a few times TILE numbers, or
    the ``whole`` query block for a body that reduces over its queries. Blocks get ``wide`` beyond FEW a side,
    if what a body gives out grows with the rows of the blocks and not with the pairs. ``counted`` are tables with as many
    rows as both sides, if counting these would compute them twice.

    A result that is read twice in one plan (a self-join above all) should be stored
    first with ``session.durable``, or the comparison work is done twice.
    """
    keys = [c for rule in plan.exclude for c in rule] + list(plan.require)
    q_cols = list(dict.fromkeys(["ord", "emb", *keys, *q_extra]))
    g_cols = list(dict.fromkeys(["ord", "emb", *keys, *g_extra]))
    shared = [*plan.require, *([cell] if cell else [])]
    cut = lambda n, rows, few: (F.greatest(F.least(F.ceil(n / rows), F.lit(few)), F.ceil(n / max(rows, MOST_ROWS))) if wide else F.ceil(n / rows)).cast("int")
    task = _task(plan, schema, body, make, whole)
    if not shared:
        sizes = [df.agg(cut(F.count(F.lit(1)), rows, few).alias("_n")) for df, rows, few in zip(counted or (q, g), (plan.q_rows, plan.g_rows), FEW_PACKED)]
        left, right = _packed(q, q_cols, together, sizes[0], SIDES[0]), _packed(g, g_cols, ("ord",), sizes[1], SIDES[1])
        # The hint asks for a Cartesian product: no side is broadcast, and nothing but the packed blocks is shuffled.
        pairs = left.withColumnRenamed("rows", "l_rows").crossJoin(right.withColumnRenamed("rows", "r_rows").hint("shuffle_replicate_nl"))
        return pairs.mapInArrow(_each_pair(task), schema)
    group = F.xxhash64(*shared)
    size = lambda df, rows, out: df.groupBy(group.alias("_group")).agg(cut(F.count(F.lit(1)), rows, FEW).alias(out))
    parts = size(q, plan.q_rows, "_nq").join(size(g, plan.g_rows, "_ng"), "_group")
    block = lambda n: F.pmod(F.xxhash64("ord"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Fresh column identities on both sides: the two inputs often share their lineage.
    left = q.withColumn("_group", group).join(parts, "_group").select(
        *[F.col(c).alias("l_" + c) for c in q_cols], F.col("_group").alias("l__g"), F.pmod(F.xxhash64(*together), F.col("_nq")).cast("int").alias("l_qb"), every("_ng").alias("l_gb"))
    right = g.withColumn("_group", group).join(parts, "_group").select(
        *[F.col(c).alias("r_" + c) for c in g_cols], F.col("_group").alias("r__g"), every("_nq").alias("r_qb"), block("_ng").alias("r_gb"))
    left, right = left.repartition(TASKS, "l__g", "l_qb", "l_gb"), right.repartition(TASKS, "r__g", "r_qb", "r_gb")
    return left.groupBy("l__g", "l_qb", "l_gb").cogroup(right.groupBy("r__g", "r_qb", "r_gb")).applyInArrow(task, schema)


def _packed(df: DataFrame, cols: Sequence[str], by: Sequence[str], n: DataFrame, partitions: int) -> DataFrame:
    """One row per block, its rows as Arrow streams in an array ``rows``; the one row of ``n`` is the number of blocks.

    Rows become bytes once, before the shuffle, so a block costs a copy of its bytes in each pair it is part of.
    """
    blocks = df.crossJoin(F.broadcast(n)).select(F.pmod(F.xxhash64(*by), F.col("_n")).cast("int").alias("_b"), *cols)

    def pack(batches):
        for batch in batches:
            block = batch.column("_b").to_numpy()
            rows = pa.Table.from_batches([batch.drop_columns(["_b"])]).take(pa.array(np.argsort(block, kind="stable")))
            ids, first = np.unique(np.sort(block), return_index=True)
            streams = []
            for lo, hi in zip(first, [*first[1:], len(block)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as writer:
                    writer.write_table(rows.slice(lo, hi - lo))
                streams.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(streams, pa.binary())], names=["_b", "_rows"])

    packed = blocks.mapInArrow(pack, "_b int, _rows binary")
    return packed.repartitionById(partitions, F.col("_b")).groupBy("_b").agg(F.collect_list("_rows").alias("rows")).select("rows")


def _each_pair(task: Callable[[pa.Table, pa.Table], pa.Table]):
    def rows(column: pa.ListArray, i: int) -> pa.Table:
        return pa.concat_tables([pa.ipc.open_stream(part.as_buffer()).read_all() for part in column[i].values]).combine_chunks()

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield from task(rows(b.column(0), i), rows(b.column(1), i)).to_batches()

    return run


def _pair_schema(q, g, q_carry, g_carry) -> T.StructType:
    fields = [T.StructField("q_ord", T.LongType()), T.StructField("g_ord", T.LongType()),
              T.StructField("sim", T.DoubleType())]
    fields += [T.StructField("q_" + c, q.schema[c].dataType) for c in q_carry]
    fields += [T.StructField("g_" + c, g.schema[c].dataType) for c in g_carry]
    return T.StructType(fields)


def _pair_columns(b: Block, i, j, e, q_carry, g_carry) -> dict:
    out = {"q_ord": b.qo[i], "g_ord": b.go[j], "sim": e}
    for c in q_carry:
        out["q_" + c] = b.q[c].take(pa.array(i))
    for c in g_carry:
        out["g_" + c] = b.g[c].take(pa.array(j))
    return out


def nearest(
    q: DataFrame,
    g: DataFrame,
    k: int,
    plan: Plan = Plan(),
    q_carry: Sequence[str] = (),
    g_carry: Sequence[str] = (),
) -> DataFrame:
    """Exact top-k gallery rows per query: score descending, then gallery ordinal.

    ``pos`` counts from 1. Queries with fewer than k eligible rows get fewer rows.
    """
    schema = _pair_schema(q, g, q_carry, g_carry)
    parts = blocked(
        q, g, plan, schema, lambda b: _pair_columns(b, *b.top(k), q_carry, g_carry), q_carry, g_carry, make=Search, whole=True
    )
    w = Window.partitionBy("q_ord").orderBy(F.desc("sim"), F.asc("g_ord"))
    return parts.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def nearest_each(q: DataFrame, g: DataFrame, wanted: Sequence[tuple[int, Plan]]) -> list[DataFrame]:
    """``nearest`` for every ``k`` and plan, from one comparison of both sides. Results are stored. The first plan sets the blocks."""
    if any(plan.require or plan.normalise != wanted[0][1].normalise for _, plan in wanted):
        raise ValueError("plans of one comparison differ in their exclusions only")
    schema = T.StructType([T.StructField("list", T.IntegerType()), *_pair_schema(q, g, (), ()).fields])
    columns = list(dict.fromkeys(c for _, plan in wanted for rule in plan.exclude for c in rule))

    def body(b: Search) -> dict:
        found = b.tops(wanted)
        i, j, e = map(np.concatenate, zip(*found))
        return {"list": np.repeat(np.arange(len(found), dtype=np.int32), [len(f[0]) for f in found]), **_pair_columns(b, i, j, e, (), ())}

    parts = blocked(q, g, wanted[0][1], schema, body, columns, columns, make=Search, whole=True)
    w = Window.partitionBy("list", "q_ord").orderBy(F.desc("sim"), F.asc("g_ord"))
    most = F.create_map(*[F.lit(x) for n, (k, _) in enumerate(wanted) for x in (n, k)])
    stored = durable(parts.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most[F.col("list")]), "nearest")
    return [stored.filter(F.col("list") == n).drop("list") for n in range(len(wanted))]


def within_marks(q: DataFrame, g: DataFrame, plan: Plan = Plan(), side: str = "q") -> DataFrame:
    """Pairs whose similarity reaches the row's own ``tau`` on the given side."""
    schema = _pair_schema(q, g, (), ())

    def body(b: Block) -> dict:
        tau = (b.q if side == "q" else b.g)["tau"].to_numpy().astype(np.float64)
        t = tau[:, None] if side == "q" else tau[None, :]
        b.refine(np.abs(b.scores - t) <= EPS)
        i, j = np.nonzero((b.scores >= t) & b.allowed)
        return _pair_columns(b, i, j, b.exact(i, j), (), ())

    return blocked(q, g, plan, schema, body, ["tau"] if side == "q" else [], ["tau"] if side == "g" else [], wide=False)


def nearest_in_cells(q: DataFrame, g: DataFrame, k: int, plan: Plan = Plan()) -> DataFrame:
    """Top-k per query among the gallery rows of the query's ``cell``s; ``q`` has one row per probed cell."""
    schema = _pair_schema(q, g, (), ())
    found = blocked(q, g, plan, schema, lambda b: _pair_columns(b, *b.top(k), (), ()), cell="cell", make=Search, whole=True)
    w = Window.partitionBy("q_ord").orderBy(F.desc("sim"), F.asc("g_ord"))
    return found.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def within(
    q: DataFrame,
    g: DataFrame,
    tau: float,
    plan: Plan = Plan(),
    q_carry: Sequence[str] = (),
    g_carry: Sequence[str] = (),
) -> DataFrame:
    """All pairs with similarity of at least ``tau``, as rows."""
    schema = _pair_schema(q, g, q_carry, g_carry)
    return blocked(
        q, g, plan, schema, lambda b: _pair_columns(b, *b.at_least(tau), q_carry, g_carry), q_carry, g_carry, wide=False
    )


#: Members of one track that share a query block; a longer track is cut into parts.
TRACK_ROWS = 256


def joint_counts(q: DataFrame, g: DataFrame, tau: float, plan: Plan = Plan()) -> DataFrame:
    """``track, m, n_cand``: gallery rows whose similarity to all ``m`` queries of a track reaches ``tau``.

    Queries of a track (column ``track``) lie in one block, which intersects their hits as bitmaps
    and gives out one count per track and gallery block. Only a track of more than TRACK_ROWS
    queries has several parts; a part gives out the rows that all its members hit.
    """
    sizes = q.groupBy("track").agg(F.count(F.lit(1)).alias("m"))
    cut = durable(q.join(sizes, "track").withColumn("_part", F.pmod(F.xxhash64("ord"), F.ceil(F.col("m") / TRACK_ROWS))), "tracks")
    schema = T.StructType([T.StructField("track", q.schema["track"].dataType), T.StructField("m", T.LongType()), T.StructField("g_ord", T.LongType()), T.StructField("n", T.LongType())])

    def body(b: Block) -> dict:
        b.refine(np.abs(b.scores - tau) <= EPS)
        track, code = np.unique(b.q["track"].to_numpy(), return_inverse=True)
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(track)))
        here = np.bincount(code)
        of = b.q["m"].to_numpy()[order][first]
        hit = np.logical_and.reduceat((b.scores >= tau)[order], first, axis=0)
        whole, part = np.flatnonzero(here == of), np.flatnonzero(here < of)
        i, j = np.nonzero(hit[part])
        i = part[i]
        return {
            "track": np.concatenate((track[whole], track[i])), "m": np.concatenate((of[whole], of[i])),
            "g_ord": pa.array([None] * len(whole) + b.go[j].tolist(), pa.int64()), "n": np.concatenate((hit[whole].sum(axis=1), here[i]))}

    found = blocked(cut, g, plan, schema, body, ("track", "m", "_part"), (), together=("track", "_part"), whole=True, wide=False)
    # A row of a part counts members; it is a candidate if all members of the track hit it.
    each = found.groupBy("track", "m", "g_ord").agg(F.sum("n").alias("n"))
    counted = each.select("track", F.when(F.col("g_ord").isNull(), F.col("n")).otherwise((F.col("n") == F.col("m")).cast("long")).alias("n"))
    return sizes.join(counted.groupBy("track").agg(F.sum("n").alias("n_cand")), "track", "left").fillna(0, ["n_cand"])


#: Up to so many marks of a query are compared with all scores, which are sorted for more.
FEW_MARKS = 6


def _few_ahead(b: Block, marks: list, ords: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ahead of each of at most ``width`` marks per query, and which of these a query has. Every score is
    compared with every mark: for few marks faster than sorting."""
    n, valid = np.zeros((len(marks), width), dtype=np.int64), np.zeros((len(marks), width), dtype=bool)
    t, o = np.zeros(n.shape), np.zeros(n.shape, dtype=np.int64)
    for i, (m, mo) in enumerate(zip(marks, ords)):
        t[i, : len(m)], o[i, : len(m)], valid[i, : len(m)] = m, mo, True
    for m in range(width):
        n[:, m] = np.count_nonzero(b.scores > (t[:, m] + EPS)[:, None], axis=1)
        upto = np.count_nonzero(b.scores >= (t[:, m] - EPS)[:, None], axis=1)
        for i in np.flatnonzero((upto > n[:, m]) & valid[:, m]):
            near = np.flatnonzero((np.abs(b.scores[i] - t[i, m]) <= EPS) & b.allowed[i])
            e = b.exact(np.full(len(near), i), near)
            n[i, m] += int(((e > t[i, m]) | ((e == t[i, m]) & (b.go[near] < o[i, m]))).sum())
    return n, valid


def counts_ahead(q: DataFrame, g: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """For each query and each of its marks, how many eligible rows come before the mark.

    ``q`` carries ``marks`` (scores) and ``mark_ords`` (ordinals). A row comes
    before a mark if its score is higher, or equal with a lower ordinal. A
    mark ordinal above every row ordinal therefore counts "score >= mark".
    Returns ``q_ord, mark`` (index from 0) and ``n``.
    """
    schema = T.StructType(
        [T.StructField("q_ord", T.LongType()), T.StructField("mark", T.IntegerType()),
         T.StructField("n", T.LongType())]
    )

    def body(b: Block) -> dict:
        qs, ms, ns = [], [], []
        marks, ords = b.q["marks"].to_pylist(), b.q["mark_ords"].to_pylist()
        width = max(map(len, marks), default=0)
        if width <= FEW_MARKS:
            n, valid = _few_ahead(b, marks, ords, width)
            i, m = np.nonzero(valid)
            return {"q_ord": b.qo[i], "mark": m.astype(np.int32), "n": n[i, m]}
        for i in range(len(b.qo)):
            t = np.asarray(marks[i], dtype=np.float64)
            o = np.asarray(ords[i], dtype=np.int64)
            if not len(t):
                continue
            s = np.sort(b.scores[i])  # forbidden rows come first, at -inf
            at = np.searchsorted(s, t + EPS, side="right")
            n = len(s) - at
            for m in np.flatnonzero(s[np.maximum(at - 1, 0)] >= t - EPS):
                near = np.flatnonzero((np.abs(b.scores[i] - t[m]) <= EPS) & b.allowed[i])
                e = b.exact(np.full(len(near), i), near)
                n[m] += int(((e > t[m]) | ((e == t[m]) & (b.go[near] < o[m]))).sum())
            qs.append(np.full(len(t), b.qo[i]))
            ms.append(np.arange(len(t)))
            ns.append(n)
        if not qs:
            return {"q_ord": [], "mark": [], "n": []}
        return {"q_ord": np.concatenate(qs), "mark": np.concatenate(ms).astype(np.int32), "n": np.concatenate(ns)}

    parts = blocked(q, g, plan, schema, body, ["marks", "mark_ords"])
    return parts.groupBy("q_ord", "mark").agg(F.sum("n").alias("n"))


def moments(q: DataFrame, g: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Number, sum and sum of squares of each query's eligible scores: ``q_ord, n, s1, s2``."""
    schema = T.StructType([T.StructField("q_ord", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.DoubleType()), T.StructField("s2", T.DoubleType())])

    def body(b: Block) -> dict:
        out = _moments(b)
        hit = np.flatnonzero(out["n"])
        return {name: values[hit] for name, values in out.items()}

    return blocked(q, g, plan, schema, body).groupBy("q_ord").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])


def _moments(b: Block) -> dict:
    n = np.count_nonzero(b.allowed, axis=1)
    s = b.scores if n.min() == b.allowed.shape[1] else np.where(b.allowed, b.scores, 0.0)
    return {"q_ord": b.qo, "n": n, "s1": s.sum(axis=1), "s2": np.einsum("ij,ij->i", s, s)}


def moments_and_marks(q: DataFrame, g: DataFrame, k: int, plan: Plan = Plan()) -> DataFrame:
    """``moments``, ``counts_ahead`` and the ``k`` best scores in one comparison: ``q_ord, n, s1, s2, ahead, best``.

    ``ahead`` belongs to the first mark; ``best`` is an array, the highest score first.
    """
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in ("s1", "s2") else T.LongType()) for c in ("q_ord", "n", "s1", "s2", "ahead")]
                          + [T.StructField("best", T.ArrayType(T.DoubleType()))])

    def body(b: Block) -> dict:
        out = _moments(b)
        i, _, e = b.top(k)
        of = np.searchsorted(i, np.arange(len(b.qo) + 1))
        first = lambda c: [m[:1] for m in b.q[c].to_pylist()]
        ahead, _ = _few_ahead(b, first("marks"), first("mark_ords"), 1)
        hit = np.flatnonzero(out["n"])
        return {**{name: values[hit] for name, values in out.items()}, "ahead": ahead[hit, 0], "best": [e[of[r] : of[r + 1]] for r in hit]}

    best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best")
    return blocked(q, g, plan, schema, body, ["marks", "mark_ords"]).groupBy("q_ord").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "ahead")], best)


#: Gallery rows of a stream that a task holds at a time.
STREAM_ROWS = 8192


def streamed(q: DataFrame, sides: Sequence[DataFrame], blocks: int, schema: T.StructType, start: Callable[[pa.Table], object], most: int = STREAM_ROWS) -> DataFrame:
    """Bounded blocks of queries, past each of which gallery rows stream in ordinal order.

    For reductions of a query's whole ranking that do not merge from partial ones in little space. ``q`` and every
    side carry a long ``block``; a task holds one query block, the state made of it by ``start`` and ``most``
    gallery rows. The state's ``see(side, rows)`` gets the sides one after the other, ``result()`` gives the columns.
    """
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields])
    all_rows = q.withColumn("side", F.lit(-1))
    for i, side in enumerate(sides):
        all_rows = all_rows.unionByName(side.withColumn("side", F.lit(i)))

    def chunks(batches):
        """Runs of one block and side: the queries of a block whole, gallery rows by ``most``."""
        held, size, now = [], 0, None
        for b in batches:
            if b.num_rows == 0:
                continue
            block, side = b.column("block").to_numpy(), b.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            ends = np.unique(np.concatenate((cuts, np.arange(most, b.num_rows, most), [b.num_rows])))
            for lo, hi in zip([0, *ends[:-1]], ends):
                key = (block[lo], side[lo])
                if held and (key != now or (now[1] >= 0 and size + hi - lo > most)):
                    yield now, pa.Table.from_batches(held)
                    held, size = [], 0
                held.append(b.slice(lo, hi - lo))
                size, now = size + hi - lo, key
        if held:
            yield now, pa.Table.from_batches(held)

    def out(state):
        columns = state.result()
        yield from pa.table([pa.array(columns[t.name], type=t.type) for t in arrow], schema=arrow).to_batches(1 << 16)

    def run(batches):
        state, of = None, None
        for (block, side), rows in chunks(batches):
            if state is not None and block != of:
                yield from out(state)
                state = None
            if side < 0:
                state, of = start(rows), block
            elif state is not None:
                state.see(side, rows)
        if state is not None:
            yield from out(state)

    return all_rows.repartition(max(1, blocks), "block").sortWithinPartitions("block", "side", "ord").mapInArrow(run, schema)


def allowed_pairs(q: pa.Table, g: pa.Table, exclude: Sequence[tuple[str, ...]]) -> np.ndarray:
    """Which pairs agree on all columns of no tuple of ``exclude``."""
    allowed = np.ones((q.num_rows, g.num_rows), dtype=bool)
    for columns in exclude:
        same = np.ones(allowed.shape, dtype=bool)
        for c in columns:
            qc, gc = _codes(q[c], g[c])
            same &= qc[:, None] == gc[None, :]
        allowed &= ~same
    return allowed
