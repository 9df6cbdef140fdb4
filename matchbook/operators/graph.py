"""Neighbour graphs: mutual edges, k-reciprocal re-ranking, neighbourhood averaging.

All graph data are edge tables. Their size is the number of rows times a small
power of k; nothing of size gallery x gallery is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.functions.vectors import add, dot, unit, vector_sum
from matchbook.operators.similarity import EXACT_ROWS, FRAME, SELF, TILE, Plan, _matrix, blocked, fold, group_codes, nearest, nearest_each
from matchbook.session import durable

#: Fixed value: distance of a forbidden pair, beyond the largest possible 4.
FAR = 8.0


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is also present. The edges are stored, as they are read twice."""
    edges = durable(edges, "edges")
    back = edges.select(F.col("q_ord").alias("g_ord"), F.col("g_ord").alias("q_ord"))
    return edges.join(back, ["q_ord", "g_ord"], "left_semi")


@dataclass(frozen=True)
class GalleryGraph:
    """Static part of k-reciprocal re-ranking, built once per gallery version.

    ``nn`` (i, j, p, d, sim): neighbour lists of length k1 + 1, p counting from 0;
    ``before`` and ``after`` (i, j, w): row weights before and after averaging.
    """

    nn: DataFrame
    before: DataFrame
    after: DataFrame
    k1: int
    k2: int
    plan: Plan


def _reciprocal(nn: DataFrame, k: int) -> DataFrame:
    near = nn.filter(F.col("p") <= k).select("i", "j")
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return near.join(back, ["i", "j"], "left_semi")


def pair_distance(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``d`` to (i, j): 0 for a row itself, FAR inside one frame, else 2 - 2 cos."""
    v = rows.select(F.col("ord"), F.col("frame"), unit(F.col("emb")).alias("v"))
    a = v.select(F.col("ord").alias("i"), F.col("frame").alias("_fi"), F.col("v").alias("_vi"))
    b = v.select(F.col("ord").alias("j"), F.col("frame").alias("_fj"), F.col("v").alias("_vj"))
    d = (
        F.when(F.col("i") == F.col("j"), F.lit(0.0))
        .when(F.col("_fi") == F.col("_fj"), F.lit(FAR))
        .otherwise(2.0 - 2.0 * dot(F.col("_vi"), F.col("_vj")))
    )
    return pairs.join(a, "i").join(b, "j").withColumn("d", d).drop("_fi", "_vi", "_fj", "_vj")


def listed_distance(pairs: DataFrame, rows: DataFrame, nn: DataFrame | None) -> DataFrame:
    """``pair_distance`` of different pairs (i, j), read from the lists ``nn`` where they hold it."""
    if nn is None:
        return pair_distance(pairs, rows)
    found = durable(pairs.join(nn.select("i", "j", "d"), ["i", "j"], "left"), "listed")
    return found.filter(F.col("d").isNotNull()).unionByName(pair_distance(found.filter(F.col("d").isNull()).drop("d"), rows))


def neighbours(g: DataFrame, k1: int, plan: Plan = Plan()) -> DataFrame:
    """Neighbour lists of length k1 + 1, stored: ``nn`` of a graph, or of several with up to this k1."""
    return durable(_lists(nearest(g, g, k1 + 1, replace(plan, self_sim=1.0))), "neighbours")


def _lists(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("q_ord").alias("i"), F.col("g_ord").alias("j"), (F.col("pos") - 1).alias("p"), (2.0 - 2.0 * F.col("sim")).alias("d"), "sim")


def neighbours_and_others(g: DataFrame, k1: int, k: int, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """``neighbours``, and the ``k`` nearest other rows of every row whatever the plan excludes, from one comparison."""
    lists, others = nearest_each(g, g, [(k1 + 1, replace(plan, self_sim=1.0)), (k, replace(plan, exclude=(SELF,)))])
    return _lists(lists), others


def build_graph(g: DataFrame, k1: int = 20, k2: int = 6, plan: Plan = Plan(), check: bool = False, nn: DataFrame | None = None) -> GalleryGraph:
    """Neighbour lists, reciprocal expansion and row weights of a gallery; ``nn`` are lists that ``neighbours`` found for it."""
    nn = neighbours(g, k1, plan) if nn is None else nn.filter(F.col("p") <= k1)
    if check and nn.groupBy("i").count().filter(F.col("count") < k1 + 1).limit(1).count():
        raise ValueError("gallery too sparse: a row has fewer than k1 eligible neighbours")
    core = _reciprocal(nn, k1)
    half = _reciprocal(nn, half_length(k1)).select(F.col("i").alias("j"), F.col("j").alias("m"))
    before = durable(row_weights(core, half, g, nn), "row-weights")
    after = before if k2 == 1 else durable(mean_weights(nn, before, k2), "mean-weights")
    return GalleryGraph(nn, before, after, k1, k2, plan)


def half_length(k1: int) -> int:
    return max(1, k1 // 2)


def row_weights(core: DataFrame, half: DataFrame, g: DataFrame, nn: DataFrame | None = None) -> DataFrame:
    """``i, j, w`` for the rows i of ``core`` (i, j); ``half`` (j, m) holds the half sets of all their members.

    Vectors are brought together for pairs only whose distance the lists ``nn`` do not hold.
    """
    size = half.groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    meet = core.select("i", F.col("j").alias("m"))
    close = (
        core.join(half, "j").join(meet, ["i", "m"]).groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))
        .join(size, "j").filter(3 * F.col("c") > 2 * F.col("n"))
    )
    grown = close.join(half, "j").select("i", F.col("m").alias("j"))
    expanded = core.union(grown).distinct()
    weight = F.exp(-F.col("d"))
    return listed_distance(expanded, g, nn).select("i", "j", (weight / F.sum(weight).over(Window.partitionBy("i"))).alias("w"))


def mean_weights(nn: DataFrame, before: DataFrame, k2: int) -> DataFrame:
    """``i, j, w``: the mean weight rows of the k2 first members of each list in ``nn``."""
    return (
        nn.filter(F.col("p") < k2).select("i", F.col("j").alias("n"))
        .join(before.select(F.col("i").alias("n"), "j", "w"), "n")
        .groupBy("i", "j").agg((F.sum("w") / k2).alias("w"))
    )


def query_weights(q: DataFrame, g: DataFrame, graph: GalleryGraph, near: DataFrame | None = None) -> DataFrame:
    """``q_ord, j, v``: the query's weights, from its k2 - 1 nearest gallery rows and itself.

    The query's own component never meets the gallery, so only its share of the mean is used. ``near`` are found lists
    of at least that many rows.
    """
    near = (nearest(q, g, max(graph.k2 - 1, 1), graph.plan) if near is None else near).filter(F.col("pos") <= graph.k2 - 1)
    return (
        near.select("q_ord", F.col("g_ord").alias("i")).join(graph.before, "i")
        .groupBy("q_ord", "j").agg((F.sum("w") / graph.k2).alias("v"))
    )


def overlap(v: DataFrame, after: DataFrame, key: str = "q_ord") -> DataFrame:
    """``q_ord, g_ord, t``: sum of element-wise minima, for pairs that share a neighbour."""
    return (
        v.join(after.select(F.col("i").alias("g_ord"), "j", "w"), "j")
        .groupBy(key, "g_ord").agg(F.sum(F.least("v", "w")).alias("t"))
    )


def jaccard_distance(t, d, lam: float):
    t = F.coalesce(t, F.lit(0.0))
    return (1.0 - lam) * (1.0 - t / (2.0 - t)) + lam * d


def k_reciprocal(
    q: DataFrame, g: DataFrame, k: int, graph: GalleryGraph, lam: float = 0.3, pool: DataFrame | None = None, top: DataFrame | None = None
) -> DataFrame:
    """Exact top-k after k-reciprocal re-ranking: ``q_ord, g_ord, sim, dist, pos``.

    Every allowed pair is ranked. ``pool`` (q_ord, g_ord) restricts which pairs are. ``top`` is the stored result of
    ``nearest`` for at least k and k2 - 1 rows, if there is one.
    """
    if pool is None:
        top = durable(nearest(q, g, max(k, graph.k2 - 1), graph.plan).select("q_ord", "g_ord", "sim", "pos"), "nearest") if top is None else top
        return _ranked(q, g, query_weights(q, g, graph, top), graph.after, k, lam, graph.plan, top)
    v = query_weights(q, g, graph, top)
    w = Window.partitionBy("q_ord").orderBy("dist", "g_ord")
    pairs = pool.select("q_ord", "g_ord").join(overlap(v, graph.after), ["q_ord", "g_ord"], "left")
    return (
        allowed_cosine(pairs, q, g, graph.plan)
        .withColumn("dist", jaccard_distance(F.col("t"), 2.0 - 2.0 * F.col("sim"), lam))
        .withColumn("pos", F.row_number().over(w))
        .filter(F.col("pos") <= k)
        .select("q_ord", "g_ord", "sim", "dist", "pos")
    )


class _Reranked:
    """A pair of blocks whose rows carry their weights as arrays ``members`` and ``weights``, members ascending."""

    #: Queries whose common entries are added at once.
    ROWS = 64

    def __init__(self, q: pa.Table, g: pa.Table, plan: Plan, lam: float):
        self.q, self.g, self.plan, self.lam = q, g, plan, lam
        row, member, weight = _entries(g)
        order = np.argsort(member, kind="stable")
        self.weights = {"row": row[order], "member": member[order], "weight": weight[order]}

    def _sharing(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs that share a member, and the sums of their element-wise minima."""
        row, member, weight = _entries(self.q)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        for at in range(0, self.q.num_rows, self.ROWS):
            part = slice(*np.searchsorted(row, (at, at + self.ROWS)))
            asked = np.unique(member[part])
            lo, hi = (np.searchsorted(self.weights["member"], asked, side=s) for s in ("left", "right"))
            entries = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            met, of = np.unique(self.weights["row"][entries], return_inverse=True)
            own = (row[part] - at, member[part], weight[part])
            t = _minima(own, {**{c: v[entries] for c, v in self.weights.items()}, "row": of}, (self.ROWS, len(met)))
            i, j = np.nonzero(t)
            found.append((i + at, met[j], t[i, j]))
        return tuple(map(np.concatenate, zip(*found)))

    def best(self, k: int) -> dict:
        """The ``k`` best rows of each query among those that share a member with it."""
        i, j, t = self._sharing()
        free = np.ones(len(i), dtype=bool)
        for columns in self.plan.exclude:
            a, b = group_codes(self.q, self.g, columns)
            free &= a[i] != b[j]
        i, j, t = i[free], j[free], t[free]
        qm, gm, sim = _matrix(self.q["emb"], self.plan.normalise), _matrix(self.g["emb"], self.plan.normalise), np.empty(len(i))
        for at in range(0, len(i), EXACT_ROWS):
            sim[at : at + EXACT_ROWS] = fold(qm[i[at : at + EXACT_ROWS]], gm[j[at : at + EXACT_ROWS]])
        dist = (1.0 - self.lam) * (1.0 - t / (2.0 - t)) + self.lam * (2.0 - 2.0 * sim)
        qo, go = self.q["ord"].to_numpy(), self.g["ord"].to_numpy()
        order = np.lexsort((go[j], dist, i))
        i, j, sim, dist = i[order], j[order], sim[order], dist[order]
        first = (np.arange(len(i)) - np.searchsorted(i, np.arange(len(qo)))[i]) < k
        return {"q_ord": qo[i[first]], "g_ord": go[j[first]], "sim": sim[first], "dist": dist[first]}


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, member and weight of every entry."""
    members, weights = rows["members"].combine_chunks(), rows["weights"].combine_chunks()
    row = np.repeat(np.arange(len(members)), pc.list_value_length(members).to_numpy(zero_copy_only=False))
    return row, members.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)


def _minima(q: tuple, g: dict, shape: tuple[int, int]) -> np.ndarray:
    """Sums of element-wise minima of all pairs, a bounded number of common entries at a time."""
    row, member, weight = q
    t = np.zeros(shape[0] * shape[1])
    lo, hi = np.searchsorted(g["member"], member, side="left"), np.searchsorted(g["member"], member, side="right")
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(row):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILE, side="right")))
        n = (hi - lo)[at:upto]
        own = np.repeat(np.arange(at, upto), n)
        other = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own]
        np.add.at(t, row[own] * shape[1] + g["row"][other], np.minimum(weight[own], g["weight"][other]))
        at = upto
    return t.reshape(shape)


def _ranked(a: DataFrame, b: DataFrame, v: DataFrame, after: DataFrame, k: int, lam: float, plan: Plan, top: DataFrame) -> DataFrame:
    """Top-k rows of ``b`` for each row of ``a`` by distance; ``v`` (q_ord, j, v) and ``after`` (i, j, w) are their weights.

    Of the pairs without a common member only the k of highest cosine can win, which ``top`` (of at least k rows) holds. If a pair of
    ``top`` has one but is not among the k best of these, neither is it with the greater distance that it has without.
    """
    none = F.array().cast("array<struct<j:bigint,w:double>>")

    def carried(rows: DataFrame, weights: DataFrame) -> DataFrame:
        each = weights.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("_e"))
        e = F.coalesce("_e", none)
        return rows.join(each, "ord", "left").withColumns({"members": e["j"], "weights": e["w"]}).drop("_e")

    x = carried(a, v.select(F.col("q_ord").alias("ord"), F.col("j").cast("long").alias("j"), F.col("v").alias("w")))
    y = carried(b, after.select(F.col("i").alias("ord"), F.col("j").cast("long").alias("j"), "w"))
    schema = T.StructType([T.StructField("q_ord", T.LongType()), T.StructField("g_ord", T.LongType()), T.StructField("sim", T.DoubleType()), T.StructField("dist", T.DoubleType())])
    extra = ("members", "weights")
    sharing = blocked(x, y, plan, schema, lambda block: block.best(k), extra, extra, make=lambda q, g, p: _Reranked(q, g, p, lam), whole=True, counted=(a, b))
    plain = top.filter(F.col("pos") <= k).select("q_ord", "g_ord", "sim", jaccard_distance(F.lit(None).cast("double"), 2.0 - 2.0 * F.col("sim"), lam).alias("dist"))
    found = sharing.unionByName(plain).groupBy("q_ord", "g_ord").agg(F.min("sim").alias("sim"), F.min("dist").alias("dist"))
    w = Window.partitionBy("q_ord").orderBy("dist", "g_ord")
    return found.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def allowed_cosine(pairs: DataFrame, q: DataFrame, g: DataFrame, plan: Plan) -> DataFrame:
    """Cosine of listed pairs, dropping forbidden ones."""
    cols = sorted({c for rule in plan.exclude for c in rule} - {"ord"})
    a = q.select(F.col("ord").alias("q_ord"), unit(F.col("emb")).alias("_a"), *[F.col(c).alias("_a_" + c) for c in cols])
    b = g.select(F.col("ord").alias("g_ord"), unit(F.col("emb")).alias("_b"), *[F.col(c).alias("_b_" + c) for c in cols])
    joined = pairs.join(a, "q_ord").join(b, "g_ord")
    for rule in plan.exclude:
        same = F.lit(True)
        for c in rule:
            same = same & ((F.col("q_ord") == F.col("g_ord")) if c == "ord" else (F.col("_a_" + c) == F.col("_b_" + c)))
        joined = joined.filter(~same)
    drop = ["_a", "_b", *["_a_" + c for c in cols], *["_b_" + c for c in cols]]
    return joined.withColumn("sim", dot(F.col("_a"), F.col("_b"))).drop(*drop)


def listed_cosines(pairs: DataFrame, spaces: list[tuple[DataFrame, DataFrame]], plan: Plan, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cosines ``s0, s1, ...`` of listed pairs (q_ord, g_ord) in several spaces, dropping forbidden pairs; double columns ``carry`` stay.

    A query takes its list along, so vectors meet in blocks and not pair by pair.
    """
    names = ["emb", *[f"emb{n}" for n in range(1, len(spaces))]]

    def side(at: int) -> DataFrame:
        out = spaces[0][at]
        for name, space in zip(names[1:], spaces[1:]):
            out = out.join(space[at].select("ord", F.col("emb").alias(name)), "ord")
        return out

    lists = pairs.groupBy(F.col("q_ord").alias("ord")).agg(F.collect_list(F.struct("g_ord", *carry)).alias("_e"))
    asked = side(0).join(lists, "ord").withColumns({c: F.col("_e")[c] for c in ("g_ord", *carry)}).drop("_e")
    sims = [f"s{n}" for n in range(len(spaces))]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("q_ord", "g_ord")] + [T.StructField(c, T.DoubleType()) for c in (*carry, *sims)])

    def body(block) -> dict:
        q, g = block
        flat = lambda c: q[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        wanted, go = flat("g_ord"), g["ord"].to_numpy()
        i = np.repeat(np.arange(q.num_rows), pc.list_value_length(q["g_ord"].combine_chunks()).to_numpy(zero_copy_only=False))
        order = np.argsort(go, kind="stable")
        at = np.minimum(np.searchsorted(go[order], wanted), len(go) - 1)
        here = np.flatnonzero(go[order[at]] == wanted)
        for columns in plan.exclude:
            a, b = group_codes(q, g, columns)
            here = here[a[i[here]] != b[order[at[here]]]]
        i, j = i[here], order[at[here]]
        out = {"q_ord": q["ord"].to_numpy()[i], "g_ord": go[j], **{c: flat(c)[here] for c in carry}}
        for sim, name in zip(sims, names):
            qm, gm = _matrix(q[name], plan.normalise), _matrix(g[name], plan.normalise)
            parts = [fold(qm[i[n : n + EXACT_ROWS]], gm[j[n : n + EXACT_ROWS]]) for n in range(0, len(i), EXACT_ROWS)]
            out[sim] = np.concatenate([np.zeros(0), *parts])
        return out

    return blocked(asked, side(1), plan, schema, body, (*names[1:], "g_ord", *carry), names[1:], make=lambda q, g, p: (q, g), whole=True, counted=spaces[0])


def k_reciprocal_shared(rows: DataFrame, k: int, graph: GalleryGraph, lam: float = 0.3,
                        sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Re-ranking when one set is both query and gallery; a row is never its own candidate.

    With ``sources`` and ``targets`` the same graph ranks one part of it against another.
    """
    a = rows if sources is None else sources
    b = rows if targets is None else targets
    v = graph.after.select(F.col("i").alias("q_ord"), "j", F.col("w").alias("v"))
    after = graph.after
    if sources is not None:
        v = v.join(a.select(F.col("ord").alias("q_ord")), "q_ord", "left_semi")
    if targets is not None:
        after = after.join(b.select(F.col("ord").alias("i")), "i", "left_semi")
    plan = replace(graph.plan, exclude=(*graph.plan.exclude, ("ord",)))
    return _ranked(a, b, v, after, k, lam, plan, nearest(a, b, k, plan))


def _average(base: DataFrame, edges: DataFrame, donors: DataFrame, alpha: float) -> DataFrame:
    """Unit vectors of ``base`` plus their weighted neighbours, renormalised."""
    w = F.pow(F.greatest(F.col("sim"), F.lit(0.0)), F.lit(alpha))
    moved = vector_sum(
        edges.join(donors.select(F.col("ord").alias("g_ord"), unit(F.col("emb")).alias("_v")), "g_ord"),
        ["q_ord"], "_v", w, "_add",
    ).withColumnRenamed("q_ord", "ord")
    own = unit(F.col("emb"))
    return (
        base.join(moved, "ord", "left")
        .withColumn("emb", unit(F.when(F.col("_add").isNull(), own).otherwise(add(own, F.col("_add")))))
        .drop("_add")
    )


def average_lists(rows: DataFrame, k: int, plan: Plan = Plan(exclude=(FRAME, ("ord",)))) -> DataFrame:
    """The k nearest rows of every row, stored: lists for averages over up to k neighbours."""
    return durable(nearest(rows, rows, k, plan).select("q_ord", "g_ord", "sim", "pos"), "nearest")


def neighbourhood_average(rows: DataFrame, k: int = 3, alpha: float = 1.0, mutual_only: bool = True,
                          min_sim: float = 0.0, plan: Plan = Plan(exclude=(FRAME, ("ord",))), near: DataFrame | None = None) -> DataFrame:
    """Each vector plus its k (mutual) neighbours with similarity of at least ``min_sim``; ``near`` are ``average_lists`` of the plan."""
    edges = nearest(rows, rows, k, plan) if near is None else near.filter(F.col("pos") <= k)
    if mutual_only:
        edges = mutual(edges)
    return _average(rows, edges.filter(F.col("sim") >= min_sim), rows, alpha)


def query_expansion(q: DataFrame, g: DataFrame, k: int = 3, alpha: float = 3.0, plan: Plan = Plan(exclude=())) -> DataFrame:
    """Each query vector plus its k nearest gallery vectors weighted by similarity^alpha."""
    return _average(q, nearest(q, g, k, plan), g, alpha)
