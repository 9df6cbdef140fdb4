"""Re-ranking with the current query inserted into the gallery graph.

The query becomes a node: it enters the neighbour lists of gallery rows it is close
enough to, which can change their reciprocal sets and weights. Only rows whose lists
changed, the rows pushed out of these, and the members of their sets are different from
the static graph, so every step below is a join keyed by the query and touches those
rows only: their number grows with k, not with the gallery.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.operators.graph import FAR, GalleryGraph, allowed_cosine, half_length, jaccard_distance, listed_distance
from matchbook.operators.graph import _reciprocal as _static_sets
from matchbook.operators.similarity import nearest, within_marks
from matchbook.session import durable

#: The inserted query's node number; it sorts before every gallery ordinal.
QUERY = -1


def _lists(q: DataFrame, g: DataFrame, graph: GalleryGraph, top: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Changed neighbour lists (q_ord, i, j, p), and the pairs (q_ord, i) that have one."""
    k1 = graph.k1
    reach = graph.nn.filter(F.col("p") == k1).select(F.col("i").alias("ord"), (1.0 - F.col("d") / 2.0).alias("tau"))
    # A row admits the query if the query is at least as near as its last neighbour; ties favour the query.
    touched = durable(
        within_marks(q, g.join(reach, "ord"), graph.plan, side="g").select("q_ord", F.col("g_ord").alias("i"), (2.0 - 2.0 * F.col("sim")).alias("d")),
        "touched")
    old = touched.select("q_ord", "i").join(graph.nn.select("i", "j", "d"), "i")
    both = old.select("q_ord", "i", "j", "d").unionByName(touched.withColumn("j", F.lit(QUERY).cast("long")).select("q_ord", "i", "j", "d"))
    w = Window.partitionBy("q_ord", "i").orderBy("d", "j")
    rows = both.withColumn("p", F.row_number().over(w) - 1).filter(F.col("p") <= k1).select("q_ord", "i", "j", "p")
    best = nearest(q, g, k1, graph.plan) if top is None else top.filter(F.col("pos") <= k1)
    own = best.select("q_ord", F.lit(QUERY).cast("long").alias("i"), F.col("g_ord").alias("j"), F.col("pos").alias("p"))
    itself = q.select(F.col("ord").alias("q_ord"), F.lit(QUERY).cast("long").alias("i"), F.lit(QUERY).cast("long").alias("j"), F.lit(0).alias("p"))
    lists = durable(rows.unionByName(own).unionByName(itself), "inserted-lists")
    changed = lists.select("q_ord", "i").distinct()
    return lists, changed


def _for_rows(keys: DataFrame, covered: DataFrame, new: DataFrame, static: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``new`` (keyed by q_ord, i) for the keys that are ``covered``, and of ``static`` (keyed by i) for the others."""
    a = keys.join(covered, ["q_ord", "i"], "left_semi").join(new, ["q_ord", "i"]).select("q_ord", "i", *columns)
    b = keys.join(covered, ["q_ord", "i"], "left_anti").join(static, "i").select("q_ord", "i", *columns)
    return a.unionByName(b)


def insertion_scores(q: DataFrame, g: DataFrame, graph: GalleryGraph, top: DataFrame | None = None) -> DataFrame:
    """``q_ord, g_ord, t``: neighbour overlap of the query with gallery rows in the inserted graph.

    ``top`` is the stored result of ``nearest`` for at least k1 rows, if there is one.
    """
    k1, k2 = graph.k1, graph.k2
    half = half_length(k1)
    lists, changed = _lists(q, g, graph, top)
    changed = durable(changed, "changed")
    static = graph.nn.select("i", "j", "p")

    # A reciprocal or half set differs only if the row's own list does, or if the row was pushed out of a list (or of the
    # half of one) that admits the query. All other rows keep their static sets.
    out = static.filter(F.col("p").isin(half, k1)).select("i", F.col("j").alias("_out"))
    touched = changed.filter(F.col("i") != QUERY)
    moved = durable(changed.unionByName(touched.join(out, "i").select("q_ord", F.col("_out").alias("i"))).distinct(), "moved")
    mine = durable(_for_rows(moved, changed, lists, static, ["j", "p"]), "lists")
    ends = mine.select("q_ord", F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("_p"))
    new_ends = ends.join(lists, ["q_ord", "i", "j"]).select("q_ord", "i", "j", "_p", "p")
    old_ends = ends.join(changed, ["q_ord", "i"], "left_anti").join(static, ["i", "j"]).select("q_ord", "i", "j", "_p", "p")
    mutual = durable(new_ends.unionByName(old_ends).select("q_ord", F.col("j").alias("i"), F.col("i").alias("j"), F.greatest("_p", "p").alias("p")), "core")
    sets = lambda k: mutual.filter(F.col("p") <= k).select("q_ord", "i", "j")
    static_core, static_half = _static_sets(static, k1), _static_sets(static, half)

    # Weights differ for those rows and for their reciprocal members, which have them in their sets.
    rows = durable(moved.unionByName(sets(k1).select("q_ord", F.col("j").alias("i"))).distinct(), "affected")
    core = durable(_for_rows(rows, moved, sets(k1), static_core, ["j"]), "core")
    asked = core.select("q_ord", F.col("j").alias("i")).distinct()
    halves = durable(_for_rows(asked, moved, sets(half), static_half, ["j"]).select("q_ord", F.col("i").alias("j"), F.col("j").alias("m")), "half")
    size = halves.groupBy("q_ord", "j").agg(F.count(F.lit(1)).alias("n"))
    close = (
        core.join(halves, ["q_ord", "j"]).join(core.select("q_ord", "i", F.col("j").alias("m")), ["q_ord", "i", "m"])
        .groupBy("q_ord", "i", "j").agg(F.count(F.lit(1)).alias("c")).join(size, ["q_ord", "j"]).filter(3 * F.col("c") > 2 * F.col("n"))
    )
    grown = close.join(halves, ["q_ord", "j"]).select("q_ord", "i", F.col("m").alias("j"))
    expanded = durable(core.unionByName(grown).distinct(), "expanded")

    # Distances: gallery to gallery from vectors, and query to gallery where the query takes part.
    gg = expanded.filter((F.col("i") != QUERY) & (F.col("j") != QUERY))
    gd = listed_distance(gg.select("i", "j").distinct(), g, graph.nn).select("i", "j", "d")
    with_q = expanded.filter((F.col("i") == QUERY) != (F.col("j") == QUERY)).withColumn(
        "g_ord", F.when(F.col("i") == QUERY, F.col("j")).otherwise(F.col("i")))
    qd = allowed_cosine(with_q, q, g, graph.plan).select("q_ord", "i", "j", (2.0 - 2.0 * F.col("sim")).alias("d"))
    blocked = with_q.join(qd, ["q_ord", "i", "j"], "left_anti").select("q_ord", "i", "j", F.lit(FAR).alias("d"))
    selfd = expanded.filter((F.col("i") == QUERY) & (F.col("j") == QUERY)).select("q_ord", "i", "j", F.lit(0.0).alias("d"))
    dist = reduce(DataFrame.unionByName, [gg.join(gd, ["i", "j"]).select("q_ord", "i", "j", "d"), qd, blocked, selfd])
    w = F.exp(-F.col("d"))
    before = durable(dist.select("q_ord", "i", "j", (w / F.sum(w).over(Window.partitionBy("q_ord", "i"))).alias("w")), "inserted-weights")

    # Averaged weights of the query and of the rows whose list, or whose first members' weights, differ; all other rows keep the static ones.
    first = static.filter(F.col("p") < k2).select("i", "j")
    above = rows.filter(F.col("i") != QUERY).withColumnRenamed("i", "j").join(first, "j").select("q_ord", "i")
    mean_rows = durable(changed.unionByName(above).distinct(), "averaged")
    near = _for_rows(mean_rows, changed, lists.filter(F.col("p") < k2), first, ["j"]).select("q_ord", F.col("i").alias("r"), F.col("j").alias("i"))
    near = durable(near, "first-members")
    need = near.select("q_ord", "i").distinct()
    weights = _for_rows(need, rows, before, graph.before, ["j", "w"])
    after = durable(near.join(weights, ["q_ord", "i"]).groupBy("q_ord", F.col("r").alias("i"), "j").agg((F.sum("w") / k2).alias("w")), "inserted-means")
    v = durable(after.filter(F.col("i") == QUERY).select("q_ord", "j", F.col("w").alias("v")), "query-weights")

    new_rows = after.filter(F.col("i") != QUERY)
    differing = new_rows.join(v, ["q_ord", "j"]).groupBy("q_ord", F.col("i").alias("g_ord")).agg(F.sum(F.least("v", "w")).alias("t"))
    kept = v.join(graph.after.select(F.col("i").alias("g_ord"), "j", "w"), "j").join(
        mean_rows.select("q_ord", F.col("i").alias("g_ord")), ["q_ord", "g_ord"], "left_anti")
    return differing.unionByName(kept.groupBy("q_ord", "g_ord").agg(F.sum(F.least("v", "w")).alias("t")))


def current_query_ranking(q: DataFrame, g: DataFrame, k: int, graph: GalleryGraph, lam: float = 0.2, pool: DataFrame | None = None) -> DataFrame:
    """Exact top-k with the query inserted: ``q_ord, g_ord, sim, dist, pos``; ``pool`` restricts the pairs scored."""
    t = insertion_scores(q, g, graph)
    if pool is None:
        pairs = nearest(q, g, k, graph.plan).select("q_ord", "g_ord").join(t, ["q_ord", "g_ord"], "full_outer")
    else:
        pairs = pool.select("q_ord", "g_ord").join(t, ["q_ord", "g_ord"], "left")
    w = Window.partitionBy("q_ord").orderBy("dist", "g_ord")
    return (
        allowed_cosine(pairs, q, g, graph.plan).withColumn("dist", jaccard_distance(F.col("t"), 2.0 - 2.0 * F.col("sim"), lam))
        .withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k).select("q_ord", "g_ord", "sim", "dist", "pos")
    )
