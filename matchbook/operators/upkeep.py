"""Keeping a gallery graph up to date when observations come and go.

Each table of the graph is an overlay: what a change leaves alone is read where it lies, what it
touches is computed anew. The touched rows are followed exactly, from lists to weights:

1. A list changes if it loses a member, or if a new observation scores at least its last member.
2. A reciprocal or half set changes only where a pair with a changed list starts or stops being
   mutual; both are compared before and after along those pairs.
3. A weight row changes if its reciprocal set does, the half set of one of its members, or the
   vector of an observation that it holds.
4. A mean row changes if the first k2 of its list change, or the weight row of one of them.

All steps are joins from the changed rows outwards; reverse steps read neighbour lists by member.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.operators.graph import GalleryGraph, half_length, mean_weights, row_weights
from matchbook.operators.similarity import nearest, within_marks
from matchbook.session import durable

#: Overlays that lie on each other before the tables are written out again.
OVERLAYS = 8


@dataclass(frozen=True)
class Touched:
    """Rows that one update computed: lists, weight rows, mean rows."""

    lists: int
    weights: int
    means: int


def _ids(df: DataFrame, column: str = "i") -> DataFrame:
    return df.select(F.col(column).alias("i"))


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _overlay(old: DataFrame, rows: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without the given rows i, and ``new``."""
    return old.join(rows, "i", "left_anti").unionByName(new)


def _mutual(nn: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Mutual pairs (i, j) of the first k members, for the given rows i; only their lists and their members' are read."""
    near = nn.filter(F.col("p") <= k)
    out = near.join(rows, "i", "left_semi").select("i", "j")
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"))
    return out.join(back, ["i", "j"], "left_semi")


def _moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ends of the pairs that are in one of the two tables only."""
    pairs = old.select("i", "j", F.lit(1).alias("side")).unionByName(new.select("i", "j", F.lit(2).alias("side")))
    odd = pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return _ids(odd).unionByName(_ids(odd, "j")).distinct()


def changed_lists(graph: GalleryGraph, gallery: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """``i, j, p, d, sim``: the lists that differ in ``gallery``, which has ``added`` and lacks ``removed`` (i)."""
    own = replace(graph.plan, self_sim=1.0)
    length = graph.k1 + 1
    left = graph.nn.join(removed, "i", "left_anti")
    # Lists that lose a member are searched anew, with those of new observations.
    losing = durable(_ids(left.join(removed.select(F.col("i").alias("j")), "j", "left_semi")).distinct(), "losing")
    again = gallery.join(losing.unionByName(_ids(added, "ord")).distinct().withColumnRenamed("i", "ord"), "ord", "left_semi")
    found = nearest(again, gallery, length, own).select(F.col("q_ord").alias("i"), F.col("g_ord").alias("j"), "sim")
    # All others can only gain: a new observation enters where it scores at least the last member.
    rest = left.join(losing, "i", "left_anti")
    last = rest.groupBy(F.col("i").alias("ord")).agg(F.when(F.count(F.lit(1)) == length, F.min("sim")).otherwise(F.lit(-2.0)).alias("tau"))
    entering = durable(within_marks(added, gallery.join(last, "ord"), graph.plan, side="g").select(F.col("g_ord").alias("i"), F.col("q_ord").alias("j"), "sim"), "entering")
    gaining = rest.join(_ids(entering).distinct(), "i", "left_semi").select("i", "j", "sim").unionByName(entering)
    w = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    ranked = found.unionByName(gaining).withColumn("p", F.row_number().over(w) - 1).filter(F.col("p") < length)
    return durable(ranked.select("i", "j", "p", (2.0 - 2.0 * F.col("sim")).alias("d"), "sim"), "changed-lists")


def update_graph(graph: GalleryGraph, gallery: DataFrame, added: DataFrame, removed: DataFrame, check: bool = False) -> tuple[GalleryGraph, Touched]:
    """The graph of ``gallery`` from that of the gallery before.

    ``added`` holds the new observations (those of ``gallery``), ``removed`` the ordinals (i) that
    are gone; an observation whose vector changed is in both. Equal to ``build_graph(gallery)`` up
    to the last bit of sums. With ``check`` a row left with fewer than k1 neighbours is an error.
    """
    k1, k2 = graph.k1, graph.k2
    new_lists = changed_lists(graph, gallery, added, removed)
    listed = durable(_ids(new_lists).distinct(), "listed")
    if check and new_lists.groupBy("i").count().filter(F.col("count") < k1 + 1).limit(1).count():
        raise ValueError("gallery too sparse: a row has fewer than k1 eligible neighbours")
    stale = listed.unionByName(removed).distinct()
    nn = _overlay(graph.nn, stale, new_lists)

    moved = {k: durable(_moved(_mutual(graph.nn, stale, k), _mutual(nn, listed, k)).join(removed.join(_ids(added, "ord"), "i", "left_anti"), "i", "left_anti"), "moved")
             for k in {k1, half_length(k1)}}
    member = _mutual(nn, moved[half_length(k1)], k1).select(F.col("j").alias("i"))
    replaced = removed.join(_ids(added, "ord"), "i", "left_semi")  # same observation, other vector
    held = _ids(graph.before.join(replaced.select(F.col("i").alias("j")), "j", "left_semi"))
    weighted = durable(_union(moved[k1], member, replaced, held.join(removed.join(replaced, "i", "left_anti"), "i", "left_anti")).distinct(), "weighted")
    core = durable(_mutual(nn, weighted, k1), "core")
    half = durable(_mutual(nn, _ids(core, "j").distinct(), half_length(k1)).select(F.col("i").alias("j"), F.col("j").alias("m")), "half")
    new_before = durable(row_weights(core, half, gallery), "new-weights")
    before = _overlay(graph.before, weighted.unionByName(removed).distinct(), new_before)

    if k2 == 1:
        after, averaged = before, weighted
    else:
        top = lambda lists: lists.filter(F.col("p") < k2).select("i", "j")
        shifted = _ids(_union(*[a.exceptAll(b) for a, b in (
            (top(graph.nn.join(listed, "i", "left_semi")), top(new_lists)), (top(new_lists), top(graph.nn.join(listed, "i", "left_semi"))))]))
        holding = top(nn).join(weighted.select(F.col("i").alias("j")), "j", "left_semi")
        averaged = durable(shifted.unionByName(_ids(holding)).distinct(), "averaged")
        new_after = durable(mean_weights(nn.join(averaged, "i", "left_semi"), before, k2), "new-means")
        after = _overlay(graph.after, averaged.unionByName(removed).distinct(), new_after)
    return GalleryGraph(nn, before, after, k1, k2, graph.plan), Touched(listed.count(), weighted.count(), averaged.count())


def written_out(graph: GalleryGraph) -> GalleryGraph:
    """The same graph with each table written once, so that overlays do not pile up."""
    before = durable(graph.before, "row-weights")
    return replace(graph, nn=durable(graph.nn, "neighbours"), before=before, after=before if graph.k2 == 1 else durable(graph.after, "mean-weights"))
