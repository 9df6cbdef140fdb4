"""Identity-aware splits, query/gallery builders, samplers and mining.

Random choices use a seeded integer hash, so a split is the same in every engine
and does not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.text import seeded_order
from matchbook.operators.boxes import components
from matchbook.operators.ranks import running
from matchbook.operators.similarity import Plan, nearest
from matchbook.session import durable


def shuffled_ids(df: DataFrame, seed: int, column: str = "vehicle_id") -> DataFrame:
    """Distinct identities with their position in a seeded order: id, ``rank`` from 1, ``total``."""
    ids = df.filter(F.col(column) >= 0).select(column).distinct()
    return running(ids.withColumn("_h", seeded_order(seed, F.col(column))), "_h", column).drop("_h")


def first_fraction(frac: float, at_least_one: bool = True):
    """Whether a shuffled identity is among the first ``frac`` of all, rounding half to even."""
    n = F.rint(F.col("total") * frac).cast("long")
    return F.col("rank") <= (F.greatest(n, F.lit(1)) if at_least_one else n)


def open_set_split(df: DataFrame, val_frac: float = 0.2, seed: int = 0) -> DataFrame:
    """Add ``part``: identities, not rows, go to fit or val; unknown identities stay in fit."""
    val = shuffled_ids(df, seed).filter(first_fraction(val_frac)).select("vehicle_id", F.lit("val").alias("_p"))
    return df.join(val, "vehicle_id", "left").withColumn("part", F.coalesce("_p", F.lit("fit"))).drop("_p")


def halves(df: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``half``: A for the first half of the shuffled identities, B for the rest."""
    a = shuffled_ids(df, seed).filter(F.col("rank") <= F.expr("total div 2")).select("vehicle_id", F.lit("A").alias("_p"))
    return df.join(a, "vehicle_id", "left").withColumn("half", F.coalesce("_p", F.lit("B"))).drop("_p")


def _distractors(val: DataFrame, frac: float, seed: int) -> DataFrame:
    d = shuffled_ids(val, seed).filter(first_fraction(frac, False)).select("vehicle_id", F.lit(True).alias("distractor"))
    return val.join(d, "vehicle_id", "left").fillna(False, ["distractor"])


def query_gallery_by_id(val: DataFrame, distractor_frac: float = 0.2, queries_per_id: int = 1, seed: int = 0) -> DataFrame:
    """Add ``role`` (query, gallery, dropped) and ``has_match``.

    A distractor gives one query and no gallery row; a single sighting goes to the
    gallery; else ``queries_per_id`` rows are queries and at least one row stays. A query
    of an identity seen by several cameras always has a sighting by another camera.
    """
    rows = _distractors(val, distractor_frac, seed).withColumn("_h", seeded_order(seed + 1, F.col("ord")))
    sizes = val.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("_n"))
    # Only the first few rows per identity are ranked; the group limit keeps a huge identity out of one task.
    order = Window.partitionBy("vehicle_id").orderBy("_h", "ord")
    first = rows.select("vehicle_id", "ord", "_h").withColumn("_at", F.row_number().over(order)).filter(
        F.col("_at") <= max(1, queries_per_id)).select("ord", "_at")
    j = rows.join(sizes, "vehicle_id").join(first, "ord", "left")
    # With several rows of one identity the last row can never be a query.
    chosen = F.coalesce(F.col("_at") <= F.least(F.lit(queries_per_id), F.col("_n") - 1), F.lit(False))
    role = (
        F.when(F.col("distractor"), F.when(F.col("_at") == 1, "query").otherwise("dropped"))
        .when(F.col("_n") < 2, "gallery")
        .when(chosen, "query")
        .otherwise("gallery")
    )
    return j.withColumn("role", role).withColumn("has_match", (F.col("role") == "query") & ~F.col("distractor")).drop("_h", "_at", "_n")


def query_gallery_by_track(val: DataFrame, distractor_frac: float = 0.1, seed: int = 0) -> DataFrame:
    """One gallery row per (identity, camera); all others query; distractors only query."""
    rows = _distractors(val, distractor_frac, seed).withColumn("_h", seeded_order(seed + 1, F.col("ord")))
    tracks = rows.groupBy("vehicle_id", "camera_id").agg(F.min(F.struct("_h", "ord")).alias("_f")).select(
        F.col("_f.ord").alias("ord"), F.lit(True).alias("_first"))
    j = rows.join(tracks, "ord", "left")
    gallery = ~F.col("distractor") & F.coalesce("_first", F.lit(False))
    return (
        j.withColumn("role", F.when(gallery, "gallery").otherwise("query"))
        .withColumn("has_match", (F.col("role") == "query") & ~F.col("distractor"))
        .drop("_h", "_first")
    )


def frames_as_cameras(df: DataFrame) -> DataFrame:
    """Every frame becomes its own camera, numbered by first appearance."""
    first = df.groupBy("frame").agg(F.min("ord").alias("_first"))
    ids = running(first, "_first", "_first").select("frame", F.col("rank").cast("int").alias("_cam"))
    return df.join(ids, "frame").withColumn("camera_id", F.col("_cam")).drop("_cam")


def identity_batches(df: DataFrame, p: int, k: int, n_batches: int, seed: int = 0, by_camera: bool = False) -> DataFrame:
    """P identities x K rows per batch: ``batch, slot, vehicle_id, ord``; short identities repeat rows.

    ``by_camera`` deals one row per camera before a second one of the same camera.
    """
    # Identities get a seeded position once; every batch reads p positions from a seeded start.
    ids = running(df.select("vehicle_id").distinct().withColumn("_h", seeded_order(seed, F.col("vehicle_id"))), "_h", "vehicle_id")
    ids = durable(ids.select("vehicle_id", (F.col("rank") - 1).alias("_at"), F.col("total").alias("_n")), "identities")
    many = ids.select(F.max("_n")).scalar()
    batches = df.sparkSession.range(n_batches).select(F.col("id").cast("int").alias("batch")).withColumn("_start", seeded_order(seed, F.lit("start"), F.col("batch")))
    seats = batches.withColumn("_n", many).withColumn("_seat", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(p).cast("long"), F.col("_n")) - 1)))
    chosen = seats.select("batch", ((F.col("_start") + F.col("_seat")) % F.col("_n")).alias("_at")).join(ids.select("vehicle_id", "_at"), "_at").select("vehicle_id", "batch")
    # Rows get a position inside their group once; a batch then reads k positions from a
    # seeded start, so it never touches more than k rows of a group, however large it is.
    group = ["vehicle_id", "camera_id"] if by_camera else ["vehicle_id"]
    placed = running(df.select("vehicle_id", "camera_id", "ord").withColumn("_h", seeded_order(seed + 1, F.col("ord"))), "_h", "ord", group)
    placed = durable(placed.select(*group, "ord", (F.col("rank") - 1).alias("_at"), F.col("total").alias("_n"), *([] if by_camera else ["camera_id"])), "positions")
    sizes = placed.groupBy(*group).agg(F.max("_n").alias("_n"))
    start = seeded_order(seed + 2, F.col("batch"), *[F.col(c) for c in group])
    turns = chosen.join(sizes, "vehicle_id").withColumn(
        "_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(k).cast("long"), F.col("_n")) - 1)))
    seats = turns.withColumn("_at", (start + F.col("_turn")) % F.col("_n")).drop("_n")
    rows = seats.join(placed, [*group, "_at"])
    own = Window.partitionBy("batch", "vehicle_id")
    order = own.orderBy("_turn", seeded_order(seed + 3, F.col("batch"), F.col("camera_id")), "camera_id") if by_camera else own.orderBy("_turn")
    dealt = rows.withColumn("_i", F.row_number().over(order)).filter(F.col("_i") <= k)
    n = F.max("_i").over(own)
    slots = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: s % n == F.col("_i") - 1)
    return dealt.withColumn("slot", slots).select("batch", "vehicle_id", "ord", "camera_id", F.explode("slot").alias("slot"))


def episodes(df: DataFrame, day: str, keep: dict[str, tuple[float, float]], per_id: int = 3) -> DataFrame:
    """Cross-condition episodes: ``episode, role, ord``.

    Every identity gives one query per direction; only the identities in the kept
    fraction range appear in the gallery, with up to ``per_id`` rows of the other condition.
    """
    # Identities are numbered in id order, as a distributed rank.
    ids = running(df.select("vehicle_id").distinct(), "vehicle_id", "vehicle_id")
    rows = df.withColumn("day", F.expr(day)).join(ids, "vehicle_id")
    at = F.row_number().over(Window.partitionBy("vehicle_id", "day").orderBy("ord"))
    rows = rows.withColumn("_at", at).filter(F.col("_at") <= per_id)
    out = []
    for direction, day_query in (("day-night", True), ("night-day", False)):
        for name, (lo, hi) in keep.items():
            is_q = (F.col("day") == F.lit(day_query)) & (F.col("_at") == 1)
            known = (F.col("rank") > F.floor(F.col("total") * lo)) & (F.col("rank") <= F.floor(F.col("total") * hi))
            is_g = (F.col("day") != F.lit(day_query)) & known
            out.append(F.when(is_q, F.struct(F.lit(f"{direction}-{name}").alias("episode"), F.lit("query").alias("role"))))
            out.append(F.when(is_g, F.struct(F.lit(f"{direction}-{name}").alias("episode"), F.lit("gallery").alias("role"))))
    return rows.select("ord", "vehicle_id", F.explode(F.array_compact(F.array(*out))).alias("_e")).select(
        "_e.episode", "_e.role", "ord", "vehicle_id")


#: Clusters of one resolution that a task finishes by itself.
TASK_CLUSTERS = 4096


def _finish(threshold: float):
    """Average linkage of all clusters of one resolution, from their means and sizes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        x, size = np.stack(pdf["emb"].to_numpy()).astype(np.float64), pdf["n"].to_numpy().astype(np.float64)
        dist = x @ x.T
        np.subtract(1.0, dist, out=dist)
        np.fill_diagonal(dist, np.inf)
        label = np.arange(len(x))
        # Each row keeps its nearest one; a merge concerns only the rows that had one of the two.
        near = dist.argmin(axis=1)
        least = dist[label, near]
        while True:
            i = least.argmin()
            j = near[i]
            if not least[i] < threshold:
                break
            row = (size[i] * dist[i] + size[j] * dist[j]) / (size[i] + size[j])
            row[[i, j]] = np.inf
            dist[i], dist[:, i] = row, row
            dist[j], dist[:, j] = np.inf, np.inf
            size[i] += size[j]
            label[label == label[j]] = label[i]
            lost = (near == i) | (near == j)
            lost[[i, j]] = True
            nearer = ~lost & ((row < least) | ((row == least) & (i < near)))
            near[nearer], least[nearer] = i, row[nearer]
            lost = np.flatnonzero(lost)
            near[lost] = dist[lost].argmin(axis=1)
            least[lost] = dist[lost, near[lost]]
        ords = pdf["ord"].to_numpy()
        return pd.DataFrame({"a": ords[label], "b": ords})

    return run


def average_linkage(frames: DataFrame, threshold: float, task_clusters: int = TASK_CLUSTERS) -> DataFrame:
    """``ord, first``: the least ordinal of each frame's cluster; only frames of one resolution join.

    The average of the cosine distances between two clusters is one minus the product of the means
    of their unit vectors, so a cluster is its mean and its size and no table of pairs exists. This
    linkage is reducible: clusters that are each other's nearest stay so until they merge. A round
    merges all such pairs at once, drops clusters without a neighbour below the threshold, and
    searches anew only for clusters that are new or lost their nearest one. Resolutions with at
    most ``task_clusters`` clusters left are finished by one task each. Equal vectors start as one
    cluster; equally near clusters go by ordinal.
    """
    norm = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x * x)) + 1e-8
    unit = durable(frames.select("ord", "resolution", F.transform("emb", lambda x: x / norm).alias("emb")), "frames")
    clusters = durable(unit.groupBy("resolution", "emb").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n")), "clusters")
    start, plan = clusters, Plan(exclude=(("ord",),), require=("resolution",), normalise=False)
    columns, merges = ["ord", "resolution", "emb", "n"], [clusters.filter("false").select(F.col("ord").alias("a"), F.col("ord").alias("b"))]
    active = clusters.withColumn("near", F.lit(None).cast("long"))
    while True:
        counts = active.groupBy("resolution").agg((F.count(F.lit(1)) <= task_clusters).alias("small"))
        some = counts.agg(F.max("small").alias("small"), F.max(~F.col("small")).alias("large")).first()
        if some.small:
            placed = active.join(counts, active["resolution"].eqNullSafe(counts["resolution"])).drop(counts["resolution"])
            small = placed.filter("small").select(*columns)
            merges.append(durable(small.groupBy("resolution").applyInPandas(_finish(threshold), "a long, b long").filter("a <> b"), "merges"))
            active = placed.filter("not small").select(*columns, "near")
        if not some.large:
            break
        if some.small:
            active = durable(active, "clusters")
        found = nearest(active.filter("near is null").select(*columns), active.select(*columns), 1, plan).filter(1.0 - F.col("sim") < threshold)
        near = durable(active.filter("near is not null").select("ord", "near").unionByName(found.select(F.col("q_ord").alias("ord"), F.col("g_ord").alias("near"))), "nearest")
        # A cluster, its nearest, the nearest of that, and of that: pairs merge that are each other's nearest.
        second, third = (near.select(F.col("ord").alias(x), F.col("near").alias(y)) for x, y in (("near", "_second"), ("_second", "_third")))
        links = near.join(second, "near").join(third, "_second").select(
            "ord", "near", (F.col("_second") == F.col("ord")).alias("merged"), (F.col("_third") == F.col("near")).alias("lost"))
        links = durable(links, "links")
        merges.append(links.filter("merged and ord < near").select(F.col("ord").alias("a"), F.col("near").alias("b")))
        # Without a merge (rounding can make a ring of equal distances) every nearest cluster is searched anew.
        known = F.when(~F.col("lost"), F.col("near")) if links.filter("merged").limit(1).count() else F.lit(None).cast("long")
        rows = active.drop("near").join(links, "ord").withColumn("_key", F.when(F.col("merged"), F.least("ord", "near")).otherwise(F.col("ord")))
        parts = rows.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(*columns, known.alias("near")))).alias("_p"))
        one, two = F.col("_p")[0], F.try_element_at("_p", F.lit(2))
        n = one["n"] + F.coalesce(two["n"], F.lit(0))
        mean = F.when(two.isNull(), one["emb"]).otherwise(F.zip_with(one["emb"], two["emb"], lambda x, y: (one["n"] * x + two["n"] * y) / n))
        active = durable(parts.select(
            F.col("_key").alias("ord"), one["resolution"].alias("resolution"), mean.alias("emb"), n.alias("n"), one["near"].alias("near")), "clusters")
    edges = merges[0]
    for more in merges[1:]:
        edges = edges.unionByName(more)
    label = components(start.select(F.col("ord").alias("id")), edges).select(F.col("id").alias("ord"), "label")
    named = start.join(label, "ord").select("resolution", "emb", "ord", "label")
    same = unit["resolution"].eqNullSafe(named["resolution"]) & (unit["emb"] == named["emb"])
    return unit.join(named, same).select(unit["ord"], named["label"].alias("first"))


def pseudo_cameras(frames: DataFrame, threshold: float = 0.35, task_clusters: int = TASK_CLUSTERS) -> DataFrame:
    """``ord, camera_id``: frames of one resolution with similar background share a camera.

    Cameras are the clusters of average linkage below the threshold, numbered by their first
    frame. ``frames`` has ord, resolution and emb.
    """
    found = durable(average_linkage(frames, threshold, task_clusters), "clusters")
    ids = running(found.select("first").distinct(), "first", "first").select("first", F.col("rank").cast("int").alias("camera_id"))
    return found.join(ids, "first").select("ord", "camera_id")
