"""Box geometry, mask boxes and cell grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.functions.text import seeded_order
from matchbook.session import durable

#: Fixed values of mask-box selection and cell grouping.
FALLBACK_BAND = (0.22, 0.62, 0.78, 0.93)
LIFT = 0.35
SIZE_TOLERANCE = 0.28
GAP_TOLERANCE = 0.8
MIN_CELLS = 3
PADDING = 0.06


def integer(c: Column) -> Column:
    return c.cast("long")


def half_even(c: Column) -> Column:
    return F.rint(c).cast("long")


def padded_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float) -> Column:
    """Crop rectangle (x0, y0, x1, y1) padded by pad * max(w, h) and clipped to the image.

    A box wholly outside the image is moved to the nearest one-pixel strip inside it.
    """
    p = pad * F.greatest(w, h)
    zero = F.lit(0).cast("long")
    x0, y0 = F.greatest(zero, half_even(x - p)), F.greatest(zero, half_even(y - p))
    x1, y1 = F.least(width, half_even(x + w + p)), F.least(height, half_even(y + h + p))
    outside = (x1 <= x0) | (y1 <= y0)
    cx, cy = F.least(x0, width - 1), F.least(y0, height - 1)
    pick = lambda moved, kept: F.when(outside, moved).otherwise(kept)
    return F.struct(
        pick(cx, x0).alias("x0"), pick(cy, y0).alias("y0"),
        pick(F.greatest(cx + 1, F.least(width, x1)), x1).alias("x1"), pick(F.greatest(cy + 1, F.least(height, y1)), y1).alias("y1"),
        outside.alias("outside"))


def cached_crop(x: Column, y: Column, w: Column, h: Column, pad: float = 0.30) -> Column:
    """Origin of a stored crop (truncated, not rounded) and the box position inside it."""
    p = pad * F.greatest(w, h)
    zero = F.lit(0).cast("long")
    x0, y0 = F.greatest(zero, integer(x - p)), F.greatest(zero, integer(y - p))
    return F.struct(x0.alias("x0"), y0.alias("y0"), (x - x0).alias("rel_x"), (y - y0).alias("rel_y"))


def cache_key(stem: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.concat(stem, F.lit(":"), F.concat_ws(",", *[half_even(c).cast("string") for c in (x, y, w, h)]))


def mask_boxes(found: Column, mode: str, seed: int = 0, key: Column | None = None) -> Column:
    """Boxes (fractions x, y, w, h) to cover in one of the modes det, auto, band, up, rand.

    ``up`` and ``rand`` are controls: the same boxes elsewhere, only where boxes were found.
    """
    x0, y0, x1, y1 = FALLBACK_BAND
    band = F.array(F.array(F.lit(x0), F.lit(y0), F.lit(x1) - F.lit(x0), F.lit(y1) - F.lit(y0)))
    none = F.array().cast("array<array<double>>")
    found = F.coalesce(found, none)
    if mode == "band":
        return band
    if mode == "det":
        return found
    if mode == "auto":
        return F.when(F.size(found) > 0, found).otherwise(band)
    if mode == "up":
        return F.transform(found, lambda b: F.array(b[0], F.greatest(F.lit(0.0), b[1] - LIFT), b[2], b[3]))
    if mode == "rand":
        draw = lambda i, n: seeded_order(seed, key, i, F.lit(n)) / F.lit(4294967296.0)
        return F.transform(found, lambda b, i: F.array(draw(i, 0) * (1 - b[2]), draw(i, 1) * (1 - b[3]), b[2], b[3]))
    raise ValueError(f"unknown mask mode {mode}")


def near_cells(cells: DataFrame) -> DataFrame:
    """Pairs of cells of one crop with similar size and a small gap: ``a, b`` with a < b.

    ``cells`` has id, crop, x, y, w, h. Cells meet only in a grid whose pitch grows with
    cell size, so a crop with very many cells is compared locally, not all against all.
    """
    base = 1.0 / (1.0 - SIZE_TOLERANCE)
    level = F.floor(F.log(F.col("w").cast("double")) / F.log(F.lit(base))).cast("int")
    pitch = lambda lv: (1.0 + GAP_TOLERANCE) * F.pow(F.lit(base), lv + 2)
    c = cells.withColumn("_lv", level)
    home = c.select(
        *[F.col(k).alias("b_" + k) for k in ("id", "x", "y", "w", "h")], F.col("crop"), F.col("_lv"),
        F.floor(F.col("x") / pitch(F.col("_lv"))).alias("_gx"), F.floor(F.col("y") / pitch(F.col("_lv"))).alias("_gy"))
    near = lambda n: F.explode(F.sequence(F.lit(-1), F.lit(1))).alias(n)
    probe = c.select("*", near("_dl")).select("*", near("_dx")).select("*", near("_dy"))
    lv = F.col("_lv") + F.col("_dl")
    probe = probe.select(
        *[F.col(k).alias("a_" + k) for k in ("id", "x", "y", "w", "h")], F.col("crop"), lv.alias("_lv"),
        (F.floor(F.col("x") / pitch(lv)) + F.col("_dx")).alias("_gx"), (F.floor(F.col("y") / pitch(lv)) + F.col("_dy")).alias("_gy"))
    a, b = (lambda k: F.col("a_" + k)), (lambda k: F.col("b_" + k))
    mw, mh = F.greatest(a("w"), b("w")), F.greatest(a("h"), b("h"))
    gap = lambda p, s: F.greatest(F.lit(0), F.greatest(a(p), b(p)) - F.least(a(p) + a(s), b(p) + b(s)))
    ok = (
        (a("id") < b("id")) & (F.abs(a("w") - b("w")) <= SIZE_TOLERANCE * mw) & (F.abs(a("h") - b("h")) <= SIZE_TOLERANCE * mh)
        & (gap("x", "w") <= GAP_TOLERANCE * mw) & (gap("y", "h") <= GAP_TOLERANCE * mh)
    )
    return probe.join(home, ["crop", "_lv", "_gx", "_gy"]).filter(ok).select(a("id").alias("a"), b("id").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: ``id, label`` with the smallest id of each component as label.

    Each round takes the smallest label among neighbours and then jumps to the label's
    own label, so long chains halve; every round is stored, which bounds the lineage. Rounds go
    on until no label changes.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")), "component-edges")
    labels = durable(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_m"))
        step = labels.join(around, "id", "left").select("id", F.col("label").alias("_old"), F.least("label", F.coalesce("_m", "label")).alias("_new"))
        jump = labels.select(F.col("id").alias("_new"), F.col("label").alias("_jump"))
        new = durable(step.join(jump, "_new").select("id", "_old", F.least("_new", "_jump").alias("label")), "labels")
        changed = new.filter(F.col("_old") != F.col("label")).limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def enclosing_boxes(cells: DataFrame, width: int, height: int) -> DataFrame:
    """Padded box around every group of at least three cells: ``crop, label, x, y, w, h, n``."""
    cells = durable(cells, "cells")
    groups = components(cells, near_cells(cells))
    g = cells.join(groups, "id").groupBy("crop", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"),
        F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1")).filter(F.col("n") >= MIN_CELLS)
    px, py = integer(PADDING * (F.col("x1") - F.col("x0"))) + 1, integer(PADDING * (F.col("y1") - F.col("y0"))) + 1
    left, top = F.greatest(F.lit(0), F.col("x0") - px), F.greatest(F.lit(0), F.col("y0") - py)
    return g.select(
        "crop", "label", left.alias("x"), top.alias("y"), (F.least(F.lit(width), F.col("x1") + px) - left).alias("w"),
        (F.least(F.lit(height), F.col("y1") + py) - top).alias("h"), "n")
