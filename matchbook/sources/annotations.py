"""Annotation tables, image listings and training lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.functions.text import digits_only, stem
from matchbook.operators.ranks import running

DEFAULT_COLUMNS = {"image_id": "image_id", "x": "x", "y": "y", "w": "w", "h": "h", "vehicle_id": "vehicle_id", "camera_id": "camera_id"}


def with_line_number(df: DataFrame) -> DataFrame:
    """Add ``line`` (from 0): the row's position in its files, in file order.

    Rows are numbered inside each file block; block totals give the offsets, so no
    task sees more than one block.
    """
    rows = df.select(
        "*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    block = Window.partitionBy("_f", "_b").orderBy("_m")
    sizes = rows.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (
        rows.withColumn("_r", F.row_number().over(block)).join(offsets, ["_f", "_b"])
        .withColumn("line", F.col("_o") + F.col("_r") - 1).drop("_f", "_b", "_m", "_r", "_o", "_n")
    )


def box_problem(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Why a box is unusable, or NULL."""
    bad = F.lit(False)
    for c in (x, y, w, h):
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, "not_finite").when((w <= 0) | (h <= 0), "not_positive")


def dense_codes(df: DataFrame, raw: str, order: str, out: str) -> DataFrame:
    """Number text values 1, 2, ... by first appearance."""
    first = df.filter(F.col(raw).isNotNull()).groupBy(raw).agg(F.min(order).alias("_first"))
    codes = running(first, "_first", "_first").select(raw, F.col("rank").alias(out))
    return df.join(codes, raw, "left")


def read_annotations(spark: SparkSession, path: str, columns: dict | None = None, box_format: str = "xywh",
                     strict: bool = False) -> DataFrame:
    """Annotation CSV as observations.

    The key is the image id, or ``image_id#line`` if any image id repeats in the file.
    Blank identities become -1. Numeric cameras are shifted by one because 0 means
    unknown; text cameras are numbered by first appearance. ``strict`` refuses repeated
    headers, short rows, blank, padded or repeated ids and unusable boxes.
    """
    if box_format not in ("xywh", "xyxy"):
        raise ValueError("box_format must be xywh or xyxy")
    names = {**DEFAULT_COLUMNS, **(columns or {})}
    header = spark.read.text(path).limit(1).first()[0].lstrip("﻿").split(",")
    if strict and (len(set(header)) != len(header) or not {names[c] for c in ("image_id", "x", "y", "w", "h")} <= set(header)):
        raise ValueError("annotation file needs unique headers including image_id, x, y, w, h")
    schema = ", ".join(f"`{h}` string" for h in header)
    raw = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST" if strict else "PERMISSIVE", enforceSchema=False)
    rows = with_line_number(raw)
    col = lambda n: F.col(names[n])
    num = lambda n: F.expr(f"try_cast(`{names[n]}` as double)")
    x, y = num("x"), num("y")
    w, h = (num("w"), num("h")) if box_format == "xywh" else (num("w") - x, num("h") - y)
    rows = rows.select(
        F.col("line").alias("ord"), col("image_id").alias("image_id"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"),
        (F.trim(col("vehicle_id")) if names["vehicle_id"] in header else F.lit(None).cast("string")).alias("_vid"),
        (F.trim(col("camera_id")) if names["camera_id"] in header else F.lit(None).cast("string")).alias("_cam"))
    rows = rows.withColumn("_vt", F.when(F.expr("try_cast(_vid as double)").isNull() & (F.col("_vid") != ""), F.col("_vid")))
    rows = rows.withColumn("_ct", F.when(F.expr("try_cast(_cam as double)").isNull() & (F.col("_cam") != ""), F.col("_cam")))
    rows = dense_codes(dense_codes(rows, "_vt", "ord", "_vcode"), "_ct", "ord", "_ccode")
    vid = F.coalesce(F.expr("cast(try_cast(_vid as double) as bigint)"), F.col("_vcode"), F.lit(-1)).cast("long")
    cam = F.coalesce(F.expr("cast(try_cast(_cam as double) as int) + 1"), F.col("_ccode"), F.lit(0)).cast("int")
    # An id that repeats anywhere makes every key carry its line.
    repeats = rows.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).agg((F.max("_n") > 1).alias("r")).scalar()
    out = rows.withColumn("problem", box_problem(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).withColumn("_rep", repeats)
    out = out.withColumn("key", F.when(F.col("_rep"), F.concat_ws("#", "image_id", F.col("ord").cast("string"))).otherwise(F.col("image_id")))
    if strict:
        wrong = F.coalesce(F.trim("image_id") != F.col("image_id"), F.lit(True)) | (F.col("image_id") == "") | F.col("_rep") | F.col("problem").isNotNull()
        out = out.withColumn("key", F.when(wrong, F.raise_error(F.concat(F.lit("unusable annotation row "), F.col("ord").cast("string")))).otherwise(F.col("key")))
    return out.select("ord", "image_id", "key", "x", "y", "w", "h", vid.alias("vehicle_id"), cam.alias("camera_id"), "problem")


def parse_names(files: DataFrame, pattern: str, strict: bool = False) -> DataFrame:
    """Identity and camera from file names by a pattern with groups ``vid`` and ``cam``.

    ``files`` has ``path``. Names that do not match are dropped, or fail if ``strict``.
    """
    groups = [g for g in ("vid", "cam") if f"(?P<{g}>" in pattern]
    order = {g: i + 1 for i, g in enumerate(sorted(groups, key=lambda g: pattern.index(f"(?P<{g}>")))}
    java = pattern.replace("(?P<", "(?<")
    name = F.substring_index("path", "/", -1)
    rows = files.withColumn("_name", name).withColumn("_ok", F.col("_name").rlike(java))
    if strict:
        rows = rows.withColumn("_ok", F.when(F.col("_ok"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("file name does not match: "), F.col("_name"))).cast("boolean")))
    part = lambda g: digits_only(F.regexp_extract("_name", java, order[g])) if g in order else F.lit(0).cast("long")
    return rows.filter("_ok").select("path", part("vid").alias("vehicle_id"), part("cam").cast("int").alias("camera_id"))


def resolve_images(ids: DataFrame, files: DataFrame) -> DataFrame:
    """Match image ids to files: exact path, then file name, stem, and the same in lower case.

    ``files`` has ``path`` relative to the image folder. Adds ``path`` and ``status``:
    ok, missing, ambiguous (several files at the best level) or escape (leaves the folder).
    """
    base = F.substring_index("path", "/", -1)
    form = lambda level, c: F.struct(F.lit(level).alias("level"), c.alias("form"))
    forms = F.array(
        form(0, F.col("path")), form(1, F.regexp_replace("path", r"\.[^./]*$", "")), form(2, base), form(3, stem(F.col("path"))),
        form(4, F.lower(base)), form(5, F.lower(stem(F.col("path")))))
    index = files.select("path", F.explode(forms).alias("_f")).select("path", "_f.level", "_f.form").distinct()
    wanted = F.array(
        *[form(i, F.col("image_id")) for i in range(4)],
        *[form(i, F.lower(F.substring_index("image_id", "/", -1))) for i in (4, 5)])
    tried = ids.select("image_id", F.explode(wanted).alias("_w")).select("image_id", "_w.level", "_w.form")
    found = tried.join(index, ["level", "form"]).groupBy("image_id", "level").agg(
        F.min("path").alias("path"), F.countDistinct("path").alias("n"))
    best = found.groupBy("image_id").agg(F.min_by(F.struct("path", "n"), "level").alias("_b"))
    escape = F.col("image_id").startswith("/") | F.array_contains(F.split("image_id", r"[/\\]"), "..")
    status = F.when(escape, "escape").when(F.col("_b").isNull(), "missing").when(F.col("_b.n") > 1, "ambiguous").otherwise("ok")
    return ids.join(best, "image_id", "left").withColumn("status", status).withColumn(
        "path", F.when(F.col("status") == "ok", F.col("_b.path"))).drop("_b")


def read_training_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated list of ready crops (path, identity, camera, width, height); short rows are dropped."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).withColumn("c", cells).filter(F.size("c") >= 5)
    at = lambda i, t: F.element_at("c", i).cast(t)
    return rows.select(
        at(1, "string").alias("path"), at(2, "long").alias("vehicle_id"), at(3, "int").alias("camera_id"),
        F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), at(4, "double").alias("w"), at(5, "double").alias("h"))


def write_split(df: DataFrame, path: str) -> None:
    """Split as CSV, in row order."""
    df.select("ord", "path", "vehicle_id", "camera_id", "x", "y", "w", "h", "key").write.csv(path, header=True)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    schema = "ord long, path string, vehicle_id long, camera_id int, x double, y double, w double, h double, key string"
    return spark.read.csv(path, schema=schema, header=True)
