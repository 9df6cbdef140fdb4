"""Annotation contract, result sinks, store atomicity and backups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbook.session import scratch_path
from matchbook.sources import annotations, results, store


def write(spark, text):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(line,) for line in text], "value string").coalesce(1).write.text(path)
    return path


def test_repeated_ids_get_line_keys_and_text_ids_are_numbered(spark):
    path = write(spark, ["image_id,x,y,w,h,vehicle_id", "img1,0,0,5,5,red", "img1,1,1,5,5,blue", "img2,0,0,5,5,red"])
    r = annotations.read_annotations(spark, path).orderBy("ord").collect()
    assert [x.key for x in r] == ["img1#0", "img1#1", "img2#2"]
    assert [x.vehicle_id for x in r] == [1, 2, 1] and [x.camera_id for x in r] == [0, 0, 0]


def test_numeric_cameras_shift_and_corner_boxes(spark):
    path = write(spark, ["image_id,x,y,w,h,vehicle_id,camera_id", "a,1,2,5,9,,0", "b,0,0,4,4,7,3"])
    r = annotations.read_annotations(spark, path, box_format="xyxy").orderBy("ord").collect()
    assert [(x.w, x.h, x.vehicle_id, x.camera_id) for x in r] == [(4.0, 7.0, -1, 1), (4.0, 4.0, 7, 4)]


@pytest.mark.parametrize("lines", [
    ["image_id,x,y,w,h", "a,0,0,5,5", "a,0,0,5,5"], ["image_id,x,y,w,h", " a,0,0,5,5"], ["image_id,x,y,w,h", "a,0,0,0,5"],
    ["image_id,x,x,w,h", "a,0,0,5,5"], ["image_id,x,y,w,h", "a,nan,0,5,5"],
])
def test_strict_mode_refuses(spark, lines):
    path = write(spark, lines)
    with pytest.raises(Exception):
        annotations.read_annotations(spark, path, strict=True).collect()


def top(spark, sims, q="q0"):
    return spark.createDataFrame([(0, q, f"g{i}", i + 1, float(s)) for i, s in enumerate(sims)], "q_ord long, q_key string, g_key string, pos int, sim double")


def test_refusal_is_the_absence_of_rows(spark):
    assert results.candidates(top(spark, [0.4, 0.3]), 0.5).count() == 0
    assert results.candidates(top(spark, [float("nan"), 0.9]), 0.5).count() == 0
    assert [r.gallery_id for r in results.candidates(top(spark, [0.9, 0.8]), 0.5).collect()] == ["g0"]
    counts = results.refusal_counts(top(spark, [float("nan"), 0.9]), results.candidates(top(spark, [float("nan"), 0.9]), 0.5)).first()
    assert (counts.n_refused, counts.n_nonfinite) == (1, 1)


def test_short_rankings_are_not_padded(spark):
    with pytest.raises(Exception, match="not enough distinct candidates"):
        results.ranking_table(top(spark, [0.9, 0.8]), 3).collect()


def item(spark, ids, bad=None, start=0):
    rng = np.random.default_rng(start)
    v = rng.normal(size=(len(ids), 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if bad == "norm":
        v[-1] *= 2
    return spark.createDataFrame([(i, n, 0.0, 0.0, 5.0, 5.0, [float(x) for x in e], "0" * 64) for i, (n, e) in enumerate(zip(ids, v))],
                                 "ord long, image_id string, x double, y double, w double, h double, emb array<float>, feature_ref string")


def test_store_is_all_or_nothing(spark):
    s = store.GalleryStore(spark, scratch_path(spark, "store"), 4, {"model": "m", "dimension": 4})
    assert s.add_many(item(spark, ["a", "b"])) == 1
    for batch in (item(spark, ["c", "c"]), item(spark, ["c", "a"]), item(spark, ["c", "../d"]), item(spark, ["c", "d"], bad="norm")):
        with pytest.raises(ValueError):
            s.add_many(batch)
    assert sorted(r.image_id for r in s.snapshot().collect()) == ["a", "b"]
    s.add_many(item(spark, ["c"], start=9))
    assert [r.image_id for r in s.page(0, 10).collect()] == ["a", "b", "c"]
    assert s.delete("b") and not s.delete("b")
    assert [r.image_id for r in s.page(0, 10).collect()] == ["a", "c"]
    assert s.snapshot(1).count() == 2
    with pytest.raises(ValueError, match="another model"):
        store.GalleryStore(spark, s.path, 4, {"model": "other", "dimension": 4})


def test_damaged_bundle_is_refused(spark):
    s = store.GalleryStore(spark, scratch_path(spark, "store"), 4)
    s.add_many(item(spark, ["a", "b"]))
    path = scratch_path(spark, "bundle")
    store.export_bundle(s.snapshot(), path)
    assert store.bundle_problems(spark, path).count() == 0
    spark.read.parquet(f"{path}/rows").withColumn("x", F.lit(9.0)).write.parquet(f"{path}/changed")
    broken = scratch_path(spark, "broken")
    spark.read.parquet(f"{path}/changed").write.parquet(f"{broken}/rows")
    spark.read.parquet(f"{path}/inventory").write.parquet(f"{broken}/inventory")
    target = store.GalleryStore(spark, scratch_path(spark, "target"), 4)
    with pytest.raises(ValueError, match="damaged"):
        store.restore_bundle(spark, broken, target)
    assert store.restore_bundle(spark, path, target) == 1


def test_import_needs_exactly_one_image_per_id(spark):
    files = spark.createDataFrame([("a/x.jpg", 1), ("b/x.png", 1), ("y.jpg", 1)], "path string, length long")
    with pytest.raises(Exception, match="invalid, repeated or has no single image"):
        store.resolve_import(spark.createDataFrame([("x",), ("y",)], "image_id string"), files).collect()
    assert store.resolve_import(spark.createDataFrame([("y",)], "image_id string"), files).count() == 1


def numbered(spark, n, start=0):
    return item(spark, [f"id{start + i}" for i in range(n)], start=start)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "image_id string")


def test_changes_write_only_what_changes(spark):
    s = store.GalleryStore(spark, scratch_path(spark, "store"), 4)
    for start in (0, 40, 50):
        s.add_many(numbered(spark, 40 if start == 0 else 10, start))
    assert s.delete("id41") and s.delete_many(ids(spark, "id3", "id55", "id55", "unknown")) == 2 and s.delete_many(ids(spark, "id3")) == 0
    log = [(r.operation, r.written, r.live) for r in s.history().orderBy("version").collect()]
    assert log == [("append", 40, 40), ("append", 10, 50), ("append", 10, 60), ("delete", 1, 59), ("delete", 2, 57)]
    before = sorted(map(tuple, s.snapshot().drop("emb").collect()))
    assert s.compact(small_rows=20) == 18  # the two small segments; the large one has one deleted row and stays
    assert sorted(map(tuple, s.snapshot().drop("emb").collect())) == before and [x.rows for x in s.manifest().segments] == [40, 18]
    assert s.compact(small_rows=20) == 0 and s.compact(small_rows=10, deleted_share=0.0) == 39 and s.manifest().vectors == ()
    assert sorted(map(tuple, s.snapshot().drop("emb").collect())) == before
    assert s.snapshot(1).count() == 40 and s.snapshot(4).count() == 59
    s.add_many(numbered(spark, 1, 90))
    assert s.snapshot().agg(F.max("sequence")).first()[0] == 61  # a number is never given twice


def test_pages_follow_sequence_ranges(spark, monkeypatch):
    s = store.GalleryStore(spark, scratch_path(spark, "store"), 4)
    for start in (0, 60):
        s.add_many(numbered(spark, 60, start))
    s.delete_many(ids(spark, *[f"id{i}" for i in range(0, 120, 7)]))
    want = [f"id{i}" for i in range(120) if i % 7]
    monkeypatch.setattr(store, "PAGE_ROWS", 4)
    monkeypatch.setattr(store, "PAGE_SLICES", 5)
    for offset, limit in ((0, 3), (40, 25), (99, 10), (101, 10), (102, 5), (500, 5), (0, 200)):
        assert [r.image_id for r in s.page(offset, limit).collect()] == want[offset : offset + limit]
    with pytest.raises(ValueError):
        s.page(-1, 5)


def test_readers_never_see_half_a_version_and_writers_take_turns(spark):
    s = store.GalleryStore(spark, scratch_path(spark, "store"), 4, {"model": "m"})
    s.add_many(numbered(spark, 3))
    fs, path = s._fs()
    out = fs.create(path(f"{s.path}/log/half.tmp"), False)  # a writer that died before its rename
    out.close()
    assert s.version == 1 and s.snapshot().count() == 3
    held = s._claim()
    assert held.version == 1
    with pytest.raises(RuntimeError, match="another writer"):
        s.add_many(numbered(spark, 1, 9))
    s.release()
    assert s.add_many(numbered(spark, 1, 9)) == 2 and s.snapshot().count() == 4
    assert s.delete_many(ids(spark, *[r.image_id for r in s.snapshot().collect()])) == 4
    assert s.snapshot().count() == 0 and s.page(0, 5).count() == 0 and s.manifest().segments == ()
    s.add_many(numbered(spark, 2, 20))
    assert s.vacuum(keep=1) == 3 and [r.sequence for r in s.snapshot().orderBy("sequence").collect()] == [5, 6]
    for identity in ({"model": "other"}, {}, None):
        with pytest.raises(ValueError, match="another model"):
            store.GalleryStore(spark, s.path, 4, identity)


def test_a_populated_store_without_identity_is_refused(spark):
    s = store.GalleryStore(spark, scratch_path(spark, "store"), 4)
    s.add_many(numbered(spark, 2))
    with pytest.raises(ValueError, match="another model"):
        store.GalleryStore(spark, s.path, 4, {"model": "m"})
    assert store.GalleryStore(spark, s.path, 4).snapshot().count() == 2
