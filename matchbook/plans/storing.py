"""Source, sink and gallery-store queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions.vectors import all_finite
from matchbook.model import gallery_side, observations, query_side, table
from matchbook.operators.similarity import nearest
from matchbook.plans.registry import query, with_ctes
from matchbook.plans.searching import THRESHOLD, r6, sides
from matchbook.session import durable, scratch_path
from matchbook.sources import annotations, results, store


def csv_of(df: DataFrame, name: str, **options) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.csv(path, **options)
    return path


# ---- readers ---------------------------------------------------------------------------------

ANN = """SELECT vec_id // 2 AS pic, row_number() OVER (ORDER BY vec_id) - 1 AS ord, vec_id,
         CASE WHEN label = 0 THEN '' WHEN label < 5 THEN label::VARCHAR ELSE 'v' || label END AS vid, 'cam' || (9 - vec_id % 4) AS cam FROM embeddings"""


@query("s1_read_annotations", f"""
WITH a AS ({ANN}), vc AS (SELECT vid, row_number() OVER (ORDER BY min(ord)) AS c FROM a WHERE vid LIKE 'v%' GROUP BY vid),
cc AS (SELECT cam, row_number() OVER (ORDER BY min(ord)) AS c FROM a GROUP BY cam)
SELECT a.ord, 'img' || pic AS image_id, 'img' || pic || '#' || a.ord AS key, coalesce(try_cast(a.vid AS BIGINT), vc.c, -1) AS vehicle_id,
       cc.c::INTEGER AS camera_id, (180+(vec_id*17)%400)::DOUBLE AS w, CASE WHEN vec_id % 50 = 7 THEN 'not_positive' END AS problem
FROM a LEFT JOIN vc ON vc.vid = a.vid JOIN cc ON cc.cam = a.cam""")
def s1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v, label = F.col("vec_id"), F.col("label")
    rows = e.select(
        v, F.concat(F.lit("img"), F.expr("vec_id div 2").cast("string")).alias("image_id"), ((v * 37) % 900).alias("x"), ((v * 53) % 500).alias("y"),
        (180 + (v * 17) % 400).alias("w"), F.when(v % 50 == 7, -1).otherwise(140 + (v * 29) % 300).alias("h"),
        F.when(label == 0, "").when(label < 5, label.cast("string")).otherwise(F.concat(F.lit("v"), label.cast("string"))).alias("vehicle_id"),
        F.concat(F.lit("cam"), (9 - v % 4).cast("string")).alias("camera_id"))
    path = csv_of(rows.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").drop("vec_id"), "annotations", header=True, emptyValue="")
    return annotations.read_annotations(spark, path).select("ord", "image_id", "key", "vehicle_id", "camera_id", "w", "problem")


def file_list(spark, sf_dir) -> DataFrame:
    """Image paths derived from the observations, some in subfolders, some repeated or upper-case."""
    o = observations(spark, sf_dir)
    name = F.concat(F.lit("im_"), F.col("ord").cast("string"), F.lit("_v"), F.col("vehicle_id").cast("string"), F.lit("_c"), F.col("camera_id").cast("string"))
    ext = F.when(F.col("ord") % 10 == 4, ".JPG").otherwise(".jpg")
    folder = F.when(F.col("ord") % 3 == 0, "a/").when(F.col("ord") % 3 == 1, "b/").otherwise("")
    first = o.select("ord", F.concat(folder, name, ext).alias("path"))
    again = o.filter("ord % 20 = 3").select("ord", F.concat(F.lit("copy/"), name, ext).alias("path"))
    return first.union(again)


FILES = """SELECT vec_id AS ord, CASE WHEN vec_id%3=0 THEN 'a/' WHEN vec_id%3=1 THEN 'b/' ELSE '' END || 'im_' || vec_id || '_v' || label || '_c' || (vec_id%4+1) ||
           CASE WHEN vec_id%10=4 THEN '.JPG' ELSE '.jpg' END AS path FROM embeddings
           UNION ALL SELECT vec_id, 'copy/im_' || vec_id || '_v' || label || '_c' || (vec_id%4+1) || CASE WHEN vec_id%10=4 THEN '.JPG' ELSE '.jpg' END FROM embeddings WHERE vec_id % 20 = 3"""


@query("s2_resolve_images", with_ctes("o", """
SELECT image_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN n = 1 THEN path END AS path FROM (
  SELECT image_id, any_value(path) AS path, count(path) AS n FROM i LEFT JOIN f ON lower(split_part(f.path, '/', -1)) = lower(image_id) || '.jpg' GROUP BY image_id)""",
    f=FILES, i="SELECT 'IM_' || ord || '_v' || CASE WHEN ord % 25 = 1 THEN 99 ELSE vehicle_id END || '_c' || camera_id AS image_id FROM o"))
def s2(spark, sf_dir):
    vid = F.when(F.col("ord") % 25 == 1, F.lit(99)).otherwise(F.col("vehicle_id"))
    ids = observations(spark, sf_dir).select(F.concat(
        F.lit("IM_"), F.col("ord").cast("string"), F.lit("_v"), vid.cast("string"), F.lit("_c"), F.col("camera_id").cast("string")).alias("image_id"))
    return annotations.resolve_images(ids, file_list(spark, sf_dir).select("path")).select("image_id", "status", "path")


@query("s3_parse_file_names", f"""
WITH f AS ({FILES}) SELECT path, regexp_extract(path, '_v([0-9]+)_c([0-9]+)', 1)::BIGINT AS vehicle_id, regexp_extract(path, '_v([0-9]+)_c([0-9]+)', 2)::INTEGER AS camera_id
FROM f WHERE path LIKE '%.jpg'""")
def s3(spark, sf_dir):
    return annotations.parse_names(file_list(spark, sf_dir), r"_v(?P<vid>\d+)_c(?P<cam>\d+)\.jpg$")


@query("s4_dataset_of_splits", with_ctes("o q g", """
SELECT split, count(*) AS n, count(DISTINCT vehicle_id) AS n_ids, min(ord) AS first_ord FROM (
  SELECT 'query' AS split, * FROM q UNION ALL SELECT 'gallery', * FROM g UNION ALL SELECT 'fit', * FROM o WHERE vehicle_id >= 8) GROUP BY split"""))
def s4(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    named = {"query": q, "gallery": g, "fit": observations(spark, sf_dir).filter("vehicle_id >= 8"), "absent": None}
    return dataset(named).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vehicle_id").alias("n_ids"), F.min("ord").alias("first_ord"))


def dataset(named: dict) -> DataFrame:
    """Several splits as one table; missing ones are skipped, query and gallery are required."""
    present = {k: v for k, v in named.items() if v is not None}
    if not {"query", "gallery"} <= set(present):
        raise ValueError("a dataset needs query and gallery")
    out = None
    for name, df in present.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("s5_split_csv_round_trip", with_ctes("o q", "SELECT ord, 'p/' || frame || '.jpg' AS path, vehicle_id, camera_id, x, y, w, h, key FROM q"))
def s5(spark, sf_dir):
    q = query_side(spark, sf_dir).withColumn("path", F.concat(F.lit("p/"), F.col("frame"), F.lit(".jpg")))
    path = scratch_path(spark, "split")
    annotations.write_split(q, path)
    return annotations.read_split(spark, path)


@query("s6_embedding_pack_round_trip", with_ctes("o q", """
SELECT ord, key, vehicle_id, camera_id, 64::INTEGER AS dim, round(list_sum(e), 6) AS total FROM q JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v ON v.vec_id = q.ord"""))
def s6(spark, sf_dir):
    pack = durable(query_side(spark, sf_dir).select("ord", "key", "vehicle_id", "camera_id", "emb"), "pack")
    total = F.aggregate(F.col("emb").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return pack.select("ord", "key", "vehicle_id", "camera_id", F.size("emb").alias("dim"), F.round(total, 6).alias("total"))


@query("s7_pack_checks", with_ctes("o", """
SELECT count(*) AS n, count(*) - count(DISTINCT key) AS repeated_keys, count(*) FILTER (len(emb) <> 64) AS wrong_dim, 0::BIGINT AS not_finite,
       count(DISTINCT frame) AS n_frames FROM o"""))
def s7(spark, sf_dir):
    o = observations(spark, sf_dir)
    bad = lambda c: F.sum(c.cast("long"))
    return o.agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct("key")).alias("repeated_keys"), bad(F.size("emb") != 64).alias("wrong_dim"),
        bad(~all_finite(F.col("emb").cast("array<double>"))).alias("not_finite"), F.countDistinct("frame").alias("n_frames"))


@query("s8_embedding_export", with_ctes("o q g", """
SELECT side, ord, key, (row_number() OVER (ORDER BY side, ord) - 1) AS row_index FROM (SELECT 0 AS side, ord, key FROM q UNION ALL SELECT 1, ord, key FROM g)"""))
def s8(spark, sf_dir):
    from matchbook.operators.ranks import running
    out = results.embedding_export(*sides(spark, sf_dir))
    return running(out.filter(F.size("emb") > 0).select("side", "ord", "key"), "side", "ord").select("side", "ord", "key", (F.col("rank") - 1).alias("row_index"))


def keyed_top(spark, sf_dir, k=10):
    return nearest(*sides(spark, sf_dir), k, q_carry=["key"], g_carry=["key"])


@query("s9_ranking_table", with_ctes("o q g p r", """
SELECT q_ord, q_key AS query_id, max(g_key) FILTER (pos = 1) AS g1, max(g_key) FILTER (pos = 2) AS g2, max(g_key) FILTER (pos = 3) AS g3 FROM r WHERE pos <= 3 GROUP BY ALL"""))
def s9(spark, sf_dir):
    return results.ranking_table(keyed_top(spark, sf_dir, 3), 3)


CAND = f"""SELECT q_ord, q_key AS query_id, g_key AS gallery_id, round(sim, 5) AS confidence FROM (
  SELECT *, max(CASE WHEN pos = 1 THEN sim END) OVER (PARTITION BY q_ord) AS d FROM r WHERE pos <= 2) WHERE d >= {THRESHOLD}"""


@query("s10_candidate_table", with_ctes("o q g p r", CAND))
def s10(spark, sf_dir):
    return results.candidates(keyed_top(spark, sf_dir), THRESHOLD, 2)


@query("s10_candidates_with_floor", with_ctes("o q g p r", f"""
SELECT q_ord, q_key AS query_id, g_key AS gallery_id, round(sim, 5) AS confidence FROM (
  SELECT *, max(CASE WHEN pos = 1 THEN sim END) OVER (PARTITION BY q_ord) AS d FROM r WHERE pos <= 10) WHERE d >= {THRESHOLD} AND sim >= 0.33"""))
def s10_floor(spark, sf_dir):
    return results.candidates(keyed_top(spark, sf_dir), THRESHOLD, 10, min_sim=0.33)


@query("s10_refusal_counts", with_ctes("o q g p r", f"""
SELECT count(*) AS n_query, count(*) FILTER (sim < {THRESHOLD}) AS n_refused, 0::BIGINT AS n_nonfinite FROM r WHERE pos = 1"""))
def s10_counts(spark, sf_dir):
    top = durable(keyed_top(spark, sf_dir), "top")
    return results.refusal_counts(top, results.candidates(top, THRESHOLD))


@query("s11_ranking_reader", with_ctes("o q g p r", "SELECT q_key AS query_id, pos::INTEGER AS pos, g_key AS gallery_id FROM r WHERE pos <= 10"))
def s11(spark, sf_dir):
    path = scratch_path(spark, "ranking")
    results.write_ranking(results.ranking_table(keyed_top(spark, sf_dir), 10), path)
    spark.range(1).selectExpr("concat_ws(',', 'query_id', 'g1') as value").write.mode("append").text(path)  # a legacy header row
    return results.read_ranking(spark, path, 10)


@query("s12_candidate_reader", with_ctes("o q g p r", f"SELECT q_key AS query_id, g_key AS gallery_id, round(sim, 5) AS confidence FROM r WHERE pos = 1 AND sim >= {THRESHOLD}"))
def s12(spark, sf_dir):
    path = scratch_path(spark, "candidates")
    results.write_candidates(results.candidates(keyed_top(spark, sf_dir), THRESHOLD), path)
    return results.read_candidates(spark, path)


@query("a14_emitted_outcome_audit", with_ctes("o q g p r d", f"""
SELECT count(*) FILTER (acc AND has_match AND ok) AS tp, count(*) FILTER (acc AND NOT (has_match AND ok)) AS fp,
       count(*) FILTER (NOT acc AND has_match) AS fn, count(*) FILTER (NOT acc AND NOT has_match) AS tn FROM (
  SELECT has_match, conf >= {THRESHOLD} AS acc, correct AS ok FROM d)"""))
def a14(spark, sf_dir):
    """Outcomes recomputed from the rows that were really written."""
    from matchbook.operators import refusal, search
    q, g = sides(spark, sf_dir)
    path = scratch_path(spark, "candidates")
    results.write_candidates(results.candidates(keyed_top(spark, sf_dir), THRESHOLD, 3), path)
    best = results.read_candidates(spark, path).groupBy(F.col("query_id").alias("key")).agg(F.max_by("gallery_id", "confidence").alias("gallery_id"))
    labels = g.select(F.col("key").alias("gallery_id"), F.col("vehicle_id").alias("_gv"))
    j = search.with_match_flag(q, g).join(best, "key", "left").join(labels, "gallery_id", "left")
    rows = j.withColumn("correct", F.coalesce(F.col("_gv") == F.col("vehicle_id"), F.lit(False)))
    return refusal.confusion(rows, F.col("gallery_id").isNotNull()).select("tp", "fp", "fn", "tn")


@query("s13_training_list", with_ctes("o", "SELECT 'c/' || ord || '.jpg' AS path, vehicle_id, camera_id, w, h FROM o WHERE ord % 9 <> 0"))
def s13(spark, sf_dir):
    o = observations(spark, sf_dir)
    full = F.concat_ws("\t", F.concat(F.lit("c/"), F.col("ord").cast("string"), F.lit(".jpg")), *[F.col(c).cast("int").cast("string") for c in ("vehicle_id", "camera_id", "w", "h")])
    lines = o.select(F.when(F.col("ord") % 9 == 0, F.lit("short\trow")).otherwise(full).alias("value"))
    path = scratch_path(spark, "list")
    lines.write.text(path)
    return annotations.read_training_list(spark, path).select("path", "vehicle_id", "camera_id", "w", "h")


# ---- store -----------------------------------------------------------------------------------

def items(df: DataFrame) -> DataFrame:
    return df.select("ord", F.regexp_replace("key", "#", "-").alias("image_id"), "x", "y", "w", "h", "emb",
                     F.sha2(F.concat(F.lit("feat:"), F.col("key")), 256).alias("feature_ref"))


def filled_store(spark, sf_dir) -> store.GalleryStore:
    """A store built in two appends of the gallery side."""
    g = gallery_side(spark, sf_dir)
    s = store.GalleryStore(spark, scratch_path(spark, "store"), 64, {"model": "m1", "recipe": "r1", "dimension": 64})
    s.add_many(items(g.filter("ord % 2 = 0")))
    s.add_many(items(g.filter("ord % 2 = 1")))
    return s


STORE = """SELECT replace(key, '#', '-') AS image_id, x, y, w, h, ord,
           CASE WHEN ord % 2 = 0 THEN row_number() OVER (PARTITION BY ord % 2 ORDER BY ord)
                ELSE row_number() OVER (PARTITION BY ord % 2 ORDER BY ord) + (SELECT count(*) FROM g WHERE ord % 2 = 0) END AS sequence FROM g"""


@query("s14_append_batches", with_ctes("o g", "SELECT sequence, image_id, x, w FROM s", s=STORE))
def s14(spark, sf_dir):
    return filled_store(spark, sf_dir).snapshot().select("sequence", "image_id", "x", "w")


@query("s14_batch_problems", with_ctes("o", """
SELECT ord, CASE WHEN ord % 11 = 0 THEN 'image_id' WHEN ord % 13 = 0 THEN 'box' WHEN ord % 17 = 0 THEN 'norm' END AS problem FROM o WHERE ord % 11 = 0 OR ord % 13 = 0 OR ord % 17 = 0"""))
def s14_bad(spark, sf_dir):
    o = items(observations(spark, sf_dir))
    broken = o.withColumn("image_id", F.when(F.col("ord") % 11 == 0, F.lit("a/b")).otherwise(F.col("image_id"))).withColumn(
        "w", F.when(F.col("ord") % 13 == 0, 0.0).otherwise(F.col("w"))).withColumn(
        "emb", F.when(F.col("ord") % 17 == 0, F.transform("emb", lambda x: x * 2)).otherwise(F.col("emb")))
    return store.item_problems(broken, 64).filter("problem is not null").select("ord", "problem")


@query("s15_snapshot_in_order", with_ctes("o g", "SELECT sequence, image_id, round(emb[1], 4) AS first_value FROM s JOIN (SELECT ord AS k, emb FROM g) x ON x.k = s.ord", s=STORE))
def s15(spark, sf_dir):
    return filled_store(spark, sf_dir).snapshot().orderBy("sequence").select("sequence", "image_id", F.round(F.element_at("emb", 1).cast("double"), 4).alias("first_value"))


@query("s16_point_lookup", with_ctes("o q g", """
SELECT replace(o.key, '#', '-') AS image_id, g.ord IS NOT NULL AS stored, g.x, g.w FROM o LEFT JOIN g ON g.ord = o.ord WHERE o.ord % 7 = 0"""))
def s16(spark, sf_dir):
    wanted = items(observations(spark, sf_dir).filter("ord % 7 = 0")).select("image_id")
    rows = filled_store(spark, sf_dir).snapshot().select("image_id", F.lit(True).alias("stored"), "x", "w")
    return wanted.join(rows, "image_id", "left").fillna(False, ["stored"])


@query("s17_paging", with_ctes("o g", "SELECT image_id, x, y FROM s WHERE sequence > 40 AND sequence <= 65", s=STORE))
def s17(spark, sf_dir):
    return filled_store(spark, sf_dir).page(40, 25).select("image_id", "x", "y")


@query("s18_delete_one", with_ctes("o g", "SELECT count(*) AS n, true AS was_there, min(sequence) AS first_sequence FROM s WHERE sequence <> 1", s=STORE))
def s18(spark, sf_dir):
    s = filled_store(spark, sf_dir)
    there = s.delete(s.page(0, 1).first()["image_id"])
    return s.snapshot().agg(F.count(F.lit(1)).alias("n"), F.lit(there).alias("was_there"), F.min("sequence").alias("first_sequence"))


def changed_store(spark, sf_dir) -> store.GalleryStore:
    """The filled store after a delete of every ninth observation, a compaction and one more delete."""
    s = filled_store(spark, sf_dir)
    g = items(gallery_side(spark, sf_dir))
    s.delete_many(g.filter("ord % 9 = 1"))
    s.compact()
    s.delete_many(g.filter("ord % 9 = 4"))
    return s


@query("s14_change_log", with_ctes("o g", """
SELECT 1::BIGINT AS version, 'append' AS operation, (SELECT count(*) FROM g WHERE ord % 2 = 0) AS written, (SELECT count(*) FROM g WHERE ord % 2 = 0) AS live
UNION ALL SELECT 2, 'append', (SELECT count(*) FROM g WHERE ord % 2 = 1), (SELECT count(*) FROM g)
UNION ALL SELECT 3, 'delete', (SELECT count(*) FROM g WHERE ord % 9 = 1), (SELECT count(*) FROM g WHERE ord % 9 <> 1)
UNION ALL SELECT 4, 'compact', (SELECT count(*) FROM g WHERE ord % 9 <> 1), (SELECT count(*) FROM g WHERE ord % 9 <> 1)
UNION ALL SELECT 5, 'delete', (SELECT count(*) FROM g WHERE ord % 9 = 4), (SELECT count(*) FROM g WHERE ord % 9 NOT IN (1, 4))"""))
def s14_log(spark, sf_dir):
    """Rows that each change wrote: the batch, the deleted numbers, or what a compaction merges."""
    return changed_store(spark, sf_dir).history().select("version", "operation", "written", "live")


@query("s15_snapshot_after_changes", with_ctes("o g", "SELECT sequence, image_id, x FROM s WHERE ord % 9 NOT IN (1, 4)", s=STORE))
def s15_changed(spark, sf_dir):
    return changed_store(spark, sf_dir).snapshot().select("sequence", "image_id", "x")


@query("s17_paging_after_deletes", with_ctes("o g", "SELECT image_id, x, y FROM (SELECT *, row_number() OVER (ORDER BY sequence) AS n FROM s WHERE ord % 9 NOT IN (1, 4)) WHERE n > 40 AND n <= 65", s=STORE))
def s17_changed(spark, sf_dir):
    return changed_store(spark, sf_dir).page(40, 25).select("image_id", "x", "y")


@query("s19_store_guard", with_ctes("o g", """
SELECT c AS opened_with, c <> 'same' AS refused, (SELECT count(*) FROM g) AS n FROM (VALUES ('same'), ('other model'), ('other dimension'), ('none')) t(c)"""))
def s19_store(spark, sf_dir):
    """Opening a populated store under several identities; only its own is let in."""
    s = filled_store(spark, sf_dir)
    wanted = {"same": s.identity, "other model": {**s.identity, "model": "m2"}, "other dimension": {**s.identity, "dimension": "32"}, "none": None}

    def refused(identity) -> bool:
        try:
            store.GalleryStore(spark, s.path, 64, identity)
        except ValueError:
            return True
        return False

    cases = spark.createDataFrame([(name, refused(identity)) for name, identity in wanted.items()], "opened_with string, refused boolean")
    return cases.join(F.broadcast(s.snapshot().agg(F.count(F.lit(1)).alias("n"))), F.lit(True))


@query("s19_identity_guard", """
SELECT coalesce(a.name, b.name) AS name, a.value AS stored, b.value AS expected FROM
 (SELECT p_brand AS name, min(p_name) AS value FROM part GROUP BY 1) a FULL JOIN
 (SELECT p_brand AS name, CASE WHEN p_brand LIKE '%3' THEN max(p_name) ELSE min(p_name) END AS value FROM part WHERE p_brand NOT LIKE '%1' GROUP BY 1) b ON a.name = b.name
WHERE a.value IS DISTINCT FROM b.value""")
def s19(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"))
    have = p.select("name", F.col("lo").alias("value"))
    want = p.filter(~F.col("name").like("%1")).select("name", F.when(F.col("name").like("%3"), F.col("hi")).otherwise(F.col("lo")).alias("value"))
    return store.identity_difference(have, want)


@query("s20_archive_import", with_ctes("o", "SELECT 'im_' || ord || '_v' || vehicle_id || '_c' || camera_id AS image_id, x, w FROM o WHERE ord % 20 <> 3"))
def s20(spark, sf_dir):
    o = observations(spark, sf_dir).filter("ord % 20 <> 3")
    name = F.concat(F.lit("im_"), F.col("ord").cast("string"), F.lit("_v"), F.col("vehicle_id").cast("string"), F.lit("_c"), F.col("camera_id").cast("string"))
    files = file_list(spark, sf_dir).withColumn("length", F.lit(1).cast("long"))
    return store.resolve_import(o.select(name.alias("image_id"), "x", "w"), files).filter(F.col("path").isNotNull()).select("image_id", "x", "w")


@query("s21_backup_and_restore", with_ctes("o g", "SELECT sequence, image_id, x, 0::BIGINT AS problems FROM s", s=STORE))
def s21(spark, sf_dir):
    path = scratch_path(spark, "bundle")
    store.export_bundle(filled_store(spark, sf_dir).snapshot(), path)
    target = store.GalleryStore(spark, scratch_path(spark, "restored"), 64)
    store.restore_bundle(spark, path, target)
    problems = store.bundle_problems(spark, path).agg(F.count(F.lit(1)).alias("n")).scalar()
    return target.snapshot().select("sequence", "image_id", "x", problems.alias("problems"))


@query("s22_row_equality", """
SELECT unnest(['o_custkey', 'o_orderstatus', 'o_totalprice']) AS "column", unnest([
  count(*) FILTER (a.o_custkey IS DISTINCT FROM b.o_custkey), count(*) FILTER (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus),
  count(*) FILTER (a.o_totalprice IS DISTINCT FROM b.p)]) AS mismatches
FROM orders a FULL JOIN (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 100 <> 1) b ON a.o_orderkey = b.o_orderkey""")
def s22(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    b = a.filter("o_orderkey % 100 <> 1").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return store.row_differences(a, b, "o_orderkey")


@query("s23_migrate_features", with_ctes("o g", "SELECT sequence, image_id, true AS changed, sha256('feat:' || key) AS old_ref FROM s JOIN (SELECT ord AS k, key FROM g) x ON x.k = s.ord", s=STORE))
def s23(spark, sf_dir):
    snap = filled_store(spark, sf_dir).snapshot()
    feats = items(gallery_side(spark, sf_dir)).select("feature_ref", F.reverse("emb").alias("new_emb"))
    rows, lineage = store.migrate(snap, feats, "ns2")
    return lineage.select("sequence", "image_id", (F.col("old_ref") != F.col("new_ref")).alias("changed"), "old_ref")


@query("s24_feature_store_put", """
WITH d AS (SELECT sha256(text) AS feature_ref, lang AS token, doc_id FROM documents)
SELECT count(DISTINCT feature_ref) AS new_refs FROM d WHERE feature_ref NOT IN (SELECT feature_ref FROM d WHERE doc_id % 2 = 0)""")
def s24(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("feature_ref"), F.col("lang").alias("token"), "doc_id")
    return store.put_features(d.filter("doc_id % 2 = 0"), d).agg(F.count(F.lit(1)).alias("new_refs"))


@query("s24_ambiguous_tokens", "SELECT lang || ':' || source AS token, count(DISTINCT sha256(text)) AS n_refs FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def s24_tokens(spark, sf_dir):
    return store.ambiguous_tokens(table(spark, sf_dir, "documents").select(
        F.concat_ws(":", "lang", "source").alias("token"), F.sha2("text", 256).alias("feature_ref")))


@query("s25_metric_report", with_ctes("o q", "SELECT name, round(value, 6) AS value FROM (SELECT 'mean_area' AS name, avg(w * h) AS value FROM q UNION ALL SELECT 'n', count(*)::DOUBLE FROM q)"))
def s25(spark, sf_dir):
    q = query_side(spark, sf_dir)
    m = q.agg(F.avg(F.col("w") * F.col("h")).alias("mean_area"), F.count(F.lit(1)).cast("double").alias("n")).unpivot([], ["mean_area", "n"], "name", "value")
    path = scratch_path(spark, "report")
    results.write_report(m, path)
    return spark.read.schema("name string, value double").json(path).select("name", r6("value"))


@query("s26_collision_guard", "SELECT substr(sha256(text), 1, 3) AS key, count(DISTINCT sha256(text)) AS n_payloads FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def s26(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("payload")).withColumn("key", F.substring("payload", 1, 3))
    return store.collisions(d, "key", "payload")


@query("j11_observations_with_features", with_ctes("o g", """
SELECT g.ord, sha256('feat:' || key) AS feature_ref, ord % 6 <> 1 AS stored, CASE WHEN ord % 6 <> 1 THEN ord % 10 <> 2 END AS same_vector FROM g"""))
def j11(spark, sf_dir):
    """Observations joined to the feature store by reference, checking that vectors agree."""
    g = items(gallery_side(spark, sf_dir))
    feats = g.filter("ord % 6 <> 1").select("feature_ref", F.when(F.col("ord") % 10 == 2, F.reverse("emb")).otherwise(F.col("emb")).alias("stored_emb"))
    j = g.join(feats, "feature_ref", "left")
    return j.select("ord", "feature_ref", F.col("stored_emb").isNotNull().alias("stored"), (F.col("stored_emb") == F.col("emb")).alias("same_vector"))


@query("a38_folder_profile", f"""
WITH f AS ({FILES}), c AS (SELECT CASE WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE '' END AS folder, path FROM f)
SELECT coalesce(c.folder, e.folder) AS folder, count(path) AS n_files, count(*) FILTER (path LIKE '%.jpg') AS n_match,
       count(DISTINCT CASE WHEN path LIKE '%.jpg' THEN regexp_extract(path, '_v([0-9]+)', 1)::BIGINT END) AS n_ids, e.folder IS NOT NULL AS expected
FROM c FULL JOIN (SELECT unnest(['a', 'b', 'test']) AS folder) e ON e.folder = c.folder GROUP BY ALL""")
def a38(spark, sf_dir):
    files = file_list(spark, sf_dir).select("path")
    folder = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise(F.lit(""))
    parsed = annotations.parse_names(files, r"_v(?P<vid>\d+)_c(?P<cam>\d+)\.jpg$").select("path", "vehicle_id")
    per = files.join(parsed, "path", "left").groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"), F.count("vehicle_id").alias("n_match"), F.countDistinct("vehicle_id").alias("n_ids"))
    want = spark.range(1).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("test"))).alias("folder")).withColumn("expected", F.lit(True))
    return per.join(want, "folder", "full_outer").fillna(0).fillna(False, ["expected"])
