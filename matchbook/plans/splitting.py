"""Split, sampling and mining queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchbook.functions.vectors import dot, norm, scale, unit, vector_sum
from matchbook.model import gallery_side, observations, query_side, table
from matchbook.operators import splits
from matchbook.operators.similarity import CAMERA, Plan, nearest
from matchbook.plans.registry import query, with_ctes
from matchbook.plans.searching import sides
from matchbook.session import durable

H = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
IDS = """SELECT vehicle_id, row_number() OVER (ORDER BY """ + H.format("'{seed}:' || vehicle_id") + """, vehicle_id) AS rank, count(*) OVER () AS total
         FROM (SELECT DISTINCT vehicle_id FROM {src})"""


def ids_sql(seed, src):
    return IDS.replace("{seed}", str(seed)).replace("{src}", src)


@query("d1_open_set_split", with_ctes("o", """
SELECT o.ord, o.vehicle_id, CASE WHEN rank <= greatest(1, round_even(total * 0.2, 0)) THEN 'val' ELSE 'fit' END AS part
FROM o JOIN ids ON ids.vehicle_id = o.vehicle_id""", ids=ids_sql(0, "o")))
def d1(spark, sf_dir):
    return splits.open_set_split(observations(spark, sf_dir), 0.2, 0).select("ord", "vehicle_id", "part")


D2_SQL = dict(
    ids=ids_sql(3, "o"),
    b="""SELECT o.*, rank <= round_even(total * 0.2, 0) AS dis, count(*) OVER (PARTITION BY o.vehicle_id) AS n,
                row_number() OVER (PARTITION BY o.vehicle_id ORDER BY """ + H.format("'4:' || ord") + """, ord) AS z FROM o JOIN ids ON ids.vehicle_id = o.vehicle_id""")


@query("d2_query_gallery_by_identity", with_ctes("o", """
SELECT ord, role, role = 'query' AND NOT dis AS has_match FROM (
  SELECT *, CASE WHEN dis THEN CASE WHEN z = 1 THEN 'query' ELSE 'dropped' END WHEN n < 2 THEN 'gallery'
                 WHEN z <= least(2, n - 1) THEN 'query' ELSE 'gallery' END AS role FROM b)""", **D2_SQL))
def d2(spark, sf_dir):
    return splits.query_gallery_by_id(observations(spark, sf_dir), 0.2, 2, 3).select("ord", "role", "has_match")


@query("d3_query_gallery_by_track", with_ctes("o", """
SELECT ord, role, role = 'query' AND NOT dis AS has_match FROM (
  SELECT *, CASE WHEN NOT dis AND z = 1 THEN 'gallery' ELSE 'query' END AS role FROM (
    SELECT o.*, rank <= round_even(total * 0.1, 0) AS dis,
           row_number() OVER (PARTITION BY o.vehicle_id, camera_id ORDER BY """ + H.format("'4:' || ord") + """, ord) AS z
    FROM o JOIN ids ON ids.vehicle_id = o.vehicle_id))""", ids=ids_sql(3, "o")))
def d3(spark, sf_dir):
    return splits.query_gallery_by_track(observations(spark, sf_dir), 0.1, 3).select("ord", "role", "has_match")


@query("d4_frames_as_cameras", with_ctes("o", """
SELECT ord, (dense_rank() OVER (ORDER BY first))::INTEGER AS camera_id FROM (SELECT ord, min(ord) OVER (PARTITION BY frame) AS first FROM o)"""))
def d4(spark, sf_dir):
    return splits.frames_as_cameras(observations(spark, sf_dir)).select("ord", "camera_id")


@query("d6_local_validation", with_ctes("o", """
SELECT part, role, has_match, count(*) AS n, count(DISTINCT vehicle_id) AS n_ids FROM (
  SELECT 'fit' AS part, 'fit' AS role, false AS has_match, vehicle_id FROM s WHERE NOT val
  UNION ALL SELECT 'val', CASE WHEN NOT dis AND z = 1 THEN 'gallery' ELSE 'query' END, NOT (NOT dis AND z = 1) AND NOT dis, vehicle_id FROM (
    SELECT s.*, rank <= round_even(total * 0.3, 0) AS dis,
           row_number() OVER (PARTITION BY s.vehicle_id, camera_id ORDER BY """ + H.format("'1:' || ord") + """, ord) AS z
    FROM s JOIN vi ON vi.vehicle_id = s.vehicle_id WHERE val)) GROUP BY ALL""",
    ids=ids_sql(0, "o"), s="SELECT o.*, rank <= greatest(1, round_even(total * 0.4, 0)) AS val FROM o JOIN ids ON ids.vehicle_id = o.vehicle_id",
    vi=ids_sql(0, "(SELECT * FROM s WHERE val)")))
def d6(spark, sf_dir):
    part = splits.open_set_split(observations(spark, sf_dir), 0.4, 0)
    fit = part.filter("part = 'fit'").select("part", F.lit("fit").alias("role"), F.lit(False).alias("has_match"), "vehicle_id")
    val = splits.query_gallery_by_track(part.filter("part = 'val'"), 0.3, 0).select("part", "role", "has_match", "vehicle_id")
    return fit.unionByName(val).groupBy("part", "role", "has_match").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vehicle_id").alias("n_ids"))


@query("d7_identity_balanced_batches")
def d7(spark, sf_dir):
    return splits.identity_batches(gallery_side(spark, sf_dir), 4, 3, 10, 0)


BATCH_SQL = """SELECT {n}::BIGINT AS n_batches, 4::BIGINT AS identities, {k}::BIGINT AS slots, true AS rows_own_identity, true AS repeats_only_if_short
FROM (SELECT count(DISTINCT vehicle_id) AS v FROM g) WHERE v >= 4"""


def batch_facts(spark, sf_dir, k: int, by_camera: bool):
    """What every dealt batch must satisfy, as one row."""
    g = gallery_side(spark, sf_dir)
    b = durable(splits.identity_batches(g, 4, k, 10, 0, by_camera=by_camera), "batches")
    sizes = g.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("held"))
    own = g.select("ord", F.col("vehicle_id").alias("true_id"))
    per = b.join(own, "ord").groupBy("batch", "vehicle_id").agg(
        F.count(F.lit(1)).alias("slots"), F.countDistinct("ord").alias("rows"), F.min((F.col("true_id") == F.col("vehicle_id")).cast("int")).alias("own")).join(sizes, "vehicle_id")
    whole = per.groupBy("batch").agg(
        F.count(F.lit(1)).alias("ids"), F.min("slots").alias("lo"), F.max("slots").alias("hi"), F.min("own").alias("own"),
        F.min((F.col("rows") == F.least(F.lit(k), F.col("held"))).cast("int")).alias("full"))
    return whole.agg(F.count(F.lit(1)).alias("n_batches"), F.max("ids").cast("long").alias("identities"), F.when(F.min("lo") == F.max("hi"), F.max("hi")).cast("long").alias("slots"),
                     (F.min("own") == 1).alias("rows_own_identity"), (F.min("full") == 1).alias("repeats_only_if_short"))


@query("d7_batch_invariants", with_ctes("o g", BATCH_SQL.format(n=10, k=3)))
def d7_facts(spark, sf_dir):
    return batch_facts(spark, sf_dir, 3, False)


@query("d8_batch_invariants", with_ctes("o g", BATCH_SQL.format(n=10, k=4)))
def d8_facts(spark, sf_dir):
    return batch_facts(spark, sf_dir, 4, True)


@query("d8_camera_aware_batches")
def d8(spark, sf_dir):
    return splits.identity_batches(gallery_side(spark, sf_dir), 4, 4, 10, 0, by_camera=True)


@query("d9_hard_pairs", with_ctes("o q g", """
SELECT a.ord, coalesce(x.j, y.j) AS hard_positive, z.j AS hard_negative FROM g a
LEFT JOIN (SELECT i, min_by(j, {s: s, j: j}) AS j FROM pr WHERE same AND cross_cam GROUP BY i) x ON x.i = a.ord
LEFT JOIN (SELECT i, min_by(j, {s: s, j: j}) AS j FROM pr WHERE same GROUP BY i) y ON y.i = a.ord
LEFT JOIN (SELECT i, max_by(j, {s: s, j: -j}) AS j FROM pr WHERE NOT same GROUP BY i) z ON z.i = a.ord""",
    pr="""SELECT a.ord AS i, b.ord AS j, list_inner_product(a.emb, b.emb) AS s, a.vehicle_id = b.vehicle_id AS same, a.camera_id <> b.camera_id AS cross_cam
          FROM g a JOIN g b ON a.ord <> b.ord AND a.ord // 64 = b.ord // 64"""))
def d9(spark, sf_dir):
    """Hardest positive (another camera if any) and hardest negative inside each batch of 64 ordinals."""
    g = gallery_side(spark, sf_dir).withColumn("batch", F.expr("ord div 64"))
    # The farthest row is the nearest to the opposite vector.
    away = g.withColumn("emb", scale(F.col("emb"), -1.0))
    best = lambda a, plan, name: nearest(a, g, 1, plan).select(F.col("q_ord").alias("ord"), F.col("g_ord").alias(name))
    cross = best(away, Plan(exclude=(("ord",), CAMERA), require=("batch", "vehicle_id")), "_cross")
    any_cam = best(away, Plan(exclude=(("ord",),), require=("batch", "vehicle_id")), "_any")
    neg = best(g, Plan(exclude=(("ord",), ("vehicle_id",)), require=("batch",)), "hard_negative")
    out = g.select("ord").join(cross, "ord", "left").join(any_cam, "ord", "left").join(neg, "ord", "left")
    return out.select("ord", F.coalesce("_cross", "_any").alias("hard_positive"), "hard_negative")


@query("d9_focus_pairs", with_ctes("o q g", """
SELECT i, j, same FROM (SELECT *, row_number() OVER (PARTITION BY i, same ORDER BY s DESC, j) AS z FROM pr)
WHERE (same AND cross_cam) OR (NOT same AND z <= 4)""",
    pr="""SELECT a.ord AS i, b.ord AS j, list_inner_product(a.emb, b.emb) AS s, a.vehicle_id = b.vehicle_id AS same, a.camera_id <> b.camera_id AS cross_cam
          FROM g a JOIN g b ON a.ord <> b.ord AND a.ord // 64 = b.ord // 64"""))
def d9_focus(spark, sf_dir):
    """Pairs that get extra weight: cross-camera positives and the four nearest other identities."""
    from matchbook.operators.similarity import within
    g = gallery_side(spark, sf_dir).withColumn("batch", F.expr("ord div 64"))
    pos = within(g, g, -2.0, Plan(exclude=(("ord",), CAMERA), require=("batch", "vehicle_id")))
    neg = nearest(g, g, 4, Plan(exclude=(("ord",), ("vehicle_id",)), require=("batch",)))
    tag = lambda df, same: df.select(F.col("q_ord").alias("i"), F.col("g_ord").alias("j"), F.lit(same).alias("same"))
    return tag(pos, True).union(tag(neg, False))


@query("d10_class_prototypes", with_ctes("o q g", """
SELECT vehicle_id, n, round(list_sum(list_transform(s, lambda x: (x / (sqrt(list_inner_product(s, s)) + 1e-8))**2)), 6) AS sq_norm,
       round(s[1] / (sqrt(list_inner_product(s, s)) + 1e-8), 6) AS first_value, round(s[64] / (sqrt(list_inner_product(s, s)) + 1e-8), 6) AS last_value
FROM (SELECT vehicle_id, max(n) AS n, list(x ORDER BY d) AS s FROM (
  SELECT vehicle_id, d, count(*) AS n, sum(v) AS x FROM (SELECT vehicle_id, unnest(range(1, 65)) AS d, unnest(emb) AS v FROM g) GROUP BY ALL) GROUP BY vehicle_id)"""))
def d10(spark, sf_dir):
    g = gallery_side(spark, sf_dir).select("vehicle_id", unit(F.col("emb")).alias("e"))
    n = g.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"))
    s = vector_sum(g, ["vehicle_id"], "e").withColumn("w", scale(F.col("total"), 1.0 / (norm(F.col("total")) + 1e-8)))
    return s.join(n, "vehicle_id").select(
        "vehicle_id", "n", F.round(dot(F.col("w"), F.col("w")), 6).alias("sq_norm"),
        F.round(F.element_at("w", 1), 6).alias("first_value"), F.round(F.element_at("w", 64), 6).alias("last_value"))


@query("d11_id_set_algebra", """
SELECT 'both' AS what, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'only_first', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'only_second', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'missing', count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R'))""")
def d11(spark, sf_dir):
    """Overlap, both differences and missing ids of two id sets, in one pass over each table."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("a"), F.max((F.col("l_returnflag") == "A").cast("int")).alias("b"))
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).distinct().withColumn("known", F.lit(1))
    m = ids.join(li, "id", "full_outer").fillna(0)
    n = lambda cond: F.sum(F.expr(cond).cast("long"))
    row = m.agg(n("a = 1 and b = 1").alias("both"), n("a = 1 and b = 0").alias("only_first"),
                n("a = 0 and b = 1").alias("only_second"), n("known = 1 and a = 0 and b = 0").alias("missing"))
    return row.unpivot([], ["both", "only_first", "only_second", "missing"], "what", "n")


@query("d12_identity_halves", with_ctes("o q", """
SELECT q.ord, CASE WHEN rank <= total // 2 THEN 'A' ELSE 'B' END AS half FROM q JOIN ids ON ids.vehicle_id = q.vehicle_id""", ids=ids_sql(0, "q")))
def d12(spark, sf_dir):
    return splits.halves(query_side(spark, sf_dir), 0).select("ord", "half")


def growth(q, g, seed: int):
    """Gallery rows with ``rank`` 0 for positives and a seeded rank for distractors of a fixed cohort."""
    from matchbook.functions.text import seeded_order
    from matchbook.operators.ranks import running
    ids = q.select("vehicle_id").distinct()
    pos = g.join(ids, "vehicle_id", "left_semi").withColumn("rank", F.lit(0).cast("long"))
    rest = g.join(ids, "vehicle_id", "left_anti").withColumn("_h", seeded_order(seed, F.col("ord")))
    order = running(rest.select("ord", "_h"), "_h", "ord").select("ord", "rank")
    return pos.select(*g.columns, "rank").unionByName(rest.join(order, "ord").select(*g.columns, "rank"))


COHORT = "SELECT * FROM q WHERE ord % 3 = 0 AND vehicle_id < 5"


def growth_sql(seed):
    return ("SELECT *, CASE WHEN pos THEN 0 ELSE row_number() OVER (PARTITION BY pos ORDER BY " + H.format(f"'{seed}:' || ord") +
            ", ord) END AS rank FROM (SELECT g.*, vehicle_id IN (SELECT vehicle_id FROM co) AS pos FROM g)")


@query("d13_nested_gallery_growth", with_ctes("o q g", """
SELECT seed, size, count(*) AS n, sum(ord)::BIGINT AS checksum FROM (
  SELECT 0 AS seed, * FROM g0 UNION ALL SELECT 1, * FROM g1) JOIN (SELECT unnest([40, 80]) AS size) ON rank <= size GROUP BY ALL""",
    co=COHORT, g0=growth_sql(0), g1=growth_sql(1)))
def d13(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    cohort = q.filter("ord % 3 = 0 and vehicle_id < 5")
    runs = growth(cohort, g, 0).withColumn("seed", F.lit(0)).unionByName(growth(cohort, g, 1).withColumn("seed", F.lit(1)))
    sizes = runs.withColumn("size", F.explode(F.array(F.lit(40), F.lit(80)))).filter("rank <= size")
    return sizes.groupBy("seed", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("checksum"))


KEEP = {"natural": (0.0, 0.8), "removed": (0.4, 0.8)}
EPISODES_SQL = dict(
    ei="SELECT vehicle_id, row_number() OVER (ORDER BY vehicle_id) AS rank, count(*) OVER () AS total FROM (SELECT DISTINCT vehicle_id FROM o)",
    eb="""SELECT * FROM (SELECT o.ord, o.vehicle_id, o.frame, o.emb, camera_id <= 2 AS day, rank, total,
              row_number() OVER (PARTITION BY o.vehicle_id, camera_id <= 2 ORDER BY o.ord) AS z FROM o JOIN ei ON ei.vehicle_id = o.vehicle_id) WHERE z <= 3""",
    ep="""SELECT d || '-' || k AS episode, CASE WHEN day = dq THEN 'query' ELSE 'gallery' END AS role, eb.* FROM eb
          JOIN (SELECT unnest(['day-night', 'night-day']) AS d, unnest([true, false]) AS dq) ON true
          JOIN (SELECT unnest(['natural', 'removed']) AS k, unnest([0.0, 0.4]) AS lo, unnest([0.8, 0.8]) AS hi) ON true
          WHERE (day = dq AND z = 1) OR (day <> dq AND rank > floor(total * lo) AND rank <= floor(total * hi))""")


@query("d14_episodes", with_ctes("o", "SELECT episode, role, ord, vehicle_id FROM ep", **EPISODES_SQL))
def d14(spark, sf_dir):
    return splits.episodes(observations(spark, sf_dir), "camera_id <= 2", KEEP)


@query("d15_parity_subset", with_ctes("o q g", """
SELECT ord, vehicle_id FROM g WHERE ('0x' || substr(sha256(vehicle_id::VARCHAR), 64, 1))::BIGINT % 2 = 0"""))
def d15(spark, sf_dir):
    last = F.conv(F.substring(F.sha2(F.col("vehicle_id").cast("string"), 256), -1, 1), 16, 10).cast("long")
    return gallery_side(spark, sf_dir).filter(last % 2 == 0).select("ord", "vehicle_id")
