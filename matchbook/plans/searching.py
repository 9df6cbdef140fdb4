"""Search, join and top-k queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.functions.vectors import unit
from matchbook.model import gallery_side, query_side, second_space
from matchbook.operators import refusal, search
from matchbook.operators.similarity import CAMERA, FRAME, JUNK, SELF, Plan, counts_ahead, joint_counts, moments, nearest, within
from matchbook.plans.registry import query, with_ctes

THRESHOLD = 0.35
TAU = 0.25


def sides(spark, sf_dir):
    return query_side(spark, sf_dir), gallery_side(spark, sf_dir)


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def open_set_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, g = sides(spark, sf_dir)
    top = nearest(q, g, 10, q_carry=["key"], g_carry=["key"])
    best = F.max(F.when(F.col("pos") == 1, F.col("sim"))).over(Window.partitionBy("q_ord"))
    return top.select("q_key", "pos", "g_key", F.round("sim", 6).alias("sim"), refusal.accepts(best, THRESHOLD).alias("accepted"))


query("open_set_search", with_ctes("o q g p r", f"""
SELECT q_key, pos::INTEGER AS pos, g_key, round(sim, 6) AS sim,
       max(CASE WHEN pos = 1 THEN sim END) OVER (PARTITION BY q_ord) >= {THRESHOLD} AS accepted
FROM r WHERE pos <= 10"""))(open_set_search)


@query("j1_all_pairs_similarity_profile", with_ctes("o q g", """
SELECT q.ord AS q_ord, count(*) AS n, round(sum(list_inner_product(q.emb, g.emb)), 6) AS total,
       round(sqrt(avg(list_inner_product(q.emb, g.emb)**2) - avg(list_inner_product(q.emb, g.emb))**2), 6) AS spread
FROM q JOIN g ON true GROUP BY q.ord"""))
def j1(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    m = F.col("s1") / F.col("n")
    return moments(q, g, Plan(exclude=())).select("q_ord", "n", F.round("s1", 6).alias("total"), F.round(F.sqrt(F.col("s2") / F.col("n") - m * m), 6).alias("spread"))


def _top(name: str, cond: str, plan: Plan, k: int = 5):
    @query(name, with_ctes("o q g", f"""
SELECT * FROM (
  SELECT q.ord AS q_ord, g.ord AS g_ord, round(list_inner_product(q.emb, g.emb), 6) AS sim,
         row_number() OVER (PARTITION BY q.ord ORDER BY list_inner_product(q.emb, g.emb) DESC, g.ord)::INTEGER AS pos
  FROM q JOIN g ON {cond}) WHERE pos <= {k}"""))
    def run(spark, sf_dir):
        q, g = sides(spark, sf_dir)
        return nearest(q, g, k, plan).select("q_ord", "g_ord", r6("sim"), "pos")


_top("j1_exact_top5", "true", Plan(exclude=()))
_top("j2_top5_outside_own_frame", "q.frame <> g.frame", Plan(exclude=(FRAME,)))
_top("j3_top5_without_junk", "NOT (q.vehicle_id = g.vehicle_id AND q.camera_id = g.camera_id)", Plan(exclude=(JUNK,)))
_top("j4_top5_cross_camera", "q.camera_id <> g.camera_id", Plan(exclude=(CAMERA,)))
_top("k1_stable_top10", "q.frame <> g.frame", Plan(), 10)


@query("j5_radius_count", with_ctes("o q g p", f"""
SELECT q.ord AS q_ord, count(p.g_ord) AS n_cand FROM q LEFT JOIN p ON p.q_ord = q.ord AND p.sim >= {TAU} GROUP BY q.ord"""))
def j5_count(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    marked = q.withColumn("marks", F.array(F.lit(TAU))).withColumn("mark_ords", F.array(F.lit(search.FAR_ORD)))
    return counts_ahead(marked, g).select("q_ord", F.col("n").alias("n_cand"))


@query("j5_radius_ids", with_ctes("o q g p", f"SELECT q_ord, g_ord, round(sim, 6) AS sim FROM p WHERE sim >= {TAU}"))
def j5_ids(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return within(q, g, TAU).select("q_ord", "g_ord", r6("sim"))


def joint_candidates(spark, sf_dir, tau=0.05, group=3):
    """Tracks are runs of three consecutive queries; candidates lie in every member's radius."""
    q, g = sides(spark, sf_dir)
    return joint_counts(q.withColumn("track", F.expr(f"ord div {5 * group}")), g, tau)


JOINT_SQL = dict(
    h="SELECT q_ord // 15 AS track, g_ord, count(*) AS seen FROM p WHERE sim >= 0.05 GROUP BY ALL",
    m="SELECT ord // 15 AS track, count(*) AS m FROM q GROUP BY ALL",
    c="SELECT m.track, m.m, count(h.g_ord) AS n_cand FROM m LEFT JOIN h ON h.track = m.track AND h.seen = m.m GROUP BY ALL",
)


@query("j6_joint_candidates", with_ctes("o q g p", "SELECT track, m, n_cand FROM c", **JOINT_SQL))
def j6(spark, sf_dir):
    return joint_candidates(spark, sf_dir).select("track", "m", "n_cand")


NN_SQL = """
  SELECT a.ord AS i, b.ord AS j, a.vehicle_id AS i_vehicle, list_inner_product(a.emb, b.emb) AS sim,
         row_number() OVER (PARTITION BY a.ord ORDER BY list_inner_product(a.emb, b.emb) DESC, b.ord) AS pos
  FROM g a JOIN g b ON a.frame <> b.frame"""


@query("j7_gallery_neighbours", with_ctes("o g", "SELECT i, j, pos::INTEGER AS pos, round(sim, 6) AS sim FROM nn WHERE pos <= 5", nn=NN_SQL))
def j7(spark, sf_dir):
    g = gallery_side(spark, sf_dir)
    return nearest(g, g, 5).select(F.col("q_ord").alias("i"), F.col("g_ord").alias("j"), "pos", r6("sim"))


@query("j8_mutual_neighbours", with_ctes("o g", """
SELECT a.i, a.j, round(a.sim, 6) AS sim FROM five a JOIN five b ON a.i = b.j AND a.j = b.i""", nn=NN_SQL, five="SELECT * FROM nn WHERE pos <= 5"))
def j8(spark, sf_dir):
    from matchbook.operators.graph import mutual
    g = gallery_side(spark, sf_dir)
    return mutual(nearest(g, g, 5)).select(F.col("q_ord").alias("i"), F.col("g_ord").alias("j"), r6("sim"))


@query("j9_shortlist_second_space", with_ctes("o q g p r", """
SELECT q_ord, g_ord, pos::INTEGER AS pos, round(sim2, 6) AS heavy FROM r WHERE pos <= 20"""))
def j9(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    short = nearest(q, g, 20)
    return search.pair_scores(short, second_space(q), second_space(g), "heavy").select("q_ord", "g_ord", "pos", r6("heavy"))


@query("j12_has_match", with_ctes("o q g p r d", "SELECT q_ord, has_match FROM d"))
def j12(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return search.with_match_flag(q, g).select(F.col("ord").alias("q_ord"), "has_match")


@query("j13_valid_positives", with_ctes("o q g nv", "SELECT q_ord, n_valid FROM nv"))
def j13(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return search.valid_positives(q, g).select("q_ord", "n_valid")


@query("j14_distractors", with_ctes("o q g", """
SELECT ord, vehicle_id FROM g WHERE vehicle_id NOT IN (SELECT vehicle_id FROM q WHERE ord % 3 = 0 AND vehicle_id < 5)"""))
def j14(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    cohort = q.filter((F.col("ord") % 3 == 0) & (F.col("vehicle_id") < 5)).select("vehicle_id").distinct()
    return g.join(cohort, "vehicle_id", "left_anti").select("ord", "vehicle_id")




@query("k3_top1_top2_margin", with_ctes("o q g p r", """
SELECT q_ord, round(max(CASE WHEN pos=1 THEN sim END), 6) AS top1,
       round(max(CASE WHEN pos=1 THEN sim END) - coalesce(max(CASE WHEN pos=2 THEN sim END), -1), 6) AS margin
FROM r WHERE pos <= 2 GROUP BY q_ord"""))
def k3(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return refusal.measures(nearest(q, g, 2), 2).select("q_ord", r6("top1"), r6("margin"))


@query("k4_first_eligible", with_ctes("o q g p r", """
SELECT q_ord, min_by(g_ord, pos) AS g_ord, min(pos)::INTEGER AS pos FROM r WHERE pos <= 10 AND sim2 >= 0.1 AND q_key <> g_key GROUP BY q_ord"""))
def k4(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    top = nearest(q, g, 10, q_carry=["key"], g_carry=["key"])
    scored = search.pair_scores(top, second_space(q), second_space(g), "sim2")
    return scored.filter((F.col("sim2") >= 0.1) & (F.col("q_key") != F.col("g_key"))).groupBy("q_ord").agg(
        F.min_by("g_ord", "pos").alias("g_ord"), F.min("pos").alias("pos"))


@query("k5_ordinal_ranks", with_ctes("o q g p", """
SELECT q_ord, g_ord, rnk FROM (
  SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) - 1 AS rnk,
         row_number() OVER (PARTITION BY q_ord ORDER BY sim2 DESC, g_ord) AS pos2 FROM p) WHERE pos2 <= 10"""))
def k5(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    other = nearest(second_space(q), second_space(g), 10).select("q_ord", "g_ord")
    scored = search.pair_scores(other, q, g, "s")
    return search.ordinals(scored, q, g, Plan(), "s", "rnk").select("q_ord", "g_ord", "rnk")


@query("k6_density", with_ctes("o g", """
SELECT i AS ord, round(avg(sim), 6) AS density FROM (
  SELECT a.ord AS i, list_inner_product(a.emb, b.emb) AS sim,
         row_number() OVER (PARTITION BY a.ord ORDER BY list_inner_product(a.emb, b.emb) DESC, b.ord) AS pos
  FROM g a JOIN g b ON a.ord <> b.ord) WHERE pos <= 5 GROUP BY i"""))
def k6(spark, sf_dir):
    g = gallery_side(spark, sf_dir)
    return density(g).select("ord", r6("density"))


def density(g: DataFrame) -> DataFrame:
    """Mean similarity of each gallery row to its five nearest others."""
    return nearest(g, g, 5, Plan(exclude=(SELF,))).groupBy(F.col("q_ord").alias("ord")).agg(F.avg("sim").alias("density"))


@query("k7_prefix_preserving_merge", with_ctes("o q g p", """
SELECT q_ord, list_concat(a[1:3], list_filter(b, lambda v: NOT list_contains(a[1:3], v)))[1:10] AS merged FROM (
  SELECT q_ord, list(g_ord ORDER BY p1) FILTER (WHERE p1 <= 10) AS a, list(g_ord ORDER BY p2) FILTER (WHERE p2 <= 10) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) AS p1,
              row_number() OVER (PARTITION BY q_ord ORDER BY sim2 DESC, g_ord) AS p2 FROM p) GROUP BY q_ord)"""))
def k7(spark, sf_dir):
    from matchbook.operators.fusion import ranked_list, merge_keeping_prefix
    q, g = sides(spark, sf_dir)
    a = ranked_list(nearest(q, g, 10), "a")
    b = ranked_list(nearest(second_space(q), second_space(g), 10), "b")
    return a.join(b, "q_ord").select("q_ord", merge_keeping_prefix(F.col("a"), F.col("b"), 3).alias("merged"))


@query("k9_top_regions", with_ctes("o g", """
SELECT ord, cell, cell // 8 AS row_index, cell % 8 AS col_index, round(v, 6) AS contribution FROM (
  SELECT ord, cell, v, row_number() OVER (PARTITION BY ord ORDER BY v DESC, cell) AS pos FROM (
    SELECT ord, unnest(range(0, 64)) AS cell, unnest(list_transform(emb, lambda x: x - list_avg(emb))) AS v FROM g)) WHERE pos <= 3"""))
def k9(spark, sf_dir):
    from matchbook.operators.fusion import top_regions
    g = gallery_side(spark, sf_dir).select("ord", unit(F.col("emb")).alias("grid"))
    return top_regions(g, "grid", width=8, count=3).select("ord", "cell", "row_index", "col_index", r6("contribution"))


@query("k10_head_sample", with_ctes("o q g", """
SELECT ord, key, side FROM (SELECT ord, key, 'gallery' AS side FROM g ORDER BY ord LIMIT 20)
UNION ALL SELECT * FROM (SELECT ord, key, 'query' AS side FROM q ORDER BY ord LIMIT 1 OFFSET 7)"""))
def k10(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    head = g.orderBy("ord").limit(20).select("ord", "key", F.lit("gallery").alias("side"))
    one = q.orderBy("ord").offset(7).limit(1).select("ord", "key", F.lit("query").alias("side"))
    return head.union(one)


@query("k2_shortlist_with_gaps", with_ctes("o q g p", """
SELECT q.ord AS q_ord, s.pos::INTEGER AS pos, coalesce(x.g_ord, -1) AS g_ord
FROM q JOIN (SELECT unnest(range(1, 6)) AS pos) s ON true
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) AS at FROM p
           WHERE sim >= 0.3) x ON x.q_ord = q.ord AND x.at = s.pos"""))
def k2(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    kept = nearest(q, g, 5).filter(F.col("sim") >= 0.3).select("q_ord", "pos", "g_ord")
    dense = q.select(F.col("ord").alias("q_ord"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("pos"))
    return dense.join(kept, ["q_ord", "pos"], "left").fillna(-1, ["g_ord"])
