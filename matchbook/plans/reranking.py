"""Re-ranking, fusion and cascade queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.vectors import dot, scale, unit
from matchbook.model import gallery_side, second_space
from matchbook.operators import cascade, graph, insertion, metrics, patches, search
from matchbook.operators.similarity import Plan, nearest
from matchbook.plans.evaluation import TRUTH, emitted_top
from matchbook.plans.registry import query, with_ctes
from matchbook.plans.searching import r6, sides
from matchbook.session import durable


def graph_ctes(k1: int, k2: int, vec: str = "emb", pre: str = "", src: str = "g") -> dict[str, str]:
    """SQL of the static graph over table ``src`` (edge tables bf and af)."""
    h = max(1, k1 // 2)
    c = {
        "gg": f"""SELECT a.ord AS i, b.ord AS j, CASE WHEN a.ord = b.ord THEN 0 WHEN a.frame = b.frame THEN 8
                  ELSE 2 - 2 * list_inner_product(a.{vec}, b.{vec}) END AS d FROM {src} a JOIN {src} b ON true""",
        "nn": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) - 1 AS p FROM @gg) WHERE p <= " + str(k1),
        "rk": "SELECT a.i, a.j FROM @nn a JOIN @nn b ON a.j = b.i AND a.i = b.j",
        "rh": f"SELECT a.i, a.j FROM @nn a JOIN @nn b ON a.j = b.i AND a.i = b.j WHERE a.p <= {h} AND b.p <= {h}",
        "hs": "SELECT i, count(*) AS n FROM @rh GROUP BY i",
        "ok": """SELECT k.i, k.j FROM @rk k JOIN @rh x ON x.i = k.j JOIN @rk m ON m.i = k.i AND m.j = x.j JOIN @hs z ON z.i = k.j
                 GROUP BY k.i, k.j, z.n HAVING 3 * count(*) > 2 * z.n""",
        "ex": "SELECT i, j FROM @rk UNION SELECT k.i, x.j FROM @ok k JOIN @rh x ON x.i = k.j",
        "bf": """SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM (
                   SELECT e.i, e.j, exp(-x.d) AS w FROM @ex e JOIN @gg x ON x.i = e.i AND x.j = e.j)""",
        "af": f"""SELECT n.i, b.j, sum(b.w) / {k2} AS w FROM @nn n JOIN @bf b ON b.i = n.j WHERE n.p < {k2} GROUP BY n.i, b.j""",
    }
    return {pre + k: v.replace("@", pre) for k, v in c.items()}


def kr_ctes(k1: int, k2: int, lam: float, vec: str = "emb", pre: str = "", sim: str = "sim", pairs: str = "p") -> dict[str, str]:
    """SQL of isolated k-reciprocal re-ranking: table kr (all pairs) and kp (with pos)."""
    c = graph_ctes(k1, k2, vec, pre)
    c.update({pre + k: v.replace("@", pre) for k, v in {
        "qn": f"SELECT q_ord, g_ord FROM (SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY {sim} DESC, g_ord) AS z FROM {pairs}) WHERE z <= {k2 - 1}",
        "qv": f"SELECT n.q_ord, b.j, sum(b.w) / {k2} AS v FROM @qn n JOIN @bf b ON b.i = n.g_ord GROUP BY n.q_ord, b.j",
        "tt": "SELECT v.q_ord, a.i AS g_ord, sum(least(v.v, a.w)) AS t FROM @qv v JOIN @af a ON a.j = v.j GROUP BY v.q_ord, a.i",
        "kr": f"""SELECT x.*, (1 - {lam}::DOUBLE) * (1 - coalesce(t, 0) / (2 - coalesce(t, 0))) + {lam}::DOUBLE * (2 - 2 * {sim}) AS dist
                  FROM {pairs} x LEFT JOIN @tt t ON t.q_ord = x.q_ord AND t.g_ord = x.g_ord""",
        "kp": "SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY q_ord ORDER BY dist, g_ord) AS pos FROM (SELECT *, 0 AS pos FROM @kr)",
    }.items()})
    return c


KR_OUT = "SELECT q_ord, g_ord, pos::INTEGER AS pos, round(dist, 6) AS dist FROM kp WHERE pos <= 10"


def kr_top(q, g, k1=3, k2=2, lam=0.2, k=10, plan=Plan(), nn=None, top=None):
    return graph.k_reciprocal(q, g, k, graph.build_graph(g, k1, k2, plan, nn=nn), lam, top=top)


def kr_rows(df):
    return df.select("q_ord", "g_ord", "pos", r6("dist"))


@query("r1_k_reciprocal_top10", with_ctes("o q g p", KR_OUT, **kr_ctes(3, 2, 0.2)))
def r1(spark, sf_dir):
    return kr_rows(kr_top(*sides(spark, sf_dir)))


@query("r1_k_reciprocal_wide", with_ctes("o q g p", KR_OUT, **kr_ctes(10, 3, 0.3)))
def r1_wide(spark, sf_dir):
    return kr_rows(kr_top(*sides(spark, sf_dir), 10, 3, 0.3))


@query("r4_chunked_k_reciprocal", with_ctes("o q g p", KR_OUT, **kr_ctes(3, 2, 0.2)))
def r4(spark, sf_dir):
    return kr_rows(kr_top(*sides(spark, sf_dir), plan=Plan(q_rows=37, g_rows=101)))


def shared_ctes(k1, k2, lam, src, where):
    c = graph_ctes(k1, k2, src=src)
    c["tt"] = "SELECT v.i AS q_ord, a.i AS g_ord, sum(least(v.w, a.w)) AS t FROM af v JOIN af a ON a.j = v.j GROUP BY v.i, a.i"
    c["kp"] = f"""SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY dist, g_ord) AS pos FROM (
        SELECT x.i AS q_ord, x.j AS g_ord, (1 - {lam}::DOUBLE) * (1 - coalesce(t, 0) / (2 - coalesce(t, 0))) + {lam}::DOUBLE * d AS dist
        FROM gg x LEFT JOIN tt ON tt.q_ord = x.i AND tt.g_ord = x.j WHERE x.d < 8 AND x.i <> x.j AND {where})"""
    return c


@query("r2_k_reciprocal_shared", with_ctes("o q g", KR_OUT, **shared_ctes(6, 2, 0.3, "g", "true")))
def r2(spark, sf_dir):
    g = gallery_side(spark, sf_dir)
    return kr_rows(graph.k_reciprocal_shared(g, 10, graph.build_graph(g, 6, 2), 0.3))


@query("r3_k_reciprocal_not_isolated", with_ctes("o q g", KR_OUT,
       u="SELECT * FROM q UNION ALL SELECT * FROM g", **shared_ctes(6, 2, 0.3, "u", "x.i % 5 = 0 AND x.j % 5 <> 0")))
def r3(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    both = q.unionByName(g)
    return kr_rows(graph.k_reciprocal_shared(both, 10, graph.build_graph(both, 6, 2), 0.3, sources=q, targets=g))


@query("r5_static_graph_edges", with_ctes("o q g", """
SELECT 'before' AS kind, i, j, round(w, 6) AS w FROM bf UNION ALL SELECT 'after', i, j, round(w, 6) FROM af""", **graph_ctes(3, 2)))
def r5(spark, sf_dir):
    gr = graph.build_graph(gallery_side(spark, sf_dir), 3, 2)
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "i", "j", r6("w"))
    return tag(gr.before, "before").union(tag(gr.after, "after"))


@query("r7_pool_restricted_distances", with_ctes("o q g p", """
SELECT q_ord, g_ord, pos::INTEGER AS pos, round(dist, 6) AS dist FROM (
  SELECT kr.q_ord, kr.g_ord, kr.dist, row_number() OVER (PARTITION BY kr.q_ord ORDER BY dist, kr.g_ord) AS pos
  FROM kr JOIN (SELECT q_ord, g_ord, row_number() OVER (PARTITION BY q_ord ORDER BY sim2 DESC, g_ord) AS z FROM p) s
  ON s.q_ord = kr.q_ord AND s.g_ord = kr.g_ord AND z <= 20) WHERE pos <= 10""", **kr_ctes(3, 2, 0.2)))
def r7(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    pool = nearest(second_space(q), second_space(g), 20)
    return kr_rows(graph.k_reciprocal(q, g, 10, graph.build_graph(g, 3, 2), 0.2, pool))


def moved_sql(base: str, edges: str, weight: str, donors: str) -> dict[str, str]:
    """SQL of weighted neighbour sums: table mv(ord, emb)."""
    return {
        "ad": f"""SELECT ord, list(s ORDER BY d) AS a FROM (
            SELECT e.i AS ord, d, sum({weight} * v) AS s FROM {edges} e
            JOIN (SELECT ord, unnest(range(1, 65)) AS d, unnest(emb) AS v FROM {donors}) t ON t.ord = e.j GROUP BY e.i, d) GROUP BY ord""",
        "mu": f"""SELECT b.ord, b.frame, b.vehicle_id, b.camera_id, b.emb AS old,
            CASE WHEN a IS NULL THEN b.emb ELSE list_transform(b.emb, lambda v, i: v + a[i]) END AS s FROM {base} b LEFT JOIN ad ON ad.ord = b.ord""",
        "mv": "SELECT *, list_transform(s, lambda v: v / greatest(sqrt(list_inner_product(s, s)), 1e-12)) AS emb FROM mu",
    }


MOVED_OUT = "SELECT ord, round(list_inner_product(old, emb), 6) AS kept, round(emb[1], 6) AS first_value, round(emb[64], 6) AS last_value FROM mv"


def moved_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    base = old.select("ord", unit(F.col("emb")).alias("_old"))
    return new.select("ord", "emb").join(base, "ord").select(
        "ord", F.round(dot(F.col("_old"), F.col("emb")), 6).alias("kept"),
        F.round(F.element_at("emb", 1), 6).alias("first_value"), F.round(F.element_at("emb", 64), 6).alias("last_value"))


@query("r8_neighbourhood_average", with_ctes("o q g", MOVED_OUT,
    n="""SELECT i, j, sim FROM (SELECT a.ord AS i, b.ord AS j, list_inner_product(a.emb, b.emb) AS sim,
           row_number() OVER (PARTITION BY a.ord ORDER BY list_inner_product(a.emb, b.emb) DESC, b.ord) AS z
           FROM g a JOIN g b ON a.frame <> b.frame) WHERE z <= 3""",
    e="SELECT a.* FROM n a JOIN n b ON a.i = b.j AND a.j = b.i WHERE a.sim >= 0.2", **moved_sql("g", "e", "greatest(e.sim, 0)", "g")))
def r8(spark, sf_dir):
    g = gallery_side(spark, sf_dir)
    return moved_rows(g, graph.neighbourhood_average(g, 3, min_sim=0.2))


@query("r9_query_expansion", with_ctes("o q g", MOVED_OUT,
    e="""SELECT i, j, sim FROM (SELECT a.ord AS i, b.ord AS j, list_inner_product(a.emb, b.emb) AS sim,
           row_number() OVER (PARTITION BY a.ord ORDER BY list_inner_product(a.emb, b.emb) DESC, b.ord) AS z
           FROM q a JOIN g b ON true) WHERE z <= 3""", **moved_sql("q", "e", "greatest(e.sim, 0)**3", "g")))
def r9(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return moved_rows(q, graph.query_expansion(q, g, 3, 3.0))


RESCORE = """SELECT *, min(sim) OVER w + 1 + {a} * (sim2 - min(sim2) OVER w) / greatest(max(sim2) OVER w - min(sim2) OVER w, 1e-9)
             + (1 - {a}) * (sim - min(sim) OVER w) / greatest(max(sim) OVER w - min(sim) OVER w, 1e-9) AS rescored
             FROM r WHERE pos <= 20 WINDOW w AS (PARTITION BY q_ord)"""


def shortlist_two_spaces(q, g, k=20):
    short = nearest(q, g, k, q_carry=TRUTH, g_carry=TRUTH)
    return search.pair_scores(short, second_space(q), second_space(g), "heavy").withColumn("score", F.col("sim"))


@query("r10_cascade_rescore", with_ctes("o q g p r", """
SELECT q_ord, g_ord, round(rescored, 6) AS rescored, row_number() OVER (PARTITION BY q_ord ORDER BY x.rescored DESC, g_ord)::INTEGER AS pos FROM x""",
    x=RESCORE.format(a="0.7::DOUBLE")))
def r10(spark, sf_dir):
    return cascade.rescore(shortlist_two_spaces(*sides(spark, sf_dir)), 0.7).select("q_ord", "g_ord", r6("rescored"), "pos")


PATCH = dict(
    tk="""SELECT ord, c, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM (
            SELECT ord, c, emb[c*4+1:c*4+4] AS v FROM (SELECT ord, e AS emb, unnest(range(0, 16)) AS c FROM (
              SELECT vec_id AS ord, embedding::DOUBLE[] AS e FROM embeddings)))""",
    s="""SELECT r.q_ord, r.g_ord, a.c AS ca, b.c AS cb, list_inner_product(a.v, b.v) AS cs FROM r
         JOIN tk a ON a.ord = r.q_ord JOIN tk b ON b.ord = r.g_ord WHERE r.pos <= 5""",
    mb="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_ord, g_ord, ca ORDER BY cs DESC, cb) AS f,
            row_number() OVER (PARTITION BY q_ord, g_ord, cb ORDER BY cs DESC, ca) AS b FROM s) WHERE f = 1 AND b = 1 AND cs >= 0.6""",
    sp="""SELECT a.q_ord, a.g_ord, a.ca, count(*) AS support FROM mb a JOIN mb b ON a.q_ord = b.q_ord AND a.g_ord = b.g_ord
          AND abs((a.cb % 4 - a.ca % 4) - (b.cb % 4 - b.ca % 4)) <= 1 AND abs((a.cb // 4 - a.ca // 4) - (b.cb // 4 - b.ca // 4)) <= 1
          GROUP BY a.q_ord, a.g_ord, a.ca""",
    lm="""SELECT r.q_ord, r.g_ord, r.pos, r.sim, q_vehicle_id, g_vehicle_id, q_camera_id, g_camera_id,
                 coalesce(max(m.n), 0) AS n_mutual, coalesce(max(support), 0) AS n_inliers FROM r
          LEFT JOIN sp ON sp.q_ord = r.q_ord AND sp.g_ord = r.g_ord
          LEFT JOIN (SELECT q_ord, g_ord, count(*) AS n FROM mb GROUP BY ALL) m ON m.q_ord = r.q_ord AND m.g_ord = r.g_ord
          WHERE r.pos <= 5 GROUP BY ALL""",
)


def matched_shortlist(q, g, k=5, tol=1.0):
    short = nearest(q, g, k, q_carry=TRUTH, g_carry=TRUTH)
    pairs = patches.with_tokens(short, patches.token_table(q, 16, 4), patches.token_table(g, 16, 4))
    return patches.shift_matches(pairs, dim=4, width=4, min_sim=0.6, tol=tol)


@query("r11_patch_match_pairs", with_ctes("o q g p r", "SELECT q_ord, g_ord, n_mutual::INTEGER AS n_mutual, n_inliers::INTEGER AS n_inliers FROM lm", **PATCH))
def r11(spark, sf_dir):
    return matched_shortlist(*sides(spark, sf_dir)).select("q_ord", "g_ord", "n_mutual", "n_inliers")


@query("r12_patch_scores_of_shortlist", with_ctes("o q g p r", "SELECT q_ord, sum(n_inliers)::BIGINT AS inliers, max(n_inliers)::INTEGER AS best FROM lm GROUP BY q_ord", **PATCH))
def r12(spark, sf_dir):
    return matched_shortlist(*sides(spark, sf_dir)).groupBy("q_ord").agg(F.sum("n_inliers").alias("inliers"), F.max("n_inliers").alias("best"))


@query("r13_fuse_patch_scores", with_ctes("o q g p r", """
SELECT q_ord, g_ord, round(sim + 0.5::DOUBLE * n_inliers / 16, 6) AS fused,
       row_number() OVER (PARTITION BY q_ord ORDER BY sim + 0.5::DOUBLE * n_inliers / 16 DESC, g_ord)::INTEGER AS pos FROM lm""", **PATCH))
def r13(spark, sf_dir):
    m = matched_shortlist(*sides(spark, sf_dir)).drop("pos").withColumn("f", F.col("sim") + 0.5 * F.col("n_inliers") / 16)
    w = Window.partitionBy("q_ord").orderBy(F.desc("f"), "g_ord")
    return m.select("q_ord", "g_ord", F.round("f", 6).alias("fused"), F.row_number().over(w).alias("pos"))


BETAS = [0.0, 0.25, 0.5, 1.0, 2.0, 4.0]


@query("r14_tune_patch_weight", with_ctes("o q g p r nv", """
SELECT round(beta, 6) AS beta, round(map, 6) AS map, beta = (SELECT beta FROM m ORDER BY m.map DESC, m.beta LIMIT 1) AS chosen FROM m""",
    **PATCH,
    fu="""SELECT *, row_number() OVER (PARTITION BY beta, q_ord ORDER BY sim + beta * n_inliers / 16 DESC, g_ord) AS z
          FROM lm JOIN (SELECT unnest([0.0, 0.25, 0.5, 1.0, 2.0, 4.0])::DOUBLE AS beta) ON true""",
    cl="SELECT beta, q_ord, (g_vehicle_id = q_vehicle_id)::INT AS rel, row_number() OVER (PARTITION BY beta, q_ord ORDER BY z) AS rk FROM fu WHERE g_camera_id <> q_camera_id",
    hs="SELECT *, sum(rel) OVER (PARTITION BY beta, q_ord ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hits FROM cl",
    ap="""SELECT b.beta, nv.q_ord, coalesce(sum(CASE WHEN rel = 1 THEN hits / rk END), 0) / least(max(n_valid), 10) AS ap
          FROM nv JOIN (SELECT DISTINCT beta FROM fu) b ON true LEFT JOIN hs ON hs.q_ord = nv.q_ord AND hs.beta = b.beta WHERE n_valid > 0 GROUP BY ALL""",
    m="SELECT beta, avg(ap) AS map FROM ap GROUP BY beta"))
def r14(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    m = durable(matched_shortlist(q, g), "patches").drop("pos")
    runs = m.withColumn("beta", F.explode(F.array(*[F.lit(b) for b in BETAS])))
    w = Window.partitionBy("beta", "q_ord").orderBy(F.desc(F.col("sim") + F.col("beta") * F.col("n_inliers") / 16), "g_ord")
    ap = metrics.average_precision_at_k(runs.withColumn("pos", F.row_number().over(w)), q, g, 10, strict=True, runs={"beta": BETAS})
    res = ap.groupBy("beta").agg(F.avg("ap").alias("map"))
    first = Window.partitionBy(F.lit(0)).orderBy(F.desc("map"), "beta")
    return res.select("beta", r6("map"), (F.row_number().over(first) == 1).alias("chosen"))


@query("r15_unambiguous_correspondences")
def r15(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    short = nearest(q, g, 5).select("q_ord", "g_ord", "pos")
    pairs = patches.with_tokens(short, patches.token_table(q, 16, 4), patches.token_table(g, 16, 4))
    return patches.unambiguous_matches(pairs, dim=4, width=4)


def two_space_rank(q, g, k1=3, k2=2, lam=0.2, k=10, insertion_weight=0.0):
    """Fused ranking of two branches: mean of both k-reciprocal scores, and of both cosines.

    With ``insertion_weight`` that share of the rank comes from the joint space with the
    query inserted into its graph. The mean of two cosines is the cosine of the joined
    vectors, so the k nearest in the joint space and the pairs with shared neighbours in
    any of the graphs hold every winner.
    """
    spaces = [(q, g), (second_space(q), second_space(g))]
    joint = tuple(durable(d, "joint") for d in joint_space(spaces))
    top = durable(nearest(*joint, max(k, k1)).select("q_ord", "g_ord", "pos"), "nearest")
    pool = top.filter(F.col("pos") <= k).select("q_ord", "g_ord")
    for n, (a, b) in enumerate(spaces):
        gr = graph.build_graph(b, k1, k2)
        t = graph.overlap(graph.query_weights(a, b, gr), gr.after).withColumnRenamed("t", f"t{n}")
        pool = pool.join(t, ["q_ord", "g_ord"], "full_outer")
    if insertion_weight:
        t = insertion.insertion_scores(*joint, graph.build_graph(joint[1], k1, k2), top).withColumnRenamed("t", "t2")
        pool = pool.join(t.filter(F.col("g_ord") >= 0), ["q_ord", "g_ord"], "full_outer")
    shared = tuple(c for c in pool.columns if c not in ("q_ord", "g_ord"))
    scored = graph.listed_cosines(pool.fillna(0.0, list(shared)), spaces, Plan(), shared)
    scored = scored.withColumn("raw", 0.5 * F.col("s0") + 0.5 * F.col("s1"))
    part = lambda t, s: graph.jaccard_distance(F.col(t), 2.0 - 2.0 * F.col(s), lam)
    rank = -0.5 * part("t0", "s0") - 0.5 * part("t1", "s1")
    if insertion_weight:
        rank = (1.0 - insertion_weight) * rank - insertion_weight * part("t2", "raw")
    w = Window.partitionBy("q_ord").orderBy(F.desc("rank"), "g_ord")
    return (
        scored.withColumn("rank", rank).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
        .select("q_ord", "g_ord", "raw", "rank", "pos"))


def joint_space(spaces, weights=None):
    """Both sides of several spaces concatenated into one unit vector per row."""
    weights = weights or [1.0] * len(spaces)

    def join(side):
        out = spaces[0][side]
        parts = [scale(unit(F.col("emb")), weights[0])]
        for n, s in enumerate(spaces[1:], 1):
            out = out.join(s[side].select("ord", F.col("emb").alias(f"_e{n}")), "ord")
            parts.append(scale(unit(F.col(f"_e{n}")), weights[n]))
        return out.withColumn("emb", unit(F.concat(*parts))).drop(*[f"_e{n}" for n in range(1, len(spaces))])

    return join(0), join(1)


R18 = {**kr_ctes(3, 2, 0.2, pre="a"), **kr_ctes(3, 2, 0.2, vec="emb2", pre="b", sim="sim2")}


@query("r18_two_branch_fusion", with_ctes("o q g p", """
SELECT q_ord, g_ord, round(raw, 6) AS raw, round(rank, 6) AS rank, pos::INTEGER AS pos FROM (
  SELECT a.q_ord, a.g_ord, 0.5 * a.sim + 0.5 * a.sim2 AS raw, -0.5 * a.dist - 0.5 * b.dist AS rank,
         row_number() OVER (PARTITION BY a.q_ord ORDER BY -0.5 * a.dist - 0.5 * b.dist DESC, a.g_ord) AS pos
  FROM akr a JOIN bkr b ON a.q_ord = b.q_ord AND a.g_ord = b.g_ord) WHERE pos <= 10""", **R18))
def r18(spark, sf_dir):
    return two_space_rank(*sides(spark, sf_dir)).select("q_ord", "g_ord", r6("raw"), r6("rank"), "pos")


@query("r19_weighted_ensemble_top5", with_ctes("o q g", """
SELECT q_ord, g_ord, round(s, 6) AS sim, pos::INTEGER AS pos FROM (
  SELECT q.ord AS q_ord, g.ord AS g_ord, (list_inner_product(q.emb, g.emb) + 4 * list_inner_product(q.emb2, g.emb2)) / 5 AS s,
    row_number() OVER (PARTITION BY q.ord ORDER BY (list_inner_product(q.emb, g.emb) + 4 * list_inner_product(q.emb2, g.emb2)) / 5 DESC, g.ord) AS pos
  FROM q JOIN g ON q.frame <> g.frame) WHERE pos <= 5"""))
def r19(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return nearest(*joint_space([(q, g), (second_space(q), second_space(g))], [1.0, 2.0]), 5).select("q_ord", "g_ord", r6("sim"), "pos")


RRF = """SELECT *, 0.65::DOUBLE / (20 + r1) + 0.35::DOUBLE / (20 + r2) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) - 1 AS r1,
         row_number() OVER (PARTITION BY q_ord ORDER BY sim2 DESC, g_ord) - 1 AS r2 FROM p)"""


@query("r20_reciprocal_rank_fusion", with_ctes("o q g p", """
SELECT q_ord, g_ord, r1, r2, round(score, 6) AS score, pos::INTEGER AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY x.score DESC, g_ord) AS pos FROM x) WHERE pos <= 10""", x=RRF))
def r20(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return search.reciprocal_rank_fusion(q, g, second_space(q), second_space(g), 10).select("q_ord", "g_ord", "r1", "r2", r6("score"), "pos")


SUPPORT = "1 / (1 + exp(-(list_sum(list_transform(emb[1:8], lambda v, i: (v - 0.01::DOUBLE) / 0.1::DOUBLE * (i % 3 - 1))) + 0.2::DOUBLE)))"


@query("r23_gallery_routing", with_ctes("o q g", f"""
SELECT q.ord AS q_ord, round({SUPPORT}, 6) AS support, round(pr.m, 6) AS gallery_support,
       ({SUPPORT} >= 0.6 AND pr.m >= 0.5) AS supplemented FROM q JOIN pr ON true""", pr=f"SELECT avg({SUPPORT}) AS m FROM g"))
def r23(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    gate = [(0.01, 0.1, float(i % 3 - 1)) for i in range(1, 9)]
    score = lambda: support(unit(F.col("emb")), gate, 0.2)
    mean = g.agg(F.avg(score()).alias("m")).scalar()
    s = q.select(F.col("ord").alias("q_ord"), score().alias("support"), mean.alias("gallery_support"))
    return s.select("q_ord", r6("support"), r6("gallery_support"),
                    ((F.col("support") >= 0.6) & (F.col("gallery_support") >= 0.5)).alias("supplemented"))


def support(v, gate, intercept: float):
    """Logistic support of one vector under a fixed gate of (mean, std, coefficient) per dimension."""
    z = reduce(lambda a, b: a + b, [(F.element_at(v, i + 1) - m) / s * c for i, (m, s, c) in enumerate(gate)])
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z + intercept))))


@query("a19_shortlist_recall", with_ctes("o q g p r nv", """
SELECT round(100 * avg(hit::INT), 6) AS recall, count(*) AS n FROM (
  SELECT nb.q_ord, EXISTS (SELECT 1 FROM r WHERE r.q_ord = nb.q_ord AND pos <= 20 AND g_vehicle_id = q_vehicle_id AND g_camera_id <> q_camera_id) AS hit
  FROM (SELECT DISTINCT q_ord FROM p WHERE g_vehicle_id = q_vehicle_id AND g_camera_id <> q_camera_id) nb)"""))
def a19(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    top = emitted_top(q, g, 20)
    good = (F.col("g_vehicle_id") == F.col("q_vehicle_id")) & (F.col("g_camera_id") != F.col("q_camera_id"))
    hit = top.groupBy("q_ord").agg(F.max(good).alias("hit"))
    # Positives outside the query's frame: identity total minus own camera minus other cameras of the frame.
    frame = search.identity_counts(g, ["vehicle_id", "frame", "camera_id"]).select(
        "vehicle_id", "frame", F.col("camera_id").alias("_c"), F.col("_n").alias("_f"))
    other = (q.join(frame, ["vehicle_id", "frame"]).filter(F.col("_c") != F.col("camera_id"))
             .groupBy(F.col("ord").alias("q_ord")).agg(F.sum("_f").alias("_f")))
    eligible = search.valid_positives(q, g).join(other, "q_ord", "left").filter(F.col("n_valid") > F.coalesce("_f", F.lit(0)))
    return eligible.select("q_ord").join(hit, "q_ord", "left").agg(
        F.round(100.0 * F.avg(F.coalesce("hit", F.lit(False)).cast("int").cast("double")), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


def run_ap(ranking_sql: str, key: str, points: str) -> dict[str, str]:
    """SQL of mean AP@10 and rank-1 per parameter point of a ranked table."""
    return dict(
        cl=f"SELECT {key}, q_ord, (g_vehicle_id = q_vehicle_id)::INT AS rel, row_number() OVER (PARTITION BY {key}, q_ord ORDER BY pos) AS rk FROM {ranking_sql} WHERE pos <= 10 AND NOT (g_vehicle_id = q_vehicle_id AND g_camera_id = q_camera_id)",
        hs=f"SELECT *, sum(rel) OVER (PARTITION BY {key}, q_ord ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hits FROM cl",
        ap=f"""SELECT b.{key}, nv.q_ord, coalesce(sum(CASE WHEN rel = 1 THEN hits / rk END), 0) / least(max(n_valid), 10) AS ap,
                 coalesce(min(CASE WHEN rel = 1 THEN rk END) = 1, false)::INT AS first
               FROM nv JOIN ({points}) b ON true LEFT JOIN hs ON hs.q_ord = nv.q_ord AND hs.{key} = b.{key} WHERE n_valid > 0 GROUP BY ALL""",
        m=f"SELECT {key}, avg(ap) AS map, avg(first) AS rank1 FROM ap GROUP BY {key}")


def run_summary(runs: DataFrame, key: str, points: list, q, g):
    ap = metrics.average_precision_at_k(runs, q, g, 10, runs={key: points})
    return metrics.summary(ap, ranks=(1,), keys=[key]).select(key, r6("map"), r6("rank1"))


MARGINS = [0.0, 0.01, 0.02, 0.05, 0.1, 1.0]


@query("a20_selective_verification", with_ctes("o q g p r nv", """
SELECT round(m.cut, 6) AS cut, round(share, 6) AS share_verified, round(map, 6) AS map, round(rank1, 6) AS rank1 FROM m
JOIN (SELECT cut, 100 * avg((margin < cut)::INT) AS share FROM mg JOIN ct ON true GROUP BY cut) s ON s.cut = m.cut""",
    x=RESCORE.format(a="0.9::DOUBLE"),
    rs="SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY x.rescored DESC, g_ord) AS pos2 FROM x",
    mg="SELECT q_ord, max(CASE WHEN pos = 1 THEN sim END) - max(CASE WHEN pos = 2 THEN sim END) AS margin FROM r GROUP BY q_ord",
    ct="SELECT unnest([0.0, 0.01, 0.02, 0.05, 0.1, 1.0])::DOUBLE AS cut",
    mx="SELECT rs.* EXCLUDE (pos), cut, CASE WHEN margin < cut THEN pos2 ELSE pos END AS pos FROM rs JOIN mg ON mg.q_ord = rs.q_ord JOIN ct ON true",
    **run_ap("mx", "cut", "SELECT cut FROM ct")))
def a20(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    short = durable(shortlist_two_spaces(q, g), "shortlist")
    margin = cascade.margin_of(short)
    full = cascade.rescore(short.withColumnRenamed("pos", "base_pos"), 0.9)
    mixed = full.join(margin, "q_ord").withColumn("cut", F.explode(F.array(*[F.lit(m) for m in MARGINS]))).withColumn(
        "pos", F.when(F.col("margin") < F.col("cut"), F.col("pos")).otherwise(F.col("base_pos")))
    share = margin.withColumn("cut", F.explode(F.array(*[F.lit(m) for m in MARGINS]))).groupBy("cut").agg(
        F.round(100.0 * F.avg((F.col("margin") < F.col("cut")).cast("int").cast("double")), 6).alias("share_verified"))
    return run_summary(mixed, "cut", MARGINS, q, g).join(share, "cut")


ALPHAS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@query("a21_cascade_alpha_sweep", with_ctes("o q g p r nv", "SELECT round(alpha, 6) AS alpha, round(map, 6) AS map, round(rank1, 6) AS rank1 FROM m",
    al="SELECT unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS alpha",
    x="""SELECT *, alpha * (sim2 - min(sim2) OVER w) / greatest(max(sim2) OVER w - min(sim2) OVER w, 1e-9)
             + (1 - alpha) * (sim - min(sim) OVER w) / greatest(max(sim) OVER w - min(sim) OVER w, 1e-9) AS mixed
             FROM r JOIN al ON true WHERE pos <= 20 WINDOW w AS (PARTITION BY alpha, q_ord)""",
    rs="SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY alpha, q_ord ORDER BY mixed DESC, g_ord) AS pos FROM x",
    **run_ap("rs", "alpha", "SELECT alpha FROM al")))
def a21_alpha(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    short = durable(shortlist_two_spaces(q, g), "shortlist")
    runs = reduce(DataFrame.unionByName, [cascade.rescore(short, a).withColumn("alpha", F.lit(a)) for a in ALPHAS])
    return run_summary(runs, "alpha", ALPHAS, q, g)


GRID = {"3/2/0.2": (3, 2, 0.2), "4/3/0.3": (4, 3, 0.3)}


def grid_ctes(space="emb", sim="sim", pre="", cut=""):
    c = {}
    for n, (k1, k2, lam) in enumerate(GRID.values()):
        c.update(kr_ctes(k1, k2, lam, vec=space, pre=f"{pre}{'ab'[n]}", sim=sim))
    cols = "q_ord, g_ord, q_vehicle_id, g_vehicle_id, q_camera_id, g_camera_id, pos"
    base = f"SELECT 'base' AS point, * FROM (SELECT q_ord, g_ord, q_vehicle_id, g_vehicle_id, q_camera_id, g_camera_id, row_number() OVER (PARTITION BY q_ord ORDER BY {sim} DESC, g_ord) AS pos FROM p)"
    c[pre + "runs"] = base + "".join(f" UNION ALL SELECT '{k}', {cols} FROM {pre}{'ab'[n]}kp" for n, k in enumerate(GRID))
    return c


POINTS = "SELECT unnest(['base', '3/2/0.2', '4/3/0.3']) AS point"


def grid_runs(q, g):
    """Rankings of every (k1, k2, lambda) point and of plain cosine, with the truth columns."""
    truth_q = q.select(F.col("ord").alias("q_ord"), *[F.col(c).alias("q_" + c) for c in TRUTH])
    truth_g = g.select(F.col("ord").alias("g_ord"), *[F.col(c).alias("g_" + c) for c in TRUTH])
    # All points read one search of the gallery and one of its own neighbours.
    top = durable(nearest(q, g, 10).select("q_ord", "g_ord", "sim", "pos"), "nearest")
    nn = graph.neighbours(g, max(k1 for k1, _, _ in GRID.values()))
    parts = [top.select(F.lit("base").alias("point"), "q_ord", "g_ord", "pos")]
    for name, (k1, k2, lam) in GRID.items():
        ranked = graph.k_reciprocal(q, g, 10, graph.build_graph(g, k1, k2, nn=nn), lam, top=top)
        parts.append(ranked.select(F.lit(name).alias("point"), "q_ord", "g_ord", "pos"))
    return reduce(DataFrame.unionByName, parts).join(truth_q, "q_ord").join(truth_g, "g_ord")


@query("a21_rerank_grid", with_ctes("o q g p nv", "SELECT point, round(map, 6) AS map, round(rank1, 6) AS rank1 FROM m",
                                    **grid_ctes(), **run_ap("runs", "point", POINTS)))
def a21_grid(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return run_summary(grid_runs(q, g), "point", ["base", *GRID], q, g)


def two_run_grid(spark, sf_dir):
    """Grid scores on two embedding spaces, as ``run, point, map``."""
    q, g = sides(spark, sf_dir)
    out = []
    for name, (a, b) in {"first": (q, g), "second": (second_space(q), second_space(g))}.items():
        out.append(run_summary(grid_runs(a, b), "point", ["base", *GRID], a, b).withColumn("run", F.lit(name)))
    return durable(out[0].unionByName(out[1]), "grid")


def second_grid_ctes():
    a = {**grid_ctes(pre="x"), **{("x" + k): v for k, v in run_ap("xruns", "point", POINTS).items()}}
    b = {**grid_ctes("emb2", "sim2", pre="y"), **{("y" + k): v for k, v in run_ap("yruns", "point", POINTS).items()}}
    fix = lambda d, p: {k: (v.replace("FROM cl", f"FROM {p}cl").replace("JOIN hs ON hs.q_ord = nv.q_ord AND hs.", f"JOIN {p}hs hs ON hs.q_ord = nv.q_ord AND hs.").replace("FROM ap GROUP", f"FROM {p}ap GROUP")) for k, v in d.items()}
    return {**fix(a, "x"), **fix(b, "y")}


VERDICT = """
SELECT what, point, round(first_map, 6) AS first_map, round(second_map, 6) AS second_map,
       (SELECT count(DISTINCT point) = 1 FROM v WHERE what <> 'current') AS agree FROM v"""
V_SQL = dict(
    w="SELECT a.point, round(a.map, 6) AS first_map, round(b.map, 6) AS second_map, list_position(['base', '3/2/0.2', '4/3/0.3'], a.point) AS n FROM xm a JOIN ym b ON a.point = b.point",
    v="""SELECT 'best_on_first' AS what, * FROM (SELECT * FROM w ORDER BY first_map DESC, n LIMIT 1)
         UNION ALL SELECT 'best_on_second', * FROM (SELECT * FROM w ORDER BY second_map DESC, n LIMIT 1)
         UNION ALL SELECT 'current', * FROM w WHERE point = '3/2/0.2'""")


@query("a40_grid_verdict", with_ctes("o q g p nv", VERDICT, **second_grid_ctes(), **V_SQL))
def a40(spark, sf_dir):
    order = F.array_position(F.array(*[F.lit(x) for x in ["base", *GRID]]), F.col("point"))
    at = lambda run: F.max(F.when(F.col("run") == run, F.col("map")))
    w = two_run_grid(spark, sf_dir).groupBy("point").agg(at("first").alias("first_map"), at("second").alias("second_map")).withColumn("n", order)
    one = lambda what, by: w.orderBy(F.desc(by), "n").limit(1).withColumn("what", F.lit(what))
    bests = one("best_on_first", "first_map").unionByName(one("best_on_second", "second_map"))
    agree = bests.agg((F.countDistinct("point") == 1).alias("agree")).scalar()
    v = bests.unionByName(w.filter(F.col("point") == "3/2/0.2").withColumn("what", F.lit("current")))
    return v.select("what", "point", r6("first_map"), r6("second_map"), agree.alias("agree"))


@query("a31_model_gate", with_ctes("o q g p nv", """
SELECT round(c.map, 6) AS candidate, round(b.map, 6) AS baseline, round(round(c.map, 6) - round(b.map, 6), 6) AS gain,
       round(c.map, 6) - round(b.map, 6) >= 0.003 AS passed FROM xm c JOIN ym b ON c.point = b.point WHERE c.point = '3/2/0.2'""", **second_grid_ctes()))
def a31(spark, sf_dir):
    g = two_run_grid(spark, sf_dir).filter(F.col("point") == "3/2/0.2").groupBy().agg(
        F.max(F.when(F.col("run") == "first", F.col("map"))).alias("candidate"),
        F.max(F.when(F.col("run") == "second", F.col("map"))).alias("baseline"))
    gain = F.col("candidate") - F.col("baseline")
    return g.select("candidate", "baseline", F.round(gain, 6).alias("gain"), (gain >= 0.003).alias("passed"))


ABLATION = {"k-recip 3/2": (3, 2), "k-recip 6/2": (6, 2)}
AVERAGES = (1, 3)


def ablation_ctes():
    c = {"al": "SELECT * FROM q UNION ALL SELECT * FROM g"}
    runs = ["SELECT 'base' AS point, q_ord, g_ord, q_vehicle_id, g_vehicle_id, q_camera_id, g_camera_id, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) AS pos FROM p"]
    cols = "q_ord, g_ord, q_vehicle_id, g_vehicle_id, q_camera_id, g_camera_id, pos"
    for n, (name, (k1, k2)) in enumerate(ABLATION.items()):
        c.update(kr_ctes(k1, k2, 0.3, pre="ab"[n]))
        runs.append(f"SELECT '{name}', {cols} FROM {'ab'[n]}kp")
    for k in AVERAGES:
        near = f"""SELECT i, j, sim FROM (SELECT a.ord AS i, b.ord AS j, list_inner_product(a.emb, b.emb) AS sim, row_number() OVER (PARTITION BY a.ord ORDER BY list_inner_product(a.emb, b.emb) DESC, b.ord) AS z
                   FROM al a JOIN al b ON a.frame <> b.frame) WHERE z <= {k}"""
        c[f"n{k}"] = near
        c[f"e{k}"] = f"SELECT a.* FROM n{k} a JOIN n{k} b ON a.i = b.j AND a.j = b.i WHERE a.sim >= 0"
        m = moved_sql("al", f"e{k}", "greatest(e.sim, 0)", "al")
        c[f"ad{k}"] = m["ad"]
        c[f"mu{k}"] = m["mu"].replace("LEFT JOIN ad ON ad.ord", f"LEFT JOIN ad{k} ON ad{k}.ord")
        c[f"mv{k}"] = m["mv"].replace("FROM mu", f"FROM mu{k}")
        runs.append(f"""SELECT 'dba k={k}', a.ord, b.ord, a.vehicle_id, b.vehicle_id, a.camera_id, b.camera_id, row_number() OVER (PARTITION BY a.ord ORDER BY list_inner_product(a.emb, b.emb) DESC, b.ord)
                    FROM mv{k} a JOIN mv{k} b ON a.ord % 5 = 0 AND b.ord % 5 <> 0 AND a.frame <> b.frame""")
    c["runs"] = " UNION ALL ".join(runs)
    names = ["base", *ABLATION, *[f"dba k={k}" for k in AVERAGES]]
    c.update(run_ap("runs", "point", "SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS point"))
    return c


@query("r24_postprocessing_ablation", with_ctes("o q g p nv", "SELECT point, round(map, 6) AS map, round(rank1, 6) AS rank1 FROM m", **ablation_ctes()))
def r24(spark, sf_dir):
    """mAP@10 of plain cosine, neighbourhood averaging and k-reciprocal variants.

    Averaging here runs over queries and gallery together, as a research comparison only.
    """
    q, g = sides(spark, sf_dir)
    truth_q = q.select(F.col("ord").alias("q_ord"), *[F.col(c).alias("q_" + c) for c in TRUTH])
    truth_g = g.select(F.col("ord").alias("g_ord"), *[F.col(c).alias("g_" + c) for c in TRUTH])
    keep = lambda df, name: df.select(F.lit(name).alias("point"), "q_ord", "g_ord", "pos")
    # All k-reciprocal points read one search and one set of lists, all averages one search of queries and gallery together.
    top = durable(nearest(q, g, 10).select("q_ord", "g_ord", "sim", "pos"), "nearest")
    nn = graph.neighbours(g, max(k1 for k1, _ in ABLATION.values()))
    parts = [keep(top, "base")]
    parts += [keep(kr_top(q, g, k1, k2, 0.3, nn=nn, top=top), name) for name, (k1, k2) in ABLATION.items()]
    both = q.unionByName(g)
    near = graph.average_lists(both, max(AVERAGES))
    for k in AVERAGES:
        moved = durable(graph.neighbourhood_average(both, k, near=near), "averaged")
        mq = moved.join(q.select("ord"), "ord", "left_semi")
        mg = moved.join(g.select("ord"), "ord", "left_semi")
        parts.append(keep(nearest(mq, mg, 10), f"dba k={k}"))
    names = ["base", *ABLATION, *[f"dba k={k}" for k in AVERAGES]]
    return run_summary(reduce(DataFrame.unionByName, parts).join(truth_q, "q_ord").join(truth_g, "g_ord"), "point", names, q, g)
