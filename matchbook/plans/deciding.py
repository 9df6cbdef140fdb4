"""Confidence-feature and policy queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions import calibration as cal
from matchbook.functions.vectors import subtract, unit
from matchbook.model import second_space
from matchbook.operators import compress, features, graph, heads, policies, search, splits
from matchbook.operators.similarity import Plan, nearest
from matchbook.plans.evaluation import rounded
from matchbook.plans.registry import query, with_ctes
from matchbook.plans.reranking import RRF, kr_ctes, kr_top
from matchbook.plans.searching import THRESHOLD, r6, sides
from matchbook.session import durable

DN = """SELECT i AS ord, avg(sim) AS density FROM (
  SELECT a.ord AS i, list_inner_product(a.{v}, b.{v}) AS sim, row_number() OVER (PARTITION BY a.ord ORDER BY list_inner_product(a.{v}, b.{v}) DESC, b.ord) AS z
  FROM g a JOIN g b ON a.ord <> b.ord) WHERE z <= 5 GROUP BY i"""
F1 = """SELECT k.q_ord, k.g_ord AS top, k.{s} AS conf, k.{s} - CASE WHEN t.gs[1] = k.g_ord THEN t.ss[2] ELSE t.ss[1] END AS gap_other, t.ss[1] - t.ss[2] AS gap_raw,
  list_avg(t.ss[1:5]) AS top5_mean, list_stddev_pop(t.ss[1:5]) AS top5_std, k2.dist - k.dist AS rank_gap, dn.density, k.{s} - dn.density AS conf_density
  FROM {p}kp k JOIN {p}kp k2 ON k.q_ord = k2.q_ord AND k.pos = 1 AND k2.pos = 2 JOIN {p}dn dn ON dn.ord = k.g_ord
  JOIN (SELECT q_ord, list({s} ORDER BY {s} DESC, g_ord) AS ss, list(g_ord ORDER BY {s} DESC, g_ord) AS gs FROM p GROUP BY q_ord) t ON t.q_ord = k.q_ord"""
X8 = ("conf", "gap_other", "gap_raw", "top5_mean", "top5_std", "rank_gap", "density", "conf_density")


def f1_ctes(v="emb", s="sim", p=""):
    return {**kr_ctes(3, 2, 0.2, v, p, s), p + "dn": DN.format(v=v), p + "f1": F1.format(s=s, p=p)}


def ranked(q, g, k=10, nn=None, top=None):
    """k-reciprocal ranking with ``score`` growing with rank quality."""
    return kr_top(q, g, k=k, nn=nn, top=top).withColumn("score", -F.col("dist"))


def searched(q, g, k1=3, k=10, others=5):
    """The lists that a space's features read, from one search of the gallery and one of its own rows: neighbours, others and best rows."""
    nn, near = graph.neighbours_and_others(g, k1, others)
    return nn, near, durable(nearest(q, g, k).select("q_ord", "g_ord", "sim", "pos"), "nearest")


def basic_features(q, g, prefix="", lists=None):
    nn, others, top = lists or searched(q, g)
    return features.basic(durable(ranked(q, g, nn=nn, top=top), "ranked"), top, features.density(others), prefix)


@query("f1_basic_features", with_ctes("o q g p", "SELECT q_ord, top, " + ", ".join(f"round({c}, 6) AS {c}" for c in X8) + " FROM f1", **f1_ctes()))
def f1(spark, sf_dir):
    return rounded(basic_features(*sides(spark, sf_dir)), *X8)


@query("f2_two_space_features", with_ctes("o q g p", "SELECT a.q_ord, " + ", ".join(f"round(a.{c}, 6) AS {c}, round(b.{c}, 6) AS aux_{c}" for c in X8) + """,
  (a.top = b.top)::DOUBLE AS agree, round(x.sim2, 6) AS aux_sim, round(x.sim2 - m.best, 6) AS aux_gap, round(x.sim2 - bdn.density, 6) AS aux_sim_density
  FROM f1 a JOIN bf1 b ON a.q_ord = b.q_ord JOIN p x ON x.q_ord = a.q_ord AND x.g_ord = a.top JOIN (SELECT q_ord, max(sim2) AS best FROM p GROUP BY q_ord) m ON m.q_ord = a.q_ord
  JOIN bdn ON bdn.ord = a.top""", **f1_ctes(), **f1_ctes("emb2", "sim2", "b")))
def f2(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    q2, g2 = second_space(q), second_space(g)
    main = durable(basic_features(q, g), "main")
    nn, others, raw = searched(q2, g2)
    density = durable(features.density(others), "density")
    aux = features.basic(durable(ranked(q2, g2, nn=nn, top=raw), "ranked"), raw, density, "aux_")
    sim = search.pair_scores(main.select("q_ord", F.col("top").alias("g_ord")), q2, g2, "aux_sim").select("q_ord", "aux_sim")
    best = raw.filter("pos = 1").select("q_ord", F.col("sim").alias("_best"))
    dens = density.select(F.col("ord").alias("top"), F.col("density").alias("_d"))
    j = main.join(aux, "q_ord").join(sim, "q_ord").join(best, "q_ord").join(dens, "top")
    out = j.withColumn("agree", (F.col("top") == F.col("aux_top")).cast("double")).withColumn("aux_gap", F.col("aux_sim") - F.col("_best")).withColumn(
        "aux_sim_density", F.col("aux_sim") - F.col("_d"))
    names = [*X8, *["aux_" + c for c in X8], "aux_sim", "aux_gap", "aux_sim_density"]
    return rounded(out.select("q_ord", "agree", *names), *names)


REL = dict(
    st="""SELECT q_ord, avg(sim) AS mean, greatest(stddev_pop(sim), 1e-5) AS std, quantile_cont(sim, [0.25, 0.5, 0.75, 0.9, 0.95]) AS qs, count(*) AS n, list(sim ORDER BY sim DESC, g_ord) AS ss,
          list(g_ord ORDER BY sim DESC, g_ord) AS gs FROM p GROUP BY q_ord""",
    hd="SELECT q_ord, max(g_ord) FILTER (pos = 1) AS top, max(sim) FILTER (pos = 1) AS sel, max(dist) FILTER (pos = 2) - max(dist) FILTER (pos = 1) AS g2, max(dist) FILTER (pos = 5) - max(dist) FILTER (pos = 1) AS g5 FROM kp GROUP BY q_ord",
    an="""SELECT i AS top, avg(s) AS amean, greatest(stddev_pop(s), 1e-5) AS astd, max(s) AS amax, quantile_cont(s, 0.9) AS aq90, list(j ORDER BY s DESC, j) AS nb FROM (
          SELECT a.ord AS i, b.ord AS j, list_inner_product(a.emb, b.emb) AS s FROM g a JOIN g b ON a.ord <> b.ord) GROUP BY i""",
    ar="SELECT h.q_ord, avg(p.sim) AS nmean, max(p.sim) AS nmax FROM hd h JOIN an ON an.top = h.top JOIN p ON p.q_ord = h.q_ord AND list_contains(an.nb[1:5], p.g_ord) GROUP BY h.q_ord",
    ct="""SELECT p.q_ord, count(*) FILTER (sim <= sel) / max(n) AS pct, count(*) FILTER (sim >= sel - 0.5::DOUBLE * std) / max(n) AS n05, count(*) FILTER (sim >= sel - std) / max(n) AS n10,
          count(*) FILTER (sim >= mean + 2 * std) / max(n) AS z2, count(*) FILTER (sim >= mean + 3 * std) / max(n) AS z3 FROM p JOIN st ON st.q_ord = p.q_ord JOIN hd ON hd.q_ord = p.q_ord GROUP BY p.q_ord""")
REL_COLS = [
    "(sel - mean) / std", "(sel - qs[2]) / greatest((qs[3] - qs[1]) / 1.349::DOUBLE, 1e-5)", *[f"(sel - ss[{k}]) / std" for k in (2, 3, 5, 10)],
    *[f"(sel - qs[{k}]) / std" for k in (2, 3, 4, 5)], *[f"(list_avg(ss[1:{k}]) - mean) / std" for k in (3, 5, 10)], "pct", "n05", "n10", "z2", "z3", "g2", "g5",
    "(sel - amean) / astd", "(sel - amax) / astd", "(sel - aq90) / astd",
    *[f"len(list_intersect(list_filter(gs, lambda v: v <> hd.top)[1:{k}], nb[1:{k}])) / {k}" for k in (3, 5, 10)],
    "(nmean - mean) / std", "(nmax - mean) / std", "ln(1 + (SELECT count(*) FROM g))", "(st.q_ord % 3 = 0)::DOUBLE"]


@query("f3_gallery_relative_features", with_ctes("o q g p", "SELECT st.q_ord, hd.top, " + ", ".join(f"round({e}, 6) AS {n}" for e, n in zip(REL_COLS, features.RELATIVE)) + """
  FROM st JOIN hd ON hd.q_ord = st.q_ord JOIN an ON an.top = hd.top JOIN ar ON ar.q_ord = st.q_ord JOIN ct ON ct.q_ord = st.q_ord""", **kr_ctes(3, 2, 0.2), **REL))
def f3(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return rounded(features.relative(q, g, durable(ranked(q, g), "ranked"), night="ord % 3 = 0"), *features.RELATIVE)


def cosine_top(q, g):
    return nearest(q, g, 1).select("q_ord", F.col("g_ord").alias("top"))


@query("f4_local_cluster_features")
def f4(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return features.local_geometry(q, g, cosine_top(q, g))


CUTS = {"DINO_CLS": (1, 22), "DINO_PATCH_MEAN": (23, 22), "CNN_RAW": (45, 20)}


@query("f5_channel_features")
def f5(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return features.channel_evidence(q, g, cosine_top(q, g), CUTS)


def channel_sql() -> dict[str, str]:
    c = {}
    for n, (a, w) in CUTS.items():
        s = f"embedding[{a}:{a + w - 1}]::DOUBLE[]"
        c["u_" + n] = f"SELECT vec_id AS ord, list_transform({s}, lambda x: x / greatest(sqrt(list_inner_product({s}, {s})), 1e-12)) AS u FROM embeddings"
        c["p_" + n] = f"SELECT q.ord AS q_ord, g.ord AS g_ord, list_inner_product(a.u, b.u) AS s FROM q JOIN g ON true JOIN u_{n} a ON a.ord = q.ord JOIN u_{n} b ON b.ord = g.ord"
        c["f_" + n] = f"""SELECT d.q_ord, sel AS {n}_selected_cosine, (sel - m) / sd AS {n}_selected_z, (sel - s2) / sd AS {n}_gap2_z, pct AS {n}_selected_percentile, sd AS {n}_query_similarity_std FROM d
          JOIN (SELECT x.q_ord, max(y.s) AS sel, avg(x.s) AS m, greatest(stddev_pop(x.s), 1e-5) AS sd, list(x.s ORDER BY x.s DESC)[2] AS s2, count(*) FILTER (x.s <= y.s) / count(*) AS pct
                FROM p_{n} x JOIN d dd ON dd.q_ord = x.q_ord JOIN p_{n} y ON y.q_ord = x.q_ord AND y.g_ord = dd.g_ord GROUP BY x.q_ord) z ON z.q_ord = d.q_ord"""
    a, b, e = CUTS
    c["ch"] = f"SELECT * FROM f_{a} JOIN f_{b} USING (q_ord) JOIN f_{e} USING (q_ord)"
    return c


STATS = [f"{n}_{f}" for n in CUTS for f in features.CHANNEL[:5]]


@query("f5_channel_statistics", with_ctes("o q g p r d", "SELECT q_ord, " + ", ".join(f"round({c}, 6) AS {c}" for c in STATS) + " FROM ch", **channel_sql()))
def f5_stats(spark, sf_dir):
    return rounded(f5(spark, sf_dir).select("q_ord", *STATS), *STATS)


@query("f14_evidence_gates", with_ctes("o q g p r d", "SELECT q_ord, unnest([" + ", ".join(f"'{n}'" for n in policies.evidence_rules()) + "]) AS rule, unnest([" +
       ", ".join(c.replace("`", '"') for c in policies.evidence_rules().values()) + "]) AS passed FROM ch", **channel_sql()))
def f14(spark, sf_dir):
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.expr(c).alias("passed")) for n, c in policies.evidence_rules().items()])
    return f5(spark, sf_dir).select("q_ord", F.explode(rules).alias("_r")).select("q_ord", "_r.rule", "_r.passed")


@query("f15_evidence_correction", with_ctes("o q g p r d", """
SELECT ch.q_ord, round(1 / (1 + exp(-(12 * conf - 4.2::DOUBLE + 0.3::DOUBLE * 4 * (DINO_PATCH_MEAN_selected_cosine - CNN_RAW_selected_cosine)))), 6) AS corrected
FROM ch JOIN d ON d.q_ord = ch.q_ord""", **channel_sql()))
def f15(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    top = nearest(q, g, 1).select("q_ord", "g_ord", F.col("sim").alias("conf"))
    cut = lambda df, n: df.withColumn("emb", F.slice("emb", *CUTS[n]))
    for n in ("DINO_PATCH_MEAN", "CNN_RAW"):
        top = search.pair_scores(top, cut(q, n), cut(g, n), n)
    p = cal.sigmoid(12.0 * F.col("conf") - 4.2)
    return top.select("q_ord", F.round(policies.corrected_score(p, F.col("DINO_PATCH_MEAN"), F.col("CNN_RAW"), 0.3), 6).alias("corrected"))


@query("f6_alternative_candidate", with_ctes("o q g p", """
SELECT h.q_ord, w::INTEGER AS width, h.top, (SELECT min_by(k.g_ord, k.pos) FROM kp k JOIN an ON an.top = h.top WHERE k.q_ord = h.q_ord AND k.g_ord <> h.top AND NOT list_contains(an.nb[1:w-1], k.g_ord)) AS alternative, true AS valid
FROM hd h JOIN (SELECT unnest([3, 5]) AS w) ON true""", **kr_ctes(3, 2, 0.2), hd=REL["hd"], an=REL["an"]))
def f6(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    nn, others, top = searched(q, g)
    return features.alternatives(g, ranked(q, g, nn=nn, top=top), (3, 5), others).select("q_ord", "width", "top", "alternative", "valid")


def evidence_table(spark, sf_dir) -> DataFrame:
    """Decisions with fixed logistic scores standing in for trained heads."""
    q, g = sides(spark, sf_dir)
    d = search.decisions(q, g)
    c = F.col("conf")
    p2 = cal.sigmoid(12.0 * c - 4.2)
    return d.select(
        "q_ord", "g_ord", "conf", "correct", "has_match", "vehicle_id", (F.col("q_ord") % 3 == 0).alias("night"), p2.alias("p2"), ((1.0 - p2) * 0.9).alias("p0"),
        cal.sigmoid(9.0 * c - 3.0).alias("s1"), cal.sigmoid(20.0 * c - 7.2).alias("s2"), cal.sigmoid(6.0 * c - 1.9).alias("s3"))


SG = "1 / (1 + exp(-({0})))"
EV = f"""SELECT q_ord, conf, q_ord % 3 = 0 AS night, {SG.format('12 * conf - 4.2::DOUBLE')} AS p2, (1 - {SG.format('12 * conf - 4.2::DOUBLE')}) * 0.9::DOUBLE AS p0,
       {SG.format('9 * conf - 3')} AS s1, {SG.format('20 * conf - 7.2::DOUBLE')} AS s2, {SG.format('6 * conf - 1.9::DOUBLE')} AS s3 FROM d"""
B = 0.55


def lg(x):
    return f"ln(({x}) / (1 - ({x})))"


def moved(p, cut, b=B):
    z = SG.format(f"{lg(p)} - {lg(str(cut) + '::DOUBLE')} + {lg(str(b) + '::DOUBLE')}")
    return f"CASE WHEN {p} >= {cut} THEN greatest({z}, {b}) ELSE least({z}, {b} - 1.2e-16) END"


@query("f10_three_class_odds", with_ctes("o q g p r d", f"""
SELECT q_ord, round(p2 / greatest(p0 + p2, 1e-15), 6) AS odds, round({SG.format('(ln(p2) - ln(p0)) / 1.5::DOUBLE - 0.2::DOUBLE')}, 6) AS calibrated FROM ev""", ev=EV))
def f10(spark, sf_dir):
    e = evidence_table(spark, sf_dir)
    return e.select("q_ord", F.round(cal.three_class_odds(F.col("p0"), F.col("p2")), 6).alias("odds"),
                    F.round(cal.calibrated_odds(F.col("p0"), F.col("p2"), 1.5, 0.2), 6).alias("calibrated"))


LEGACY = f"SELECT *, CASE WHEN night THEN {moved('s2', 0.6)} ELSE {moved('(p2 / greatest(p0 + p2, 1e-15))', 0.5)} END AS c0 FROM ev"


def legacy(e: DataFrame) -> DataFrame:
    conf = policies.two_route(F.col("night"), (1.0 - F.col("s2"), F.col("s2")), (F.col("p0"), F.col("p2")), 0.6, 0.5, B)
    return e.withColumn("confidence", conf).withColumn("accepted", F.col("confidence") >= B)


@query("f11_two_route_decision", with_ctes("o q g p r d", f"SELECT q_ord, round(c0, 6) AS confidence, c0 >= {B} AS accepted FROM lc", ev=EV, lc=LEGACY))
def f11(spark, sf_dir):
    return legacy(evidence_table(spark, sf_dir)).select("q_ord", r6("confidence"), "accepted")


def stage_sql(n: int, score: str, cut: float, scope: str, src: str) -> str:
    z = SG.format(f"{lg(score)} - {lg(str(cut) + '::DOUBLE')} + {lg(str(B) + '::DOUBLE')}")
    return f"SELECT *, CASE WHEN c{n - 1} < {B} AND {score} >= {cut} AND {scope} THEN greatest({z}, {B}) ELSE c{n - 1} END AS c{n} FROM {src}"


@query("f12_supplement", with_ctes("o q g p r d", f"SELECT q_ord, round(c1, 6) AS confidence, c1 >= {B} AS accepted FROM t1", ev=EV, lc=LEGACY, t1=stage_sql(1, "s1", 0.52, "NOT night", "lc")))
def f12(spark, sf_dir):
    e = policies.supplement(legacy(evidence_table(spark, sf_dir)), F.col("s1"), 0.52, B, ~F.col("night"))
    return policies.checked(e, B).select("q_ord", r6("confidence"), "accepted")


CHAIN = dict(ev=EV, lc=LEGACY, t1=stage_sql(1, "s1", 0.52, "NOT night", "lc"), t2=stage_sql(2, "s2", 0.45, "NOT night", "t1"), t3=stage_sql(3, "s3", 0.54, "true", "t2"))
STAGES = [("raw", "s1", 0.52, "not night"), ("bagged", "s2", 0.45, "not night"), ("expanded", "s3", 0.54, "true")]


@query("f13_policy_chain", with_ctes("o q g p r d", f"""
SELECT q_ord, round(c3, 6) AS confidence, c3 >= {B} AS accepted, CASE WHEN c0 >= {B} THEN 'base' WHEN c1 >= {B} THEN 'raw' WHEN c2 >= {B} THEN 'bagged' WHEN c3 >= {B} THEN 'expanded' END AS accepted_by FROM t3""", **CHAIN))
def f13(spark, sf_dir):
    stages = [policies.Stage(n, (lambda df, s=s: df.withColumn("score", F.col(s))), cut, scope) for n, s, cut, scope in STAGES]
    e = durable(legacy(evidence_table(spark, sf_dir)), "evidence")
    return policies.run_chain(e, stages, B).select("q_ord", r6("confidence"), "accepted", "accepted_by")


@query("f16_rescue_guard", with_ctes("o q g p r d", f"""
SELECT q_ord, blocked, round(CASE WHEN blocked THEN c0 ELSE c3 END, 6) AS confidence, c3 >= {B} AND NOT blocked AS accepted FROM (
  SELECT *, c3 >= {B} AND c0 < {B} AND NOT night AND p0 >= 0.5 * 0.9 AND s3 < 0.9 AND conf < 0.34 AS blocked FROM t3)""".replace("p0 >= 0.5 * 0.9", "p0 / 0.9::DOUBLE + 0.28::DOUBLE >= 0.8"), **CHAIN))
def f16(spark, sf_dir):
    base = legacy(evidence_table(spark, sf_dir)).withColumn("before", F.col("accepted")).withColumn("conf_before", F.col("confidence"))
    out = policies.chain_columns(base, [(n, F.col(s), cut, F.expr(scope)) for n, s, cut, scope in STAGES], B)
    # The guard's absent probability and raw cosine come from other heads; here from fixed forms of p0 and conf.
    absent, raw = F.col("p0") / 0.9 + 0.28, F.col("conf") + 0.11
    blocked = policies.contradictory_rescue(absent, F.col("s3"), raw, F.col("night"), F.col("before"), F.col("accepted"))
    g = out.withColumn("blocked", blocked)
    return g.select("q_ord", "blocked", F.round(F.when(F.col("blocked"), F.col("conf_before")).otherwise(F.col("confidence")), 6).alias("confidence"),
                    (F.col("accepted") & ~F.col("blocked")).alias("accepted"))


@query("f7_contrast_features")
def f7(spark, sf_dir):
    """Channel features of the candidate with its own, the alternative's and the relative score."""
    q, g = sides(spark, sf_dir)
    nn, others, best = searched(q, g)
    alt = features.alternatives(g, ranked(q, g, nn=nn, top=best), others=others).select("q_ord", F.col("alternative").alias("g_ord"))
    other = graph.allowed_cosine(alt, q, g, Plan(exclude=())).select("q_ord", cal.sigmoid(12.0 * F.col("sim") - 4.2).alias("other"))
    top = best.filter("pos = 1").select("q_ord", cal.sigmoid(12.0 * F.col("sim") - 4.2).alias("own"))
    return f5(spark, sf_dir).join(top, "q_ord").join(other, "q_ord").withColumn("contrast", cal.relative_odds(F.col("own"), F.col("other")))


def pair_columns(q, g, top, n=8) -> DataFrame:
    """Squared differences and products of whitened projections of a query and its candidate."""
    pca = compress.fit_pca(g, n, whiten=True)
    proj = lambda df, k: compress.project(df, pca).select(F.col("ord").alias(k), F.transform("z", lambda x: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x))).alias("z_" + k))
    j = top.join(proj(q, "q_ord"), "q_ord").join(proj(g, "top"), "top")
    d = subtract(F.col("z_q_ord"), F.col("z_top"))
    return j.select("q_ord", "top", F.concat(F.transform(d, lambda x: x * x), F.zip_with("z_q_ord", "z_top", lambda a, b: a * b)).alias("pair"))


@query("f8_pair_features")
def f8(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return pair_columns(q, g, cosine_top(q, g))


@query("f9_rescue_feature_sets")
def f9(spark, sf_dir):
    """Channel, local and pair features of refused queries as one vector per query."""
    q, g = sides(spark, sf_dir)
    d = durable(search.decisions(q, g).select("q_ord", F.col("g_ord").alias("top"), "conf"), "decisions")
    refused = durable(d.filter(F.col("conf") < THRESHOLD), "refused")
    qr = q.join(refused.select(F.col("q_ord").alias("ord")), "ord", "left_semi")
    ch = features.channel_evidence(qr, g, refused, CUTS)
    cols = [c for c in ch.columns if c not in ("q_ord", "top")]
    loc = features.local_geometry(qr, g, refused)
    j = ch.join(loc, "q_ord").join(pair_columns(qr, g, refused.select("q_ord", "top")).drop("top"), "q_ord").join(refused.select("q_ord", "conf"), "q_ord")
    return j.select("q_ord", F.concat(F.array(*[F.col(c) for c in cols + list(features.LOCAL)]), "pair", F.array("conf")).alias("features"))


STYLED = dict(
    ev=EV, lc=LEGACY,
    sup=f"""SELECT avg({SG.format('4 + 3 * emb[1]')}) >= 0.8 AND 60 * (avg(emb[1])**2 + avg(emb[2])**2 + avg(emb[3])**2) * least(count(*), 128) <= 25 AS ok FROM g""",
    st=f"SELECT l.*, CASE WHEN {SG.format('4 + 3 * q.emb[1]')} >= 0.8 THEN s3 ELSE 1e-9 END AS sc, (SELECT ok FROM sup) AS ok FROM lc l JOIN q ON q.ord = l.q_ord",
    t1=stage_sql(1, "sc", 0.5, "ok", "st"))


@query("f17_style_supported_calibration", with_ctes("o q g p r d", f"SELECT q_ord, round(c1, 6) AS confidence, c1 >= {B} AS accepted, ok AS supported FROM t1", **STYLED))
def f17(spark, sf_dir):
    """Supplement used only if the gallery looks like a known style and the query agrees."""
    q, g = sides(spark, sf_dir)
    dims = ["s0", "s1d", "s2d"]
    desc = lambda df: df.select("ord", *[F.element_at(unit(F.col("emb")), i + 1).alias(d) for i, d in enumerate(dims)])
    gate = policies.style_support(desc(g), dims, [0.0, 0.0, 0.0], [[60.0, 0, 0], [0, 60.0, 0], [0, 0, 60.0]])
    prob = lambda df: df.withColumn("style", cal.sigmoid(4.0 + 3.0 * F.col("s0")))
    mean = prob(desc(g)).agg(F.avg("style").alias("m")).scalar()
    supported = (mean >= 0.8) & (gate.scalar() <= 25.0)
    e = legacy(evidence_table(spark, sf_dir)).join(prob(desc(q)).select(F.col("ord").alias("q_ord"), "style"), "q_ord").withColumn("supported", supported)
    score = F.when(F.col("style") >= 0.8, F.col("s3")).otherwise(F.lit(0.0))
    return policies.supplement(e, score, 0.5, B, F.col("supported")).select("q_ord", r6("confidence"), "accepted", "supported")


HYBRID = dict(ev=EV, lc=LEGACY, t1=stage_sql(1, "s1", 0.56, "true", "lc"), t2=stage_sql(2, "s3", 0.55, "true", "t1"), t3=stage_sql(3, "s2", 0.5, "true", "t2"))


@query("f18_hybrid_fold", with_ctes("o q g p r d", f"""
SELECT q_ord, round(c3, 6) AS confidence, c3 >= {B} AS accepted, CASE WHEN c0 >= {B} THEN 'base' WHEN c1 >= {B} THEN 'quality' WHEN c2 >= {B} THEN 'local' WHEN c3 >= {B} THEN 'tail' END AS accepted_by FROM t3""", **HYBRID))
def f18(spark, sf_dir):
    """Quality, then local, then tail: each only where the ones before refused."""
    stages = [policies.Stage("quality", lambda df: df.withColumn("score", F.col("s1")), 0.56), policies.Stage("local", lambda df: df.withColumn("score", F.col("s3")), 0.55),
              policies.Stage("tail", lambda df: df.withColumn("score", F.col("s2")), 0.5)]
    return policies.run_chain(durable(legacy(evidence_table(spark, sf_dir)), "evidence"), stages, B).select("q_ord", r6("confidence"), "accepted", "accepted_by")


@query("f19_trained_heads")
def f19(spark, sf_dir):
    """Two heads trained on the basic features of one identity half and applied to the other."""
    q, g = sides(spark, sf_dir)
    lists = searched(q, g)
    x = basic_features(q, g, lists=lists).join(search.decisions(q, g, top=lists[2]).select("q_ord", "vehicle_id", "has_match", "correct"), "q_ord")
    x = durable(splits.halves(x.withColumn("label", (F.col("has_match") & F.col("correct")).cast("double")), 0), "training")
    vec = VectorAssembler(inputCols=list(X8), outputCol="features")
    out = x.select("q_ord", "half", "label")
    for name, head in {"logistic": LogisticRegression(maxIter=20, regParam=0.01), "forest": RandomForestClassifier(numTrees=20, maxDepth=4, seed=7)}.items():
        model = Pipeline(stages=[vec, head]).fit(x.filter("half = 'A'"))
        out = out.join(model.transform(x).select("q_ord", vector_to_array("probability")[1].alias("p_" + name)), "q_ord")
    return out.filter("half = 'B'")


FOLDS = 3


def head_rows(spark, sf_dir) -> DataFrame:
    q, g = sides(spark, sf_dir)
    lists = searched(q, g)
    x = basic_features(q, g, lists=lists).join(search.decisions(q, g, top=lists[2]).select("q_ord", "vehicle_id", "has_match", "correct"), "q_ord")
    return x.withColumn("label", (F.col("has_match") & F.col("correct")).cast("double"))


@query("f19_cross_fitted_heads")
def f19_cross(spark, sf_dir):
    """Out-of-fold scores of logistic, boosted and extra-trees heads; no identity is in two folds."""
    return heads.cross_fit(head_rows(spark, sf_dir), X8, "vehicle_id", ["q_ord"], folds=FOLDS)


@query("f19_identity_folds", with_ctes("o q g p r d", f"""
SELECT ('0x' || substr(md5('0:' || vehicle_id), 1, 8))::BIGINT % {FOLDS} AS fold, count(*) AS n, count(DISTINCT vehicle_id) AS identities, sum((has_match AND correct)::INT)::DOUBLE AS positives, 0::BIGINT AS shared
FROM d GROUP BY 1"""))
def f19_folds(spark, sf_dir):
    """What each fold of the cross-fit holds, and how many of its identities are in another fold too."""
    q, g = sides(spark, sf_dir)
    d = search.decisions(q, g).select("vehicle_id", (F.col("has_match") & F.col("correct")).cast("double").alias("label"), heads.group_folds(F.col("vehicle_id"), FOLDS).cast("long").alias("fold"))
    d = durable(d, "folds")
    spread = d.groupBy("vehicle_id").agg(F.countDistinct("fold").alias("n_folds"))
    return d.join(spread, "vehicle_id").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("vehicle_id").alias("identities"), F.sum("label").alias("positives"),
        F.countDistinct(F.when(F.col("n_folds") > 1, F.col("vehicle_id"))).alias("shared"))


@query("f20_bound_before_costly_features", with_ctes("o q g p r d", f"SELECT q_ord, s1 * s3 >= 0.3 AS accepted FROM ev", ev=EV))
def f20(spark, sf_dir):
    """Rows whose cheap upper bound misses the cut never reach the costly score."""
    e = durable(evidence_table(spark, sf_dir).select("q_ord", "s1", "s3"), "evidence")
    # s3 <= 1, so s1 bounds the product.
    maybe = e.filter(F.col("s1") >= 0.3).withColumn("accepted", F.col("s1") * F.col("s3") >= 0.3)
    return maybe.select("q_ord", "accepted").unionByName(e.filter(F.col("s1") < 0.3).select("q_ord", F.lit(False).alias("accepted")))


@query("u2_policy_protocol", with_ctes("o q g p r d", f"SELECT q_ord, c0 >= {B} OR s3 >= 0.6 AS accepted FROM lc", ev=EV, lc=LEGACY))
def u2(spark, sf_dir):
    """Any callable from decisions to decisions with ``score`` is a policy."""
    policy = lambda df: df.withColumn("score", F.col("s3"))
    e = durable(legacy(evidence_table(spark, sf_dir)), "evidence")
    return policies.run_chain(e, [policies.Stage("custom", policy, 0.6)], B).select("q_ord", "accepted")


@query("r22_proposal_for_refused", with_ctes("o q g p r d", f"""
SELECT d.q_ord, coalesce(m.g_ord, d.g_ord) AS g_ord, m.g_ord IS NOT NULL AS proposed FROM d LEFT JOIN (
  SELECT q_ord, g_ord, row_number() OVER (PARTITION BY q_ord ORDER BY x.score DESC, g_ord) AS z FROM x) m ON m.q_ord = d.q_ord AND m.z = 1 AND d.conf < {THRESHOLD}""", x=RRF))
def r22(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    d = durable(search.decisions(q, g).select("q_ord", F.col("g_ord").alias("old"), "conf"), "decisions")
    refused = d.filter(F.col("conf") < THRESHOLD).select(F.col("q_ord").alias("ord"))
    qr = durable(q.join(refused, "ord", "left_semi"), "refused")
    new = search.reciprocal_rank_fusion(qr, g, second_space(qr), second_space(g), 1).select("q_ord", "g_ord")
    return d.join(new, "q_ord", "left").select("q_ord", F.coalesce("g_ord", "old").alias("g_ord"), F.col("g_ord").isNotNull().alias("proposed"))


@query("r21_gated_tail_reorder", with_ctes("o q g p", """
SELECT q_ord, CASE WHEN len(list_intersect(a, b)) / 10 <= 0.5 THEN list_concat(a[1:3], list_filter(b, lambda v: NOT list_contains(a[1:3], v)))[1:10] ELSE a END AS ranking,
       len(list_intersect(a, b)) / 10 <= 0.5 AS reordered FROM (
  SELECT q_ord, list(g_ord ORDER BY p1) FILTER (p1 <= 10) AS a, list(g_ord ORDER BY p2) FILTER (p2 <= 10) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) AS p1, row_number() OVER (PARTITION BY q_ord ORDER BY x.score DESC, g_ord) AS p2 FROM x) GROUP BY q_ord)""",
    x=RRF.replace("0.65::DOUBLE", "(1 - 0.7::DOUBLE)").replace("0.35", "0.7")))
def r21(spark, sf_dir):
    """Keep the first three, reorder the rest by the fused proposal where the predicted gain is high enough."""
    from matchbook.operators.fusion import merge_keeping_prefix, ranked_list
    q, g = sides(spark, sf_dir)
    a = ranked_list(nearest(q, g, 10), "a")
    b = ranked_list(search.reciprocal_rank_fusion(q, g, second_space(q), second_space(g), 10, alpha=0.7), "b")
    gain = 1.0 - F.size(F.array_intersect("a", "b")) / 10.0
    j = a.join(b, "q_ord").withColumn("reordered", gain >= 0.5)
    return j.select("q_ord", F.when(F.col("reordered"), merge_keeping_prefix(F.col("a"), F.col("b"), 3)).otherwise(F.col("a")).alias("ranking"), "reordered")
