"""Stress, transfer, size and comparison studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchbook.model import observations, second_space, table
from matchbook.operators import bootstrap, metrics, ranks, refusal, search, splits
from matchbook.operators.similarity import FRAME, JUNK, Plan, nearest
from matchbook.plans.evaluation import CURVE, MEASURES, SCORED, TRUTH, ap10_ctes, emitted_top, rounded
from matchbook.plans.registry import query, with_ctes
from matchbook.plans.searching import THRESHOLD, r6, sides
from matchbook.plans.splitting import COHORT, EPISODES_SQL, H, KEEP, growth, growth_sql, ids_sql
from matchbook.session import durable

# ---- stress scenarios ------------------------------------------------------------------------

GRID = [round(0.20 + 0.01 * i, 2) for i in range(32)]
GRID_SQL = "SELECT unnest(list_transform(range(20, 52), lambda i: i / 100.0))::DOUBLE AS t"
SCENARIOS = dict(
    da="""SELECT r.q_ord, r.sim AS conf, r.g_vehicle_id = r.q_vehicle_id AS correct,
                 EXISTS (SELECT 1 FROM g WHERE g.vehicle_id = r.q_vehicle_id) AS has_match FROM r WHERE pos = 1""",
    db="""SELECT x.q_ord, x.conf, x.correct, nv.n_valid > 0 AS has_match FROM (
            SELECT q_ord, sim AS conf, g_vehicle_id = q_vehicle_id AS correct, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) AS z
            FROM p WHERE NOT (q_vehicle_id = g_vehicle_id AND q_camera_id = g_camera_id)) x JOIN nv ON nv.q_ord = x.q_ord WHERE z = 1""",
    th=GRID_SQL,
    ca=CURVE.format(conf="da", ths="th"), sa=SCORED.format("ca"), cb=CURVE.format(conf="db", ths="th"), sb=SCORED.format("cb"),
    st="""SELECT sa.threshold, sa.score AS score_a, sb.score AS score_b, least(sa.score, sb.score) AS worst,
                 0.85::DOUBLE * sa.score + (1 - 0.85::DOUBLE) * sb.score AS expected FROM sa JOIN sb ON sa.threshold = sb.threshold""")


def scenarios(q, g) -> DataFrame:
    """Decisions under scenario A (as is) and B (same identity and camera removed), stacked."""
    every = search.identity_counts(g, ["vehicle_id"])
    in_gallery = q.join(every, "vehicle_id", "left").select(F.col("ord").alias("q_ord"), F.col("_n").isNotNull().alias("has_match"))
    cross = search.valid_positives(q, g).select("q_ord", (F.col("n_valid") > 0).alias("has_match"))

    def one(name, exclude, has):
        top = nearest(q, g, 10, Plan(exclude=exclude), TRUTH, TRUTH)
        m = refusal.measures(top)
        ok = top.filter("pos = 1").select("q_ord", (F.col("g_vehicle_id") == F.col("q_vehicle_id")).alias("correct"))
        return m.join(ok, "q_ord").join(has, "q_ord").withColumn("scenario", F.lit(name))

    return durable(one("A", (FRAME,), in_gallery).unionByName(one("B", (FRAME, JUNK), cross)), "scenarios")


def fixed_grid(df: DataFrame, values, keys) -> DataFrame:
    ths = F.array(*[F.lit(v) for v in values])
    return df.select(*keys).distinct().withColumn("ths", ths)


def stress_rows(q, g, belief=0.85) -> DataFrame:
    s = scenarios(q, g).withColumn("conf", F.col("top1"))
    c = refusal.sweep(s, fixed_grid(s, GRID, ["scenario"]), ["scenario"])
    at = lambda n: F.max(F.when(F.col("scenario") == n, F.col("score")))
    return c.groupBy("threshold").agg(at("A").alias("score_a"), at("B").alias("score_b")).withColumn(
        "worst", F.least("score_a", "score_b")).withColumn("expected", belief * F.col("score_a") + (1 - belief) * F.col("score_b"))


@query("a15_stress_scenarios", with_ctes("o q g p r nv", """
SELECT round(threshold, 6) AS threshold, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, round(worst, 6) AS worst, round(expected, 6) AS expected FROM st""", **SCENARIOS))
def a15(spark, sf_dir):
    return rounded(stress_rows(*sides(spark, sf_dir)), "threshold", "score_a", "score_b", "worst", "expected")


@query("a16_threshold_decision", with_ctes("o q g p r nv", """
SELECT round(b.threshold, 6) AS value, round(a.threshold, 6) AS optimum_a, round(m.threshold, 6) AS minimax,
       b.threshold IN (SELECT min(threshold) FROM st UNION ALL SELECT max(threshold) FROM st) AS on_grid_edge,
       round(CASE WHEN (b.score_a - m.score_a) + (m.score_b - b.score_b) > 0
             THEN (m.score_b - b.score_b) / ((b.score_a - m.score_a) + (m.score_b - b.score_b)) END, 6) AS indifference
FROM (SELECT * FROM st ORDER BY st.expected DESC, threshold LIMIT 1) b JOIN (SELECT * FROM st ORDER BY st.score_a DESC, threshold LIMIT 1) a ON true
JOIN (SELECT * FROM st ORDER BY st.worst DESC, threshold LIMIT 1) m ON true""", **SCENARIOS))
def a16(spark, sf_dir):
    rows = stress_rows(*sides(spark, sf_dir))
    row = F.struct("threshold", "score_a", "score_b")
    pick = lambda by: F.max_by(row, F.struct(F.col(by), -F.col("threshold")))
    m = rows.agg(pick("expected").alias("b"), pick("score_a").alias("a"), pick("worst").alias("m"),
                 F.min("threshold").alias("lo"), F.max("threshold").alias("hi"))
    da, db = F.col("b.score_a") - F.col("m.score_a"), F.col("m.score_b") - F.col("b.score_b")
    return m.select(
        F.round("b.threshold", 6).alias("value"), F.round("a.threshold", 6).alias("optimum_a"), F.round("m.threshold", 6).alias("minimax"),
        ((F.col("b.threshold") == F.col("lo")) | (F.col("b.threshold") == F.col("hi"))).alias("on_grid_edge"),
        F.round(F.when(da + db > 0, db / (da + db)), 6).alias("indifference"))


NAMES = ["top1", "margin", "gap_to_rest", "ratio"]
A17_SQL = dict(
    rb="""SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) AS pos FROM p WHERE NOT (q_vehicle_id = g_vehicle_id AND q_camera_id = g_camera_id)""",
    ma=MEASURES.format("r"), mb=MEASURES.format("rb"),
    **{k: v for k, v in SCENARIOS.items() if k in ("da", "db")},
    lo="""SELECT 'A' AS scenario, q_ord, has_match, correct, unnest(['top1', 'margin', 'gap_to_rest', 'ratio']) AS measure,
                 unnest([top1, margin, gap_to_rest, ratio]) AS conf FROM ma JOIN da USING (q_ord)
          UNION ALL SELECT 'B', q_ord, has_match, correct, unnest(['top1', 'margin', 'gap_to_rest', 'ratio']), unnest([top1, margin, gap_to_rest, ratio]) FROM mb JOIN db USING (q_ord)""",
    th="SELECT DISTINCT measure, unnest(quantile_cont(conf, list_transform(range(0, 160), lambda i: i / 159.0))) AS t FROM lo WHERE scenario = 'A' GROUP BY measure",
    ct="""SELECT scenario, lo.measure, t AS threshold, count(*) FILTER (conf >= t AND has_match AND correct) AS tp,
               count(*) FILTER (conf >= t AND NOT (has_match AND correct)) AS fp, count(*) FILTER (conf < t AND has_match) AS fn,
               count(*) FILTER (conf < t AND NOT has_match) AS tn, count(*) FILTER (NOT has_match) AS neg FROM lo JOIN th ON th.measure = lo.measure GROUP BY ALL""",
    cv="SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, tn / greatest(neg, 1) AS tnr FROM ct",
    sc=SCORED.format("cv"),
    ab="SELECT a.measure, a.threshold, a.score AS score_a, b.score AS score_b, 0.7::DOUBLE * a.score + (1 - 0.7::DOUBLE) * b.score AS e FROM sc a JOIN sc b ON a.measure = b.measure AND a.threshold = b.threshold AND a.scenario = 'A' AND b.scenario = 'B'",
    ga="SELECT * FROM ab QUALIFY row_number() OVER (PARTITION BY measure ORDER BY ab.score_a DESC, threshold) = 1",
    ge="SELECT * FROM ab QUALIFY row_number() OVER (PARTITION BY measure ORDER BY e DESC, threshold) = 1",
    md="SELECT measure, max(CASE WHEN scenario = 'A' THEN x END) AS median_a, max(CASE WHEN scenario = 'B' THEN x END) AS median_b FROM (SELECT measure, scenario, quantile_cont(conf, 0.5) AS x FROM lo GROUP BY ALL) GROUP BY measure")


@query("a17_confidence_measure_stress", with_ctes("o q g p r nv", """
SELECT ga.measure, round(ga.threshold, 6) AS threshold_on_a, round(ga.score_a, 6) AS score_a, round(ga.score_b, 6) AS score_b,
       round(ge.threshold, 6) AS threshold_tuned, round(ge.e, 6) AS expected, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b
FROM ga JOIN ge ON ga.measure = ge.measure JOIN md ON md.measure = ga.measure""", **A17_SQL))
def a17(spark, sf_dir):
    s = scenarios(*sides(spark, sf_dir))
    long = durable(s.unpivot(["scenario", "q_ord", "has_match", "correct"], NAMES, "measure", "conf"), "measures")
    ths = refusal.quantile_grid(long.filter("scenario = 'A'"), 160, ["measure"])
    both = durable(long.select("measure", "scenario").distinct().join(ths, "measure"), "grids")
    c = refusal.sweep(long, both, ["measure", "scenario"])
    at = lambda n: F.max(F.when(F.col("scenario") == n, F.col("score")))
    ab = c.groupBy("measure", "threshold").agg(at("A").alias("score_a"), at("B").alias("score_b")).withColumn(
        "e", 0.7 * F.col("score_a") + (1 - 0.7) * F.col("score_b"))
    row = F.struct("threshold", "score_a", "score_b", "e")
    pick = ab.groupBy("measure").agg(
        F.max_by(row, F.struct("score_a", -F.col("threshold"))).alias("a"), F.max_by(row, F.struct("e", -F.col("threshold"))).alias("t"))
    med = ranks.quantile_rows(long, "conf", [0.5], ["measure", "scenario"]).groupBy("measure").agg(
        F.max(F.when(F.col("scenario") == "A", F.col("x"))).alias("median_a"), F.max(F.when(F.col("scenario") == "B", F.col("x"))).alias("median_b"))
    return pick.join(med, "measure").select(
        "measure", F.round("a.threshold", 6).alias("threshold_on_a"), F.round("a.score_a", 6).alias("score_a"), F.round("a.score_b", 6).alias("score_b"),
        F.round("t.threshold", 6).alias("threshold_tuned"), F.round("t.e", 6).alias("expected"), r6("median_a"), r6("median_b"))


@query("a18_score_transfer", with_ctes("o q g p r", f"""
SELECT round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(quantile_cont(a, 0.5), 6) AS median_a, round(quantile_cont(b, 0.5), 6) AS median_b,
       round(quantile_cont(a, 0.05), 6) AS p5_a, round(quantile_cont(b, 0.95), 6) AS p95_b, round(avg((a < {THRESHOLD})::INT), 6) AS refuse_a,
       round(avg((b < {THRESHOLD})::INT), 6) AS refuse_b, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman,
       round(max(mt.t), 6) AS matched_threshold, count(*) FILTER ((b < {THRESHOLD}) <> (b < mt.t)) AS flips
FROM rk JOIN mt ON true""",
    c="SELECT q_ord, max(sim) AS a, max(sim2) AS b FROM p GROUP BY q_ord",
    rk="SELECT *, row_number() OVER (ORDER BY a, q_ord) AS ra, row_number() OVER (ORDER BY b, q_ord) AS rb FROM c",
    mt=f"""SELECT CASE WHEN m > 0 THEN l[floor(h)::BIGINT + 1] + (l[ceil(h)::BIGINT + 1] - l[floor(h)::BIGINT + 1]) * (h - floor(h)) ELSE -9 END AS t FROM (
           SELECT l, m, m * (len(l) - 1) AS h FROM (SELECT list(b ORDER BY b) AS l, count(*) FILTER (a < {THRESHOLD}) / count(*) AS m FROM c))"""))
def a18(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    a = nearest(q, g, 1).select("q_ord", F.col("sim").alias("a"))
    b = nearest(second_space(q), second_space(g), 1).select("q_ord", F.col("sim").alias("b"))
    c = durable(a.join(b, "q_ord"), "two-scores")
    r = ranks.running(c, "a", "q_ord", settled=True).withColumnRenamed("rank", "ra").select("q_ord", "a", "b", "ra")
    r = ranks.running(r, "b", "q_ord").withColumnRenamed("rank", "rb").drop("total")
    refuse = lambda x: F.avg((F.col(x) < THRESHOLD).cast("int").cast("double"))
    rate = c.agg(refuse("a").alias("m")).first()["m"]
    matched = ranks.quantiles(c, "b", {"t": rate}).first()["t"] if rate > 0 else -9.0
    qa = ranks.quantiles(c, "a", {"median_a": 0.5, "p5_a": 0.05}).first()
    qb = ranks.quantiles(c, "b", {"median_b": 0.5, "p95_b": 0.95}).first()
    lit = lambda v: F.round(F.lit(float(v)), 6)
    return r.agg(
        F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(refuse("a"), 6).alias("refuse_a"),
        F.round(refuse("b"), 6).alias("refuse_b"), F.round(F.corr("a", "b"), 6).alias("pearson"),
        F.round(F.corr(F.col("ra").cast("double"), F.col("rb").cast("double")), 6).alias("spearman"),
        F.sum(((F.col("b") < THRESHOLD) != (F.col("b") < matched)).cast("long")).alias("flips"),
    ).select("*", lit(qa["median_a"]).alias("median_a"), lit(qb["median_b"]).alias("median_b"), lit(qa["p5_a"]).alias("p5_a"),
             lit(qb["p95_b"]).alias("p95_b"), lit(matched).alias("matched_threshold"))


@query("a26_refusal_audit", with_ctes("o q g p r d", """
SELECT rule, part, tp, fp, fn, tn, round(score, 6) AS score FROM au""",
    ids=ids_sql(0, "q"),
    dh="SELECT d.*, CASE WHEN rank <= total // 2 THEN 'A' ELSE 'B' END AS half FROM d JOIN ids ON ids.vehicle_id = d.vehicle_id",
    dx="SELECT * FROM dh WHERE half = 'A'",
    th="SELECT DISTINCT conf AS t FROM dx UNION SELECT max(conf) + 1e-9 FROM dx",
    cv=CURVE.format(conf="dx", ths="th"), sc=SCORED.format("cv"),
    rl=f"""SELECT 'frozen' AS rule, {THRESHOLD}::DOUBLE AS t UNION ALL
          SELECT 'chosen', (SELECT threshold FROM sc ORDER BY sc.score DESC, tnr DESC, threshold DESC LIMIT 1)""",
    pt="SELECT 'A' AS part, * FROM dh WHERE half = 'A' UNION ALL SELECT 'B', * FROM dh WHERE half = 'B' UNION ALL SELECT 'all', * FROM dh",
    c2="""SELECT rule, part, *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, tn / greatest(neg, 1) AS tnr FROM (
            SELECT rule, part, count(*) FILTER (conf >= t AND has_match AND correct) AS tp, count(*) FILTER (conf >= t AND NOT (has_match AND correct)) AS fp,
                   count(*) FILTER (conf < t AND has_match) AS fn, count(*) FILTER (conf < t AND NOT has_match) AS tn, count(*) FILTER (NOT has_match) AS neg
            FROM pt JOIN rl ON true GROUP BY ALL)""",
    au=SCORED.format("c2")))
def a26(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    d = durable(splits.halves(search.decisions(q, g), 0), "audit")
    a = d.filter("half = 'A'")
    swept = refusal.sweep_all_values(a)
    none = refusal.confusion(a, F.lit(False)).withColumn("threshold", a.agg((F.max("conf") + 1e-9).alias("t")).scalar())
    grid = swept.unionByName(none)
    chosen = grid.agg(F.max_by("threshold", F.struct("score", "tnr", "threshold")).alias("t")).first()["t"]
    parts = F.array(F.col("half"), F.lit("all"))
    rows = d.withColumn("part", F.explode(parts)).withColumn("_r", F.explode(F.array(
        F.struct(F.lit("frozen").alias("rule"), F.lit(THRESHOLD).alias("t")), F.struct(F.lit("chosen").alias("rule"), F.lit(float(chosen)).alias("t")))))
    rows = rows.withColumn("rule", F.col("_r.rule"))
    return refusal.confusion(rows, refusal.accepts(F.col("conf"), F.col("_r.t")), ["rule", "part"]).select(
        "rule", "part", "tp", "fp", "fn", "tn", r6("score"))


# ---- gallery size ----------------------------------------------------------------------------

def size_ctes():
    c = dict(co=COHORT, g0=growth_sql(0), g1=growth_sql(1))
    c["gs"] = "SELECT 0 AS seed, size, g0.* FROM g0 JOIN (SELECT unnest([40, 80]) AS size) ON rank <= size UNION ALL SELECT 1, size, g1.* FROM g1 JOIN (SELECT unnest([40, 80]) AS size) ON rank <= size"
    c["ps"] = """SELECT seed, size, co.ord AS q_ord, gs.ord AS g_ord, co.vehicle_id AS q_vehicle_id, gs.vehicle_id AS g_vehicle_id, co.camera_id AS q_camera_id,
                 gs.camera_id AS g_camera_id, list_inner_product(co.emb, gs.emb) AS sim FROM co JOIN gs ON co.frame <> gs.frame"""
    c["rs"] = "SELECT *, row_number() OVER (PARTITION BY seed, size, q_ord ORDER BY sim DESC, g_ord) AS pos FROM ps"
    c["cl"] = "SELECT seed, size, q_ord, (g_vehicle_id = q_vehicle_id)::INT AS rel, row_number() OVER (PARTITION BY seed, size, q_ord ORDER BY pos) AS rk FROM rs WHERE pos <= 10 AND NOT (g_vehicle_id = q_vehicle_id AND g_camera_id = q_camera_id)"
    c["hs"] = "SELECT *, sum(rel) OVER (PARTITION BY seed, size, q_ord ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hits FROM cl"
    c["sm"] = """SELECT seed, size, avg(ap) AS map FROM (SELECT s.seed, s.size, nv.q_ord, coalesce(sum(CASE WHEN rel = 1 THEN hits / rk END), 0) / least(max(n_valid), 10) AS ap
                 FROM nv JOIN co ON co.ord = nv.q_ord JOIN (SELECT DISTINCT seed, size FROM gs) s ON true
                 LEFT JOIN hs ON hs.q_ord = nv.q_ord AND hs.seed = s.seed AND hs.size = s.size WHERE n_valid > 0 GROUP BY ALL) GROUP BY ALL"""
    c["sr"] = f"""SELECT seed, size, count(*) FILTER (sim >= {THRESHOLD} AND g_vehicle_id = q_vehicle_id) AS tp, count(*) FILTER (sim >= {THRESHOLD} AND g_vehicle_id <> q_vehicle_id) AS fp,
                  count(*) AS n_query FROM rs WHERE pos = 1 GROUP BY ALL"""
    return c


def size_effect(spark, sf_dir) -> DataFrame:
    """mAP@10 and accept counts of a fixed cohort while distractors are added."""
    q, g = sides(spark, sf_dir)
    cohort = q.filter("ord % 3 = 0 and vehicle_id < 5")
    out = []
    for seed in (0, 1):
        grown = durable(growth(cohort, g, seed), "growth")
        for size in (40, 80):
            part = grown.filter(F.col("rank") <= size)
            top = durable(emitted_top(cohort, part), "sized-top")
            ap = metrics.average_precision_at_k(top, cohort, part, 10).agg(F.avg("ap").alias("map"))
            ok = F.col("g_vehicle_id") == F.col("q_vehicle_id")
            acc = refusal.accepts(F.col("sim"), THRESHOLD)
            counts = top.filter("pos = 1").agg(
                F.sum((acc & ok).cast("long")).alias("tp"), F.sum((acc & ~ok).cast("long")).alias("fp"), F.count(F.lit(1)).alias("n_query"))
            out.append(counts.select(F.lit(seed).alias("seed"), F.lit(size).alias("size"), ap.scalar().alias("map"), "tp", "fp", "n_query"))
    return reduce(DataFrame.unionByName, out)


@query("a27_gallery_size_effect", with_ctes("o q g nv", """
SELECT sm.seed, sm.size, round(map, 6) AS map, tp, fp, n_query FROM sm JOIN sr ON sm.seed = sr.seed AND sm.size = sr.size""", **size_ctes()))
def a27(spark, sf_dir):
    return rounded(size_effect(spark, sf_dir), "map")


# ---- paired comparison -----------------------------------------------------------------------

BOOT = {
    "i{n}": "SELECT vehicle_id, row_number() OVER (ORDER BY vehicle_id) - 1 AS slot, count(*) OVER () AS total, s, c FROM (SELECT vehicle_id, sum(delta) AS s, count(*) AS c FROM {src} GROUP BY vehicle_id)",
    "w{n}": "SELECT b, " + H.format("'0:' || b || ':' || slot") + " % total AS slot FROM i{n} JOIN (SELECT unnest(range(0, 2000)) AS b) ON true",
    "v{n}": "SELECT w{n}.b, sum(s) / sum(c) AS v FROM w{n} JOIN i{n} ON i{n}.slot = w{n}.slot GROUP BY w{n}.b",
    "z{n}": """SELECT (SELECT avg(delta) FROM {src}) AS mean_drop, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high,
               (SELECT count(*) FROM {src}) AS n_queries, (SELECT count(DISTINCT vehicle_id) FROM {src}) AS n_identities FROM v{n}""",
}


def boot_ctes(n, src):
    return {k.replace("{n}", n): v.replace("{n}", n).replace("{src}", src) for k, v in BOOT.items()}


RANK2 = {"r2": "SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim2 DESC, g_ord) AS pos FROM p",
         "r3": """SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY s3 DESC, g_ord) AS pos FROM (
                    SELECT p.*, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS s3 FROM p
                    JOIN (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v FROM embeddings) a ON a.vec_id = q_ord
                    JOIN (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v FROM embeddings) b ON b.vec_id = g_ord)"""}
DROPS = {**ap10_ctes(), **RANK2, **ap10_ctes("r2", "m"), **ap10_ctes("r3", "c"),
         "dm": "SELECT q.vehicle_id, ap.ap - map.ap AS delta FROM ap JOIN map ON map.q_ord = ap.q_ord JOIN q ON q.ord = ap.q_ord",
         "dc": "SELECT q.vehicle_id, ap.ap - cap.ap AS delta FROM ap JOIN cap ON cap.q_ord = ap.q_ord JOIN q ON q.ord = ap.q_ord",
         "de": "SELECT q.vehicle_id, cap.ap - map.ap AS delta FROM map JOIN cap ON cap.q_ord = map.q_ord JOIN q ON q.ord = map.q_ord"}
BOOT_OUT = "round(mean_drop, 6) AS mean_drop, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n_queries, n_identities"


def ap_variants(spark, sf_dir) -> DataFrame:
    """AP@10 per query with all dimensions, with half of them masked, and with the other half masked."""
    q, g = sides(spark, sf_dir)
    front = lambda df: df.withColumn("emb", F.slice("emb", 1, 32))
    ap = lambda a, b, name: metrics.average_precision_at_k(emitted_top(a, b), q, g, 10).select("q_ord", F.col("ap").alias(name))
    truth = q.select(F.col("ord").alias("q_ord"), "vehicle_id")
    return durable(
        ap(q, g, "base").join(ap(second_space(q), second_space(g), "masked"), "q_ord").join(ap(front(q), front(g), "control"), "q_ord").join(truth, "q_ord"),
        "ap-variants")


def drop_row(v: DataFrame, a: str, b: str, name: str) -> DataFrame:
    out = bootstrap.paired_drop(v.select("vehicle_id", (F.col(a) - F.col(b)).alias("delta")), 2000)
    return out.select(F.lit(name).alias("effect"), r6("mean_drop"), r6("ci_low"), r6("ci_high"), "n_queries", "n_identities")


@query("a28_paired_identity_bootstrap", with_ctes("o q g p r nv", f"SELECT 'mask' AS effect, {BOOT_OUT} FROM zm", **DROPS, **boot_ctes("m", "dm")))
def a28(spark, sf_dir):
    return drop_row(ap_variants(spark, sf_dir), "base", "masked", "mask")


@query("a29_ablation_with_controls", with_ctes("o q g p r nv", f"""
SELECT 'mask' AS effect, {BOOT_OUT} FROM zm UNION ALL SELECT 'control', {BOOT_OUT} FROM zc UNION ALL SELECT 'mask_minus_control', {BOOT_OUT} FROM ze""",
    **DROPS, **boot_ctes("m", "dm"), **boot_ctes("c", "dc"), **boot_ctes("e", "de")))
def a29(spark, sf_dir):
    v = ap_variants(spark, sf_dir)
    return drop_row(v, "base", "masked", "mask").unionByName(drop_row(v, "base", "control", "control")).unionByName(
        drop_row(v, "control", "masked", "mask_minus_control"))


@query("a30_ann_quality", with_ctes("o q g p r", """
SELECT round(avg(len(list_intersect(a, b)) / 10), 6) AS agreement, round(avg((a[1] = b[1])::INT), 6) AS planted_at_1,
       round(avg(list_contains(b, a[1])::INT), 6) AS planted_at_10 FROM (
  SELECT q_ord, list(g_ord ORDER BY pos) FILTER (WHERE pos <= 10) AS a, list(g_ord ORDER BY pos2) FILTER (WHERE pos2 <= 10) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim2 DESC, g_ord) AS pos2 FROM r) GROUP BY q_ord)"""))
def a30(spark, sf_dir):
    from matchbook.operators.ann import agreement
    from matchbook.operators.fusion import ranked_list
    q, g = sides(spark, sf_dir)
    truth = ranked_list(nearest(q, g, 10), "truth")
    found = ranked_list(nearest(second_space(q), second_space(g), 10), "found")
    return rounded(agreement(truth.join(found, "q_ord"), 10), "agreement", "planted_at_1", "planted_at_10")


# ---- logs and reports ------------------------------------------------------------------------

RUN_LOG = """SELECT CASE WHEN user_id % 6 < 3 THEN 'baseline' ELSE 'candidate' END AS grp, user_id % 6 AS run, day(ts) // 8 AS epoch,
             round(avg(value), 3) AS score FROM events GROUP BY ALL"""


@query("a32_training_run_summary", f"""
WITH l AS ({RUN_LOG}), f AS (SELECT grp, run, arg_max(score, epoch) AS final, arg_min(score, epoch) AS zero FROM l GROUP BY ALL),
s AS (SELECT grp, count(*) AS n, round(avg(final), 3) AS mean, max(final) AS best, min(final) AS worst, round(max(final) - min(final), 3) AS spread FROM f GROUP BY grp)
SELECT s.*, (SELECT count(DISTINCT zero) <= 1 FROM f) AS same_split,
       (SELECT count(DISTINCT zero) <= 1 FROM f) AND (SELECT mean FROM s WHERE grp = 'candidate') - (SELECT mean FROM s WHERE grp = 'baseline') >= 1.5 AS upgrade FROM s""")
def a32(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    log = ev.groupBy(
        F.when(F.col("user_id") % 6 < 3, "baseline").otherwise("candidate").alias("grp"), (F.col("user_id") % 6).alias("run"),
        F.expr("day(ts) div 8").alias("epoch")).agg(F.round(F.avg("value"), 3).alias("score"))
    f = log.groupBy("grp", "run").agg(F.max_by("score", "epoch").alias("final"), F.min_by("score", "epoch").alias("zero"))
    s = f.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("final"), 3).alias("mean"), F.max("final").alias("best"), F.min("final").alias("worst"),
        F.round(F.max("final") - F.min("final"), 3).alias("spread"), F.collect_set("zero").alias("_z"))
    whole = Window.partitionBy(F.lit(0))
    zeros = F.size(F.array_distinct(F.flatten(F.collect_list("_z").over(whole)))) <= 1
    mean = lambda g: F.max(F.when(F.col("grp") == g, F.col("mean"))).over(whole)
    return s.withColumn("same_split", zeros).withColumn(
        "upgrade", F.col("same_split") & (mean("candidate") - mean("baseline") >= 1.5)).drop("_z")


@query("a33_latency_summary", """
WITH m AS (SELECT event_type, 1 + user_id % 4 AS batch, value FROM events WHERE value > 0),
f AS (SELECT event_type, batch, 1000 * count(*) / sum(value) AS fps FROM m GROUP BY ALL)
SELECT a.event_type, a.n, round(a.median, 6) AS median, round(a.mean, 6) AS mean, round(a.p90, 6) AS p90, round(a.p95, 6) AS p95,
       b.batch AS best_batch, round(b.fps, 6) AS best_fps FROM (
  SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS median, avg(value) AS mean, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95 FROM m GROUP BY 1) a
JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY fps DESC, batch) = 1) b ON a.event_type = b.event_type""")
def a33(spark, sf_dir):
    m = table(spark, sf_dir, "events").filter("value > 0").select("event_type", (1 + F.col("user_id") % 4).alias("batch"), "value")
    quant = ranks.quantiles(m, "value", {"median": 0.5, "p90": 0.9, "p95": 0.95}, ["event_type"])
    fps = m.groupBy("event_type", "batch").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c")).groupBy("event_type").agg(
        (F.sum("s") / F.sum("c")).alias("mean"), F.max_by("batch", F.struct(1000 * F.col("c") / F.col("s"), -F.col("batch"))).alias("best_batch"),
        F.max(1000 * F.col("c") / F.col("s")).alias("best_fps"))
    return rounded(quant.withColumn("n", F.col("n").cast("long")).join(fps, "event_type"), "median", "mean", "p90", "p95", "best_fps")


@query("p14_speed_scores", """
SELECT event_id, round(greatest(0, least(1, (80 - value) / 40)), 6) AS latency_score, round(greatest(0, least(1, (value - 50) / 50)), 6) AS throughput_score FROM events""")
def p14(spark, sf_dir):
    clip = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", clip((80.0 - v) / 40.0).alias("latency_score"), clip((v - 50.0) / 50.0).alias("throughput_score"))


@query("a35_metric_parity", with_ctes("o q g p r nv", """
SELECT metric, round(own, 6) AS own, round(own, 6) AS external, 0::DOUBLE AS abs_diff FROM (
  SELECT unnest(['mAP@10', 'Rank-1', 'Rank-5']) AS metric, unnest([avg(ap), avg(coalesce(first_hit <= 1, false)::INT), avg(coalesce(first_hit <= 5, false)::INT)]) AS own FROM ap)""", **ap10_ctes()))
def a35(spark, sf_dir):
    """Own metrics against an independently written scorer that works on the emitted lists."""
    q, g = sides(spark, sf_dir)
    top = durable(emitted_top(q, g), "emitted")
    own = metrics.summary(metrics.average_precision_at_k(top, q, g, 10), (1, 5)).select(
        F.col("map").alias("mAP@10"), F.col("rank1").alias("Rank-1"), F.col("rank5").alias("Rank-5")).unpivot([], ["mAP@10", "Rank-1", "Rank-5"], "metric", "own")
    same = F.col("g_vehicle_id") == F.col("q_vehicle_id")
    lists = top.groupBy("q_ord").agg(F.array_sort(F.collect_list(F.struct(
        "pos", same.alias("hit"), (same & (F.col("g_camera_id") == F.col("q_camera_id"))).alias("junk")))).alias("l"))
    hits = F.transform(F.filter("l", lambda x: ~x["junk"]), lambda x: x["hit"].cast("int"))
    scored = search.valid_positives(q, g).filter("n_valid > 0").join(lists, "q_ord").withColumn("h", hits)
    prec = F.transform("h", lambda x, i: x * F.aggregate(F.slice("h", F.lit(1), i + 1), F.lit(0), lambda a, b: a + b) / (i + 1))
    ap = F.aggregate(prec, F.lit(0.0), lambda a, b: a + b) / F.least(F.col("n_valid"), F.lit(10))
    within = lambda k: F.exists(F.slice("h", 1, k), lambda x: x == 1).cast("int").cast("double")
    ext = scored.agg(F.avg(ap).alias("mAP@10"), F.avg(within(1)).alias("Rank-1"), F.avg(within(5)).alias("Rank-5")).unpivot(
        [], ["mAP@10", "Rank-1", "Rank-5"], "metric", "external")
    return own.join(ext, "metric").select("metric", r6("own"), r6("external"), F.round(F.abs(F.col("own") - F.col("external")), 6).alias("abs_diff"))


@query("a36_quality_composite", with_ctes("o", f"""
SELECT split_part(episode, '-', 1) AS prefix, count(*) AS n, round(avg(0.45::DOUBLE * map + 0.1::DOUBLE * quality), 6) AS composite FROM (
  SELECT episode, avg(ok::INT) FILTER (has) AS map, 0.7::DOUBLE * (2 * count(*) FILTER (acc AND ok) / greatest(count(*) FILTER (acc) + count(*) FILTER (has), 1))
         + 0.3::DOUBLE * (count(*) FILTER (NOT acc AND NOT has) / greatest(count(*) FILTER (NOT has), 1)) AS quality FROM (
    SELECT *, sim >= 0.3 AS acc FROM (
      SELECT a.episode, a.vehicle_id = b.vehicle_id AS ok, list_inner_product(a.emb, b.emb) AS sim,
             a.vehicle_id IN (SELECT vehicle_id FROM ep c WHERE c.episode = a.episode AND c.role = 'gallery') AS has,
             row_number() OVER (PARTITION BY a.episode, a.ord ORDER BY list_inner_product(a.emb, b.emb) DESC, b.ord) AS z
      FROM ep a JOIN ep b ON a.episode = b.episode AND a.role = 'query' AND b.role = 'gallery' AND a.frame <> b.frame) WHERE z = 1) GROUP BY episode) GROUP BY prefix""", **EPISODES_SQL))
def a36(spark, sf_dir):
    """Weighted rank-1 and refusal quality of each episode, averaged by direction."""
    o = observations(spark, sf_dir)
    ep = durable(splits.episodes(o, "camera_id <= 2", KEEP).drop("vehicle_id").join(o, "ord"), "episodes")
    qs, gs = ep.filter("role = 'query'"), ep.filter("role = 'gallery'")
    # One row per (episode, observation): the ordinal is made unique by the episode's number.
    names = F.array(*[F.lit(x) for x in sorted(f"{d}-{k}" for d in ("day-night", "night-day") for k in KEEP)])
    number = lambda df: df.withColumn("ord", F.col("ord") * 8 + F.array_position(names, F.col("episode")))
    top = nearest(number(qs), number(gs), 1, Plan(exclude=(FRAME,), require=("episode",)), ["episode", "vehicle_id"], ["vehicle_id"])
    known = gs.select(F.col("episode").alias("q_episode"), F.col("vehicle_id").alias("q_vehicle_id")).distinct().withColumn("has_match", F.lit(True))
    d = top.join(known, ["q_episode", "q_vehicle_id"], "left").fillna(False, ["has_match"]).withColumn("correct", F.col("q_vehicle_id") == F.col("g_vehicle_id"))
    c = refusal.confusion(d, refusal.accepts(F.col("sim"), 0.3), ["q_episode"])
    hit = d.filter("has_match").groupBy("q_episode").agg(F.avg(F.col("correct").cast("int").cast("double")).alias("map"))
    f1 = 2.0 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))
    quality = 0.7 * f1 + 0.3 * F.col("tnr")
    return c.join(hit, "q_episode").groupBy(F.substring_index("q_episode", "-", 1).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(0.45 * F.col("map") + 0.1 * quality), 6).alias("composite"))


@query("a39_scorecard", with_ctes("o q g p r nv", """
SELECT 'ranking' AS block, 'map10' AS what, round(avg(ap), 6) AS value FROM aap
UNION ALL SELECT 'refusal', 'score_at_threshold', round((SELECT score_a FROM st WHERE abs(threshold - 0.35) < 1e-6), 6)
UNION ALL SELECT 'gallery_size', 'size_' || size, round(avg(map), 6) FROM sm GROUP BY size
UNION ALL SELECT 'speed', 'latency_median', round(quantile_cont(value, 0.5), 6) FROM events WHERE event_type = 'view'""",
    **SCENARIOS, **{k: v for k, v in size_ctes().items() if k != "sr"}, **{k: v.replace("FROM cl", "FROM acl").replace("JOIN hs ON hs.", "JOIN ahs hs ON hs.") for k, v in ap10_ctes("r", "a").items()}))
def a39(spark, sf_dir):
    """Report rows gathered from several result tables, keeping only those of the released recipe.

    Every report carries the fingerprints of the model and recipe it was measured with;
    reports of another recipe are left out, the threshold row must lie within 1e-6, and
    repeated measurements of a gallery size are averaged.
    """
    q, g = sides(spark, sf_dir)
    released = F.sha2(F.lit("recipe:0.35"), 256)
    top = emitted_top(q, g)
    rank = metrics.average_precision_at_k(top, q, g, 10).agg(F.avg("ap").alias("value")).select(
        F.lit("ranking").alias("block"), F.lit("map10").alias("what"), "value", F.sha2(F.lit("recipe:0.35"), 256).alias("recipe"))
    st = stress_rows(q, g)
    at = st.agg(F.min_by(F.struct("threshold", "score_a"), F.abs(F.col("threshold") - 0.35)).alias("_r")).filter(
        F.abs(F.col("_r.threshold") - 0.35) < 1e-6)
    ref = at.select(F.lit("refusal").alias("block"), F.lit("score_at_threshold").alias("what"), F.col("_r.score_a").alias("value"),
                    F.sha2(F.lit("recipe:0.35"), 256).alias("recipe"))
    size = size_effect(spark, sf_dir).groupBy("size").agg(F.avg("map").alias("value")).select(
        F.lit("gallery_size").alias("block"), F.concat(F.lit("size_"), F.col("size").cast("string")).alias("what"), "value",
        F.sha2(F.lit("recipe:0.35"), 256).alias("recipe"))
    speed = ranks.quantiles(table(spark, sf_dir, "events"), "value", {"value": 0.5}, ["event_type"]).filter(F.col("event_type").isin("view", "click")).select(
        F.lit("speed").alias("block"), F.lit("latency_median").alias("what"), "value",
        F.sha2(F.when(F.col("event_type") == "view", F.lit("recipe:0.35")).otherwise(F.lit("recipe:old")), 256).alias("recipe"))
    rows = rank.unionByName(ref).unionByName(size).unionByName(speed)
    return rows.filter(F.col("recipe") == released).select("block", "what", r6("value"))
