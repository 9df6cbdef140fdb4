"""Metric, calibration and error-analysis queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchbook.model import gallery_side
from matchbook.operators import metrics, ranks, refusal, search
from matchbook.operators.similarity import CAMERA, FRAME, JUNK, Plan, counts_ahead, nearest
from matchbook.plans.registry import query, with_ctes
from matchbook.plans.searching import THRESHOLD, r6, sides
from matchbook.session import durable

TRUTH = ["vehicle_id", "camera_id"]


def rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def emitted_top(q, g, k=10, plan=Plan()):
    return nearest(q, g, k, plan, q_carry=TRUTH, g_carry=TRUTH)


# ---- ranking metrics -------------------------------------------------------------------------

FULL = """
  SELECT q.ord AS q_ord, g.vehicle_id = q.vehicle_id AS pos,
         row_number() OVER w AS rk, sum((g.vehicle_id = q.vehicle_id)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits
  FROM q JOIN g ON NOT ({junk})
  WINDOW w AS (PARTITION BY q.ord ORDER BY list_inner_product(q.emb, g.emb) DESC, g.ord)"""
JUNK_SQL = "q.vehicle_id = g.vehicle_id AND q.camera_id = g.camera_id"
FULL_AP = "SELECT q_ord, avg(hits / rk) AS ap, min(rk) AS first_hit, max(rk) AS last_hit, count(*) AS n_pos FROM f WHERE pos GROUP BY q_ord"
FULL_SUM = """
SELECT round(avg(ap), 6) AS map, round(avg((first_hit <= 1)::INT), 6) AS rank1, round(avg((first_hit <= 5)::INT), 6) AS rank5,
       round(avg((first_hit <= 10)::INT), 6) AS rank10, count(*) AS n_query_valid FROM a"""


@query("a1_map_cmc_full", with_ctes("o q g", FULL_SUM, f=FULL.format(junk=JUNK_SQL), a=FULL_AP))
def a1(spark, sf_dir):
    out = metrics.require_valid(metrics.summary(metrics.full_average_precision(*sides(spark, sf_dir))))
    return rounded(out, "map", "rank1", "rank5", "rank10")


@query("a1_average_precision_per_query", with_ctes("o q g", """
SELECT q_ord, round(ap, 6) AS ap, first_hit, last_hit, n_pos FROM a""", f=FULL.format(junk=JUNK_SQL), a=FULL_AP))
def a1_rows(spark, sf_dir):
    return rounded(metrics.full_average_precision(*sides(spark, sf_dir)), "ap")


@query("a3_map_strict_cross_camera", with_ctes("o q g", FULL_SUM, f=FULL.format(junk="q.camera_id = g.camera_id"), a=FULL_AP))
def a3(spark, sf_dir):
    out = metrics.summary(metrics.full_average_precision(*sides(spark, sf_dir), exclude=CAMERA))
    return rounded(out, "map", "rank1", "rank5", "rank10")


@query("a4_minp", with_ctes("o q g", "SELECT round(avg(n_pos / last_hit), 6) AS minp, count(*) AS n_query FROM a",
                            f=FULL.format(junk=JUNK_SQL), a=FULL_AP))
def a4(spark, sf_dir):
    return rounded(metrics.mean_inverse_negative_penalty(metrics.full_average_precision(*sides(spark, sf_dir))), "minp")


def ap10_ctes(ranking: str = "r", prefix: str = "") -> dict[str, str]:
    """SQL of AP@10 over a ranked pair table with columns of ``r``."""
    return {
        prefix + "cl": f"""SELECT q_ord, (g_vehicle_id = q_vehicle_id)::INT AS rel, row_number() OVER (PARTITION BY q_ord ORDER BY pos) AS rk
                  FROM {ranking} WHERE pos <= 10 AND NOT (g_vehicle_id = q_vehicle_id AND g_camera_id = q_camera_id)""",
        prefix + "hs": f"SELECT *, sum(rel) OVER (PARTITION BY q_ord ORDER BY rk ROWS UNBOUNDED PRECEDING) AS hits FROM {prefix}cl",
        prefix + "ap": f"""SELECT nv.q_ord, coalesce(sum(CASE WHEN rel = 1 THEN hits / rk END), 0) / least(max(n_valid), 10) AS ap,
                  min(CASE WHEN rel = 1 THEN rk END) AS first_hit
           FROM nv LEFT JOIN {prefix}hs ON {prefix}hs.q_ord = nv.q_ord WHERE n_valid > 0 GROUP BY nv.q_ord""",
    }


AP_SUM = """
SELECT round(avg(ap), 6) AS map, round(avg(coalesce(first_hit <= 1, false)::INT), 6) AS rank1,
       round(avg(coalesce(first_hit <= 5, false)::INT), 6) AS rank5,
       round(avg(coalesce(first_hit <= 10, false)::INT), 6) AS rank10, count(*) AS n_query_valid FROM {0}"""


@query("a2_map_at_10", with_ctes("o q g p r nv", AP_SUM.format("ap"), **ap10_ctes()))
def a2(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return rounded(metrics.summary(metrics.average_precision_at_k(emitted_top(q, g), q, g, 10)), "map", "rank1", "rank5", "rank10")


# ---- refusal ---------------------------------------------------------------------------------

CURVE = """
  SELECT t AS threshold, tp, fp, fn, tn, accept_rate, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall,
         CASE WHEN neg > 0 THEN tn / neg END AS tnr
  FROM (SELECT t, count(*) FILTER (conf >= t AND has_match AND correct) AS tp,
               count(*) FILTER (conf >= t AND NOT (has_match AND correct)) AS fp,
               count(*) FILTER (conf < t AND has_match) AS fn, count(*) FILTER (conf < t AND NOT has_match) AS tn,
               count(*) FILTER (NOT has_match) AS neg, avg((conf >= t)::INT) AS accept_rate
        FROM {conf} JOIN {ths} ON true GROUP BY t)"""
SCORED = """
  SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1,
         100 * (0.7::DOUBLE * (2 * precision * recall / greatest(precision + recall, 1e-12)) + 0.3::DOUBLE * coalesce(tnr, 0)) AS score FROM {0}"""
Q200 = "SELECT DISTINCT unnest(quantile_cont(conf, list_transform(range(0, 200), lambda i: i / 199.0))) AS t FROM {0}"
CURVE_OUT = "round(threshold, 6) AS threshold, tp, fp, fn, tn, round(accept_rate, 6) AS accept_rate, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(tnr, 6) AS tnr, round(score, 6) AS score"
RATES = ("threshold", "accept_rate", "precision", "recall", "f1", "tnr", "score")


def curve_ctes(conf="d", ths="th"):
    return dict(cv=CURVE.format(conf=conf, ths=ths), sc=SCORED.format("cv"))


@query("a5_pr_auc", with_ctes("o q g p r d", """
SELECT round(sum(CASE WHEN pos = 1 THEN (tp / n) / total END), 6) AS pr_auc FROM (
  SELECT pos, sum(pos) OVER (ORDER BY conf DESC, q_ord ROWS UNBOUNDED PRECEDING) AS tp,
         row_number() OVER (ORDER BY conf DESC, q_ord) AS n, sum(pos) OVER () AS total
  FROM (SELECT conf, q_ord, (has_match AND correct)::INT AS pos FROM d))"""))
def a5(spark, sf_dir):
    return rounded(refusal.pr_auc(search.decisions(*sides(spark, sf_dir))), "pr_auc")


def curve(spark, sf_dir):
    d = durable(search.decisions(*sides(spark, sf_dir)), "decisions")
    return d, refusal.sweep(d, refusal.quantile_grid(d, 200))


@query("a6_refusal_curve", with_ctes("o q g p r d", f"SELECT {CURVE_OUT} FROM sc", th=Q200.format("d"), **curve_ctes()))
def a6(spark, sf_dir):
    return rounded(curve(spark, sf_dir)[1], *RATES)


@query("a7_choose_threshold", with_ctes("o q g p r d", f"""
SELECT {CURVE_OUT}, 'free' AS rule FROM (SELECT * FROM sc ORDER BY sc.score DESC, sc.threshold LIMIT 1)
UNION ALL SELECT {CURVE_OUT}, 'tnr_floor' AS rule FROM (SELECT * FROM sc WHERE tnr >= 0.9 ORDER BY sc.score DESC, sc.threshold LIMIT 1)""",
    th=Q200.format("d"), **curve_ctes()))
def a7(spark, sf_dir):
    c = durable(curve(spark, sf_dir)[1], "curve")
    free = refusal.best(c).withColumn("rule", F.lit("free"))
    return rounded(free.unionByName(refusal.best(c, min_tnr=0.9).withColumn("rule", F.lit("tnr_floor"))), *RATES)


@query("a8_confusion", with_ctes("o q g p r d", f"SELECT tp, fp, fn, tn, {CURVE_OUT.split('fn, tn, ')[1]} FROM sc",
                                 th=f"SELECT {THRESHOLD}::DOUBLE AS t", **curve_ctes()))
def a8(spark, sf_dir):
    d = search.decisions(*sides(spark, sf_dir))
    return rounded(refusal.confusion(d, refusal.accepts(F.col("conf"), THRESHOLD)), *RATES)


@query("a8_label_confusion", """
SELECT tp, fp, fn, tn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall FROM (
  SELECT count(*) FILTER (a AND quality = 1) AS tp, count(*) FILTER (a AND quality = 0) AS fp,
         count(*) FILTER (NOT a AND quality = 1) AS fn, count(*) FILTER (NOT a AND quality = 0) AS tn
  FROM (SELECT l.quality, d.n_chars >= 1000 AS a FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL))""")
def a8_labels(spark, sf_dir):
    from matchbook.model import table
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = rows.filter(F.col("quality").isNotNull()).select(
        (F.col("quality") == 1).alias("has_match"), F.lit(True).alias("correct"), "n_chars")
    out = refusal.confusion(rows, F.col("n_chars") >= 1000)
    return rounded(out.select("tp", "fp", "fn", "tn", "precision", "recall"), "precision", "recall")


def calibration(q, g):
    """Best cross-camera similarity of each query to its own identity."""
    return nearest(q, g, 1, Plan(exclude=(CAMERA,), require=("vehicle_id",)))


BEST = """SELECT q.ord AS q_ord, max(list_inner_product(q.emb, g.emb)) AS best FROM q JOIN g
          ON g.vehicle_id = q.vehicle_id AND g.camera_id <> q.camera_id GROUP BY q.ord"""
TAU_SQL = "SELECT quantile_cont(best, 0.05) AS tau, quantile_cont(best, 0.5) AS median, count(*) AS n_pairs FROM b"


@query("a10_radius_calibration", with_ctes("o q g", "SELECT round(tau, 6) AS tau, round(median, 6) AS median, n_pairs FROM tau", b=BEST, tau=TAU_SQL))
def a10(spark, sf_dir):
    out = ranks.quantiles(calibration(*sides(spark, sf_dir)), "sim", {"tau": 1 - 0.95, "median": 0.5})
    return out.select(r6("tau"), r6("median"), F.col("n").cast("long").alias("n_pairs"))


def radius(q, g):
    return ranks.quantiles(calibration(q, g), "sim", {"tau": 1 - 0.95}).first()["tau"]


def bits_per_query(q, g, tau: float, plan=Plan()):
    """``q_ord, n_cand, n_elig, bits`` at radius tau, in one pass over the gallery."""
    marked = q.withColumn("marks", F.array(F.lit(float(tau)), F.lit(-9.0))).withColumn(
        "mark_ords", F.array(F.lit(search.FAR_ORD), F.lit(search.FAR_ORD)))
    at = lambda i: F.coalesce(F.max(F.when(F.col("mark") == i, F.col("n"))), F.lit(0))
    c = counts_ahead(marked, g, plan).groupBy("q_ord").agg(at(0).alias("n_cand"), at(1).alias("n_elig"))
    return c.withColumn("bits", refusal.bits(F.col("n_cand"), F.greatest("n_elig", F.lit(1))))


@query("a11_bits_single", with_ctes("o q g", """
SELECT q.ord AS q_ord, count(*) FILTER (list_inner_product(q.emb, g.emb) >= 0.25) AS n_cand,
       round(-log2(greatest(count(*) FILTER (list_inner_product(q.emb, g.emb) >= 0.25), 1) / count(*)), 6) AS bits
FROM q JOIN g ON true GROUP BY q.ord"""))
def a11(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return bits_per_query(q, g, 0.25, Plan(exclude=())).select("q_ord", "n_cand", r6("bits"))


from matchbook.plans.searching import JOINT_SQL, joint_candidates  # noqa: E402


@query("a11_bits_joint", with_ctes("o q g p", """
SELECT track, n_cand, round(-log2(greatest(n_cand, 1) / (SELECT count(*) FROM g)), 6) AS bits FROM c""", **JOINT_SQL))
def a11_joint(spark, sf_dir):
    n = gallery_side(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).scalar()
    return joint_candidates(spark, sf_dir).select(
        "track", "n_cand", F.round(refusal.bits(F.col("n_cand"), n), 6).alias("bits"))


BITS_CTES = dict(
    b=BEST, tau=TAU_SQL,
    k="""SELECT q.ord AS q_ord, q.vehicle_id AS qv, g.vehicle_id AS gv, list_inner_product(q.emb, g.emb) AS sim, g.ord AS g_ord
         FROM q JOIN g ON q.camera_id <> g.camera_id""",
    bq="""SELECT q_ord, -log2(greatest(count(*) FILTER (sim >= (SELECT tau FROM tau)), 1) / (SELECT count(*) FROM g)) AS bits,
                 arg_max(gv, {s: sim, o: -g_ord}) = any_value(qv) AS ok
          FROM k GROUP BY q_ord HAVING bool_or(gv = qv)""",
    e="SELECT quantile_cont(bits, list_transform(range(0, 7), lambda i: i / 6.0)) AS e FROM bq",
)


@query("a12_bits_calibration_table", with_ctes("o q g", """
SELECT i::INTEGER AS bin, round(e[i], 6) AS bits_lo, round(e[i+1], 6) AS bits_hi, count(*) AS n, round(avg(ok::INT), 6) AS rank1_acc
FROM e JOIN (SELECT unnest(range(1, 7)) AS i) ON true JOIN bq ON bits >= e[i] AND bits <= e[i+1] GROUP BY ALL""", **BITS_CTES))
def a12(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    plan = Plan(exclude=(CAMERA,))
    tau, n = radius(q, g), gallery_side(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = bits_per_query(q, g, tau, plan).select("q_ord", refusal.bits(F.col("n_cand"), n).alias("bits"))
    top = nearest(q, g, 1, plan, TRUTH, TRUTH).select("q_ord", (F.col("g_vehicle_id") == F.col("q_vehicle_id")).alias("ok"))
    valid = search.valid_positives(q, g).filter("n_valid > 0").select("q_ord")
    b = durable(counted.join(top, "q_ord").join(valid, "q_ord"), "bits")
    return quantile_bins(b, "bits", 6).groupBy("bin").agg(
        F.round(F.first("lo"), 6).alias("bits_lo"), F.round(F.first("hi"), 6).alias("bits_hi"),
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int").cast("double")), 6).alias("rank1_acc"))


def quantile_bins(df, value: str, bins: int):
    """Rows with the closed quantile bins they fall into; a row on an inner edge is in both."""
    edges = ranks.quantile_rows(df, value, [i / bins for i in range(bins + 1)])
    edges = edges.agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("e")).select(F.col("e.x").alias("e"))
    marked = df.withColumn("_e", edges.scalar())
    cells = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.struct(
        i.alias("bin"), F.element_at("_e", i).alias("lo"), F.element_at("_e", i + 1).alias("hi")))
    hit = F.filter(cells, lambda c: (F.col(value) >= c["lo"]) & (F.col(value) <= c["hi"]))
    return marked.select(*df.columns, F.explode(hit).alias("_c")).select(*df.columns, "_c.bin", "_c.lo", "_c.hi")


MEASURES = """
  SELECT q_ord, max(CASE WHEN pos=1 THEN sim END) AS top1, max(CASE WHEN pos=1 THEN sim END) - max(CASE WHEN pos=2 THEN sim END) AS margin,
         max(CASE WHEN pos=1 THEN sim END) - avg(CASE WHEN pos>1 THEN sim END) AS gap_to_rest,
         max(CASE WHEN pos=1 THEN sim END) / CASE WHEN abs(max(CASE WHEN pos=2 THEN sim END)) < 1e-6 THEN 1e-6 ELSE max(CASE WHEN pos=2 THEN sim END) END AS ratio
  FROM {0} WHERE pos <= 10 GROUP BY q_ord"""


@query("a13_confidence_measures", with_ctes("o q g p r", """
SELECT q_ord, round(top1, 6) AS top1, round(margin, 6) AS margin, round(gap_to_rest, 6) AS gap_to_rest, round(ratio, 6) AS ratio FROM m""",
    m=MEASURES.format("r")))
def a13(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return rounded(refusal.measures(nearest(q, g, 10)), "top1", "margin", "gap_to_rest", "ratio")


CONF_LONG = """
  SELECT d.q_ord, d.has_match, d.correct, x.measure, x.conf FROM d JOIN (
    SELECT m.q_ord, unnest(['top1', 'margin', 'bits', 'top1+bits']) AS measure,
           unnest([top1, margin, bits, top1 + 0.02::DOUBLE * bits]) AS conf FROM m
    JOIN (SELECT q_ord, -log2(greatest(count(*) FILTER (sim >= (SELECT tau FROM tau)), 1) / count(*)) AS bits FROM p GROUP BY q_ord) b2
    ON b2.q_ord = m.q_ord) x ON x.q_ord = d.q_ord"""


def registry_of_measures(q, g):
    """Named confidence expressions over one query's scores, unpivoted to ``measure, conf``."""
    m = refusal.measures(nearest(q, g, 10)).join(bits_per_query(q, g, radius(q, g)).select("q_ord", "bits"), "q_ord")
    exprs = {"top1": F.col("top1"), "margin": F.col("margin"), "bits": F.col("bits"),
             "top1+bits": F.col("top1") + 0.02 * F.col("bits")}
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("conf")) for k, v in exprs.items()])
    return m.select("q_ord", F.explode(pairs).alias("_m")).select("q_ord", "_m.measure", "_m.conf")


@query("a9_compare_confidence_measures", with_ctes("o q g p r d", """
SELECT c.measure, round(c.threshold, 6) AS threshold, round(c.f1, 6) AS f1, round(c.tnr, 6) AS tnr, round(c.score, 6) AS score,
       round(a.pr_auc, 6) AS pr_auc, c.measure = (SELECT measure FROM pk ORDER BY pk.score DESC, o LIMIT 1) AS is_best
FROM pk c JOIN auc a ON a.measure = c.measure""", b=BEST, tau=TAU_SQL, m=MEASURES.format("r"), cl=CONF_LONG,
    th="SELECT DISTINCT measure, unnest(quantile_cont(conf, list_transform(range(0, 200), lambda i: i / 199.0))) AS t FROM cl GROUP BY measure",
    ct="""SELECT th.measure, t AS threshold, count(*) FILTER (conf >= t AND has_match AND correct) AS tp,
               count(*) FILTER (conf >= t AND NOT (has_match AND correct)) AS fp,
               count(*) FILTER (conf < t AND has_match) AS fn, count(*) FILTER (conf < t AND NOT has_match) AS tn,
               count(*) FILTER (NOT has_match) AS neg FROM cl JOIN th ON th.measure = cl.measure GROUP BY ALL""",
    cv="SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, tn / greatest(neg, 1) AS tnr FROM ct",
    sc=SCORED.format("cv"),
    pk="""SELECT *, list_position(['top1', 'margin', 'bits', 'top1+bits'], measure) AS o FROM sc
          QUALIFY row_number() OVER (PARTITION BY measure ORDER BY sc.score DESC, sc.threshold) = 1""",
    auc="""SELECT measure, sum(CASE WHEN pos = 1 THEN (tp / n) / total END) AS pr_auc FROM (
             SELECT measure, pos, sum(pos) OVER (PARTITION BY measure ORDER BY conf DESC, q_ord ROWS UNBOUNDED PRECEDING) AS tp,
                    row_number() OVER (PARTITION BY measure ORDER BY conf DESC, q_ord) AS n, sum(pos) OVER (PARTITION BY measure) AS total
             FROM (SELECT *, (has_match AND correct)::INT AS pos FROM cl)) GROUP BY measure"""))
def a9(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    truth = search.decisions(q, g).select("q_ord", "has_match", "correct")
    rows = durable(registry_of_measures(q, g).join(truth, "q_ord"), "measures")
    pick = refusal.best(refusal.sweep(rows, refusal.quantile_grid(rows, 200, ["measure"]), ["measure"]), ["measure"])
    auc = refusal.pr_auc(rows, keys=["measure"])
    order = F.array_position(F.array(*[F.lit(x) for x in ("top1", "margin", "bits", "top1+bits")]), F.col("measure"))
    top = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "_o")
    out = pick.join(auc, "measure").withColumn("_o", order).withColumn("is_best", F.row_number().over(top) == 1)
    return out.select("measure", r6("threshold"), r6("f1"), r6("tnr"), r6("score"), r6("pr_auc"), "is_best")


@query("u3_measure_registry", with_ctes("o q g p r d", "SELECT q_ord, measure, round(conf, 6) AS conf FROM cl",
                                        b=BEST, tau=TAU_SQL, m=MEASURES.format("r"), cl=CONF_LONG))
def u3(spark, sf_dir):
    return rounded(registry_of_measures(*sides(spark, sf_dir)), "conf")


# ---- error analysis --------------------------------------------------------------------------

ERR = """
  SELECT q.ord AS q_ord, q.w * q.h AS area, q.w / greatest(q.h, 1e-6) AS aspect, nv.n_valid, d.conf, d.has_match, d.correct,
         EXISTS (SELECT 1 FROM g WHERE g.vehicle_id = q.vehicle_id AND g.camera_id = q.camera_id) AS dup,
         coalesce(k.top_ok, false) AS top_ok, coalesce(k.in10, false) AS in10,
         CASE WHEN n_valid = 0 THEN 'no_valid_positive' WHEN coalesce(k.top_ok, false) THEN 'rank1_ok'
              WHEN coalesce(k.in10, false) THEN 'rank1_wrong_but_in_top10' ELSE 'miss_top10' END AS outcome
  FROM q JOIN nv ON nv.q_ord = q.ord JOIN d ON d.q_ord = q.ord
  LEFT JOIN (SELECT q_ord, bool_or(rk = 1 AND rel) AS top_ok, bool_or(rel) AS in10 FROM (
               SELECT q_ord, g_vehicle_id = q_vehicle_id AS rel, row_number() OVER (PARTITION BY q_ord ORDER BY pos) AS rk FROM r
               WHERE NOT (g_vehicle_id = q_vehicle_id AND g_camera_id = q_camera_id)) WHERE rk <= 10 GROUP BY q_ord) k ON k.q_ord = q.ord"""


def error_table(spark, sf_dir):
    """One row per query: outcome class, box descriptors, positives, duplicate flag, decision."""
    q, g = sides(spark, sf_dir)
    kept = nearest(q, g, 10, Plan(exclude=(FRAME, JUNK)), TRUTH, TRUTH)
    rel = F.col("g_vehicle_id") == F.col("q_vehicle_id")
    hits = kept.groupBy("q_ord").agg(F.max((F.col("pos") == 1) & rel).alias("top_ok"), F.max(rel).alias("in10"))
    box = q.select(F.col("ord").alias("q_ord"), (F.col("w") * F.col("h")).alias("area"),
                   (F.col("w") / F.greatest("h", F.lit(1e-6))).alias("aspect"))
    d = search.decisions(q, g).select("q_ord", "q_key", "conf", "has_match", "correct", "g_ord")
    outcome = (
        F.when(F.col("n_valid") == 0, "no_valid_positive").when(F.col("top_ok"), "rank1_ok")
        .when(F.col("in10"), "rank1_wrong_but_in_top10").otherwise("miss_top10"))
    return (
        box.join(search.valid_positives(q, g), "q_ord").join(d, "q_ord").join(hits, "q_ord", "left")
        .fillna(False, ["top_ok", "in10"]).withColumnRenamed("same_camera_duplicate", "dup").withColumn("outcome", outcome))


@query("a22_outcome_taxonomy", with_ctes("o q g p r d nv", "SELECT q_ord, outcome, n_valid FROM er", er=ERR))
def a22(spark, sf_dir):
    return error_table(spark, sf_dir).select("q_ord", "outcome", "n_valid")


@query("a23_group_description", with_ctes("o q g p r d nv", """
SELECT outcome, count(*) AS n, round(quantile_cont(area, 0.5), 6) AS median_area, round(quantile_cont(aspect, 0.5), 6) AS median_aspect,
       round(quantile_cont(n_valid, 0.5), 6) AS median_positives, round(quantile_cont(dup::INT, 0.5), 6) AS median_duplicate,
       round(quantile_cont(conf, 0.5), 6) AS median_top1 FROM er GROUP BY outcome""", er=ERR))
def a23(spark, sf_dir):
    e = durable(error_table(spark, sf_dir), "errors").withColumn("dup", F.col("dup").cast("double"))
    names = {"area": "median_area", "aspect": "median_aspect", "n_valid": "median_positives", "dup": "median_duplicate", "conf": "median_top1"}
    long = e.select("outcome", F.explode(F.array(*[
        F.struct(F.lit(v).alias("what"), F.col(k).cast("double").alias("x")) for k, v in names.items()])).alias("_s"))
    med = ranks.quantile_rows(long.select("outcome", "_s.what", "_s.x"), "x", [0.5], ["outcome", "what"])
    wide = med.groupBy("outcome").agg(F.max("n").cast("long").alias("n"), *[
        F.round(F.max(F.when(F.col("what") == v, F.col("x"))), 6).alias(v) for v in names.values()])
    return wide


@query("a24_quartile_breakdown", with_ctes("o q g p r d nv", """
SELECT 'area' AS part, i::INTEGER AS bin, count(*) AS queries, round(100 * avg(top_ok::INT), 6) AS rank1, round(100 * avg(in10::INT), 6) AS recall_at_10
FROM e JOIN (SELECT unnest(range(1, 5)) AS i) ON true JOIN er ON n_valid > 0 AND area >= e[i] AND area <= e[i+1] GROUP BY ALL HAVING count(*) >= 5
UNION ALL SELECT CASE WHEN dup THEN 'duplicate' ELSE 'cross_camera_only' END, 0, count(*), round(100 * avg(correct::INT), 6), round(100 * avg(in10::INT), 6)
FROM er WHERE has_match GROUP BY dup""", er=ERR,
    e="SELECT quantile_cont(area, [0, 0.25, 0.5, 0.75, 1]) AS e FROM er WHERE n_valid > 0"))
def a24(spark, sf_dir):
    e = durable(error_table(spark, sf_dir), "errors")
    pct = lambda c: F.round(100.0 * F.avg(F.col(c).cast("int").cast("double")), 6)
    area = quantile_bins(e.filter("n_valid > 0"), "area", 4).groupBy("bin").agg(
        F.count(F.lit(1)).alias("queries"), pct("top_ok").alias("rank1"), pct("in10").alias("recall_at_10")
    ).filter("queries >= 5").select(F.lit("area").alias("part"), "bin", "queries", "rank1", "recall_at_10")
    dup = e.filter("has_match").groupBy(F.when(F.col("dup"), "duplicate").otherwise("cross_camera_only").alias("part")).agg(
        F.count(F.lit(1)).alias("queries"), pct("correct").alias("rank1"), pct("in10").alias("recall_at_10"))
    return area.unionByName(dup.select("part", F.lit(0).alias("bin"), "queries", "rank1", "recall_at_10"))


@query("a25_top_examples_per_error", with_ctes("o q g p r d nv", f"""
SELECT kind, q_ord, round(conf, 6) AS conf, pos::INTEGER AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY kind ORDER BY conf DESC, q_ord) AS pos FROM (
    SELECT 'confident_miss' AS kind, * FROM er WHERE outcome = 'miss_top10' AND conf >= {THRESHOLD}
    UNION ALL SELECT 'false_accept', * FROM er WHERE NOT has_match AND conf >= {THRESHOLD}
    UNION ALL SELECT 'false_refuse', * FROM er WHERE has_match AND conf < {THRESHOLD})) WHERE pos <= 3""", er=ERR))
def a25(spark, sf_dir):
    acc = refusal.accepts(F.col("conf"), THRESHOLD)
    kinds = F.array_compact(F.array(
        F.when((F.col("outcome") == "miss_top10") & acc, F.lit("confident_miss")),
        F.when(~F.col("has_match") & acc, F.lit("false_accept")),
        F.when(F.col("has_match") & ~acc, F.lit("false_refuse"))))
    w = Window.partitionBy("kind").orderBy(F.desc("conf"), "q_ord")
    return (
        error_table(spark, sf_dir).select("q_ord", "conf", F.explode(kinds).alias("kind"))
        .withColumn("pos", F.row_number().over(w)).filter("pos <= 3").select("kind", "q_ord", r6("conf"), "pos"))
