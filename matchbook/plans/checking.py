"""Validity, geometry, scalar-function and verification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchbook.functions import calibration as cal
from matchbook.functions.text import frame_of, safe_filename, slug, stem, valid_id
from matchbook.functions.vectors import all_finite, cosine_distance, dot, norm, unit
from matchbook.model import observations, second_space, table
from matchbook.operators import boxes, graph, ranks, verify
from matchbook.operators.similarity import Plan, nearest
from matchbook.plans.registry import query, with_ctes
from matchbook.plans.searching import THRESHOLD, r6, sides
from matchbook.session import durable
from matchbook.sources import results

# ---- validity and geometry -------------------------------------------------------------------

BOXES = """SELECT vec_id AS ord, vec_id % 3000 - 40 AS x, (vec_id*53) % 1500 - 20 AS y, CASE WHEN vec_id % 31 = 0 THEN 0 ELSE (vec_id*17) % 400 - 5 END AS w, 140 + (vec_id*29) % 300 AS h FROM embeddings"""


def odd_boxes(spark, sf_dir):
    v = F.col("vec_id")
    d = lambda c: c.cast("double")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("ord"), d(v % 3000 - 40).alias("x"), d((v * 53) % 1500 - 20).alias("y"),
        d(F.when(v % 31 == 0, F.lit(0)).otherwise((v * 17) % 400 - 5)).alias("w"), d(140 + (v * 29) % 300).alias("h"))


@query("p1_box_validity", f"""
SELECT ord, w > 0 AND h > 0 AS usable, w > 0 AND h > 0 AND x >= 0 AND y >= 0 AS storable,
       w > 0 AND h > 0 AND x >= 0 AND y >= 0 AND x + w <= 1920 AND y + h <= 1080 AS inside, w > 0 AND h > 0 AND x < 1920 AND y < 1080 AND x + w > 0 AND y + h > 0 AS meets FROM ({BOXES})""")
def p1(spark, sf_dir):
    from matchbook.sources.annotations import box_problem
    x, y, w, h = (F.col(c) for c in "xywh")
    ok = box_problem(x, y, w, h).isNull()
    return odd_boxes(spark, sf_dir).select(
        "ord", ok.alias("usable"), (ok & (x >= 0) & (y >= 0)).alias("storable"),
        (ok & (x >= 0) & (y >= 0) & (x + w <= 1920) & (y + h <= 1080)).alias("inside"),
        (ok & (x < 1920) & (y < 1080) & (x + w > 0) & (y + h > 0)).alias("meets"))


@query("p2_id_validity", r"""
SELECT doc_id, part, length(s) BETWEEN 1 AND 128 AND s = regexp_replace(s, '^\s+|\s+$', '', 'g') AND s NOT IN ('.', '..')
       AND NOT regexp_matches(s, '[\p{Cc}\p{Cf}/\\]') AS valid FROM (
  SELECT doc_id, unnest(['text', 'source']) AS part, unnest([text, source]) AS s FROM documents WHERE text IS NOT NULL)""")
def p2(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", "source")
    return d.unpivot(["doc_id"], ["text", "source"], "part", "s").select("doc_id", "part", valid_id(F.col("s")).alias("valid"))


@query("p3_vector_validity", """
SELECT vec_id AS ord, len(e) = 64 AS right_size, abs(sqrt(list_inner_product(e, e)) - 1) <= 1e-3 AS unit_norm, sqrt(list_inner_product(e, e)) > 1e-8 AS nonzero, true AS finite
FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (CASE WHEN vec_id % 13 = 0 THEN 0 WHEN vec_id % 7 = 0 THEN 1.5 ELSE 1 END)) AS e FROM embeddings)""")
def p3(spark, sf_dir):
    f = F.when(F.col("vec_id") % 13 == 0, 0.0).when(F.col("vec_id") % 7 == 0, 1.5).otherwise(1.0)
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * f).alias("e"))
    n = norm(F.col("e"))
    return e.select("ord", (F.size("e") == 64).alias("right_size"), (F.abs(n - 1.0) <= 1e-3).alias("unit_norm"), (n > 1e-8).alias("nonzero"), all_finite(F.col("e")).alias("finite"))


@query("p4_unit_vectors", with_ctes("o", "SELECT ord, round(list_inner_product(emb2, emb2), 6) AS sq_norm, round(emb2[1], 6) AS first_value FROM o"))
def p4(spark, sf_dir):
    o = second_space(observations(spark, sf_dir)).select("ord", unit(F.col("emb")).alias("u"))
    return o.select("ord", F.round(dot(F.col("u"), F.col("u")), 6).alias("sq_norm"), F.round(F.element_at("u", 1), 6).alias("first_value"))


CROP = """SELECT *, greatest(0, round_even(x - 0.08 * m, 0)) AS a, greatest(0, round_even(y - 0.08 * m, 0)) AS b, least(1920, round_even(x + w + 0.08 * m, 0)) AS c,
          least(1080, round_even(y + h + 0.08 * m, 0)) AS d FROM (SELECT *, greatest(w, h)::DOUBLE AS m FROM ({0}) WHERE w > 0)"""


@query("p7_padded_crops", f"""
SELECT ord, (CASE WHEN o THEN least(a, 1919) ELSE a END)::BIGINT AS x0, (CASE WHEN o THEN least(b, 1079) ELSE b END)::BIGINT AS y0,
       (CASE WHEN o THEN greatest(least(a, 1919) + 1, least(1920, c)) ELSE c END)::BIGINT AS x1, (CASE WHEN o THEN greatest(least(b, 1079) + 1, least(1080, d)) ELSE d END)::BIGINT AS y1, o AS outside
FROM (SELECT *, c <= a OR d <= b AS o FROM ({CROP.format(BOXES)}))""")
def p7(spark, sf_dir):
    b = odd_boxes(spark, sf_dir).filter("w > 0")
    crop = boxes.padded_crop(*[F.col(c) for c in "xywh"], F.lit(1920).cast("long"), F.lit(1080).cast("long"), 0.08)
    return b.select("ord", crop.alias("_c")).select("ord", "_c.*")


@query("p8_cached_crop_geometry", with_ctes("o", """
SELECT ord, x0::BIGINT AS x0, y0::BIGINT AS y0, round(x - x0, 6) AS rel_x, round(y - y0, 6) AS rel_y FROM (
  SELECT *, greatest(0, trunc(x - 0.30::DOUBLE * greatest(w, h))) AS x0, greatest(0, trunc(y - 0.30::DOUBLE * greatest(w, h))) AS y0 FROM o)"""))
def p8(spark, sf_dir):
    return observations(spark, sf_dir).select("ord", boxes.cached_crop(*[F.col(c) for c in "xywh"]).alias("_c")).select("ord", "_c.x0", "_c.y0", r6("_c.rel_x").alias("rel_x"), r6("_c.rel_y").alias("rel_y"))


@query("p9_frame_keys", with_ctes("o", "SELECT frame, count(*) AS n, min(ord) AS first_ord FROM o GROUP BY frame"))
def p9(spark, sf_dir):
    return observations(spark, sf_dir).groupBy(frame_of(F.col("key")).alias("frame")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))


def found_boxes(spark, sf_dir):
    """Observations with 0 to 2 detected boxes (fractions of the crop)."""
    o = observations(spark, sf_dir)
    box = lambda k: F.array(*[((F.col("ord") * m + k) % 50).cast("double") / 100.0 for m in (3, 7)], F.lit(0.2), F.lit(0.1))
    return o.select("ord", "key", F.when(F.col("ord") % 3 == 0, None).when(F.col("ord") % 3 == 1, F.array(box(0))).otherwise(F.array(box(0), box(9))).alias("found"))


FOUND = """SELECT vec_id AS ord, CASE WHEN vec_id % 3 = 0 THEN [] WHEN vec_id % 3 = 1 THEN [[(vec_id*3%50)/100, (vec_id*7%50)/100, 0.2, 0.1]]
           ELSE [[(vec_id*3%50)/100, (vec_id*7%50)/100, 0.2, 0.1], [((vec_id*3+9)%50)/100, ((vec_id*7+9)%50)/100, 0.2, 0.1]] END::DOUBLE[][] AS f FROM embeddings"""


@query("p10_mask_boxes", f"""
SELECT ord, mode, len(b) AS n, round(coalesce(list_sum(list_transform(b, lambda v: v[1])), 0), 6) AS sum_x, round(coalesce(list_sum(list_transform(b, lambda v: v[2])), 0), 6) AS sum_y FROM (
  SELECT ord, 'det' AS mode, f AS b FROM fb UNION ALL SELECT ord, 'auto', CASE WHEN len(f) > 0 THEN f ELSE [[0.22, 0.62, 0.56, 0.31]]::DOUBLE[][] END FROM fb
  UNION ALL SELECT ord, 'band', [[0.22, 0.62, 0.56, 0.31]]::DOUBLE[][] FROM fb UNION ALL SELECT ord, 'up', list_transform(f, lambda v: [v[1], greatest(0, v[2] - 0.35::DOUBLE), v[3], v[4]]) FROM fb)""".replace(
    "FROM fb", f"FROM ({FOUND})"))
def p10(spark, sf_dir):
    f = found_boxes(spark, sf_dir)
    modes = [F.struct(F.lit(m).alias("mode"), boxes.mask_boxes(F.col("found"), m).alias("b")) for m in ("det", "auto", "band", "up")]
    rows = f.select("ord", F.explode(F.array(*modes)).alias("_m")).select("ord", "_m.mode", "_m.b")
    total = lambda i: F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x[i]), 6)
    return rows.select("ord", "mode", F.size("b").cast("long").alias("n"), total(0).alias("sum_x"), total(1).alias("sum_y"))


DRAW = "(('0x' || substr(md5('0:' || key || ':' || {i} || ':' || {n}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("p10_random_mask_boxes", with_ctes("o", f"""
SELECT ord, i::INTEGER AS box, round({DRAW.format(i="i", n=0)} * (1 - b[3]), 6) AS x, round({DRAW.format(i="i", n=1)} * (1 - b[4]), 6) AS y, b[3] AS w, b[4] AS h
FROM (SELECT fb.ord, o.key, unnest(range(0, len(f))) AS i, unnest(f) AS b FROM fb JOIN o USING (ord))""", fb=FOUND))
def p10_rand(spark, sf_dir):
    drawn = found_boxes(spark, sf_dir).select("ord", F.posexplode(boxes.mask_boxes(F.col("found"), "rand", 0, F.col("key"))).alias("box", "b"))
    return drawn.select("ord", "box", F.round(F.col("b")[0], 6).alias("x"), F.round(F.col("b")[1], 6).alias("y"), F.col("b")[2].alias("w"), F.col("b")[3].alias("h"))


@query("p11_cache_keys", with_ctes("o", """
SELECT 'im' || (ord % 40) || ':' || round_even(x / 8, 0)::BIGINT || ',' || round_even(y / 8, 0)::BIGINT || ',' || round_even(w / 60, 0)::BIGINT || ',' || round_even(h / 60, 0)::BIGINT AS cache_key,
       min(ord) AS first_ord FROM o GROUP BY 1"""))
def p11(spark, sf_dir):
    o = observations(spark, sf_dir)
    key = boxes.cache_key(F.concat(F.lit("im"), (F.col("ord") % 40).cast("string")), F.col("x") / 8, F.col("y") / 8, F.col("w") / 60, F.col("h") / 60)
    return o.groupBy(key.alias("cache_key")).agg(F.min("ord").alias("first_ord"))


@query("p12_box_descriptors", with_ctes("o", "SELECT ord, w * h AS area, round(w / greatest(h, 1e-6), 6) AS aspect, x + w / 2 AS centre_x, y + h / 2 AS centre_y FROM o"))
def p12(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in "xywh")
    return observations(spark, sf_dir).select("ord", (w * h).alias("area"), F.round(w / F.greatest(h, F.lit(1e-6)), 6).alias("aspect"), (x + w / 2).alias("centre_x"), (y + h / 2).alias("centre_y"))


CELLS = "SELECT vec_id AS id, vec_id // 25 AS crop, (vec_id * 37) % 110 AS x, (vec_id * 53) % 90 AS y, 6 + (vec_id * 17) % 5 AS w, 6 + (vec_id * 29) % 4 AS h FROM embeddings"


@query("p13_cell_groups", f"""
WITH RECURSIVE c AS MATERIALIZED ({CELLS}),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.crop = b.crop AND a.id <> b.id AND abs(a.w - b.w) <= 0.28 * greatest(a.w, b.w) AND abs(a.h - b.h) <= 0.28 * greatest(a.h, b.h)
  AND greatest(0, greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w)) <= 0.8 * greatest(a.w, b.w) AND greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) <= 0.8 * greatest(a.h, b.h)),
t(id, r) AS (SELECT id, id FROM c UNION SELECT t.id, e.b FROM t JOIN e ON e.a = t.r)
SELECT crop, label, greatest(0, x0 - px) AS x, greatest(0, y0 - py) AS y, least(640, x1 + px) - greatest(0, x0 - px) AS w, least(480, y1 + py) - greatest(0, y0 - py) AS h, n FROM (
  SELECT crop, label, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, trunc(0.06 * (max(x + w) - min(x)))::BIGINT + 1 AS px, trunc(0.06 * (max(y + h) - min(y)))::BIGINT + 1 AS py
  FROM c JOIN (SELECT id, min(r) AS label FROM t GROUP BY id) l ON l.id = c.id GROUP BY crop, label HAVING count(*) >= 3)""")
def p13(spark, sf_dir):
    v = F.col("vec_id")
    cells = table(spark, sf_dir, "embeddings").select(
        v.alias("id"), F.expr("vec_id div 25").alias("crop"), ((v * 37) % 110).alias("x"), ((v * 53) % 90).alias("y"), (6 + (v * 17) % 5).alias("w"), (6 + (v * 29) % 4).alias("h"))
    return boxes.enclosing_boxes(cells, 640, 480)


@query("a37_box_table_health", f"""
SELECT count(*) AS n, round(avg((len(f) > 0)::INT), 6) AS share_with_boxes, sum(len(f))::BIGINT AS n_boxes,
       (SELECT round(quantile_cont(v[2] + v[4] / 2, 0.5), 6) FROM (SELECT unnest(f) AS v FROM ({FOUND}))) AS median_centre_y,
       (SELECT round(quantile_cont(v[3], 0.5), 6) FROM (SELECT unnest(f) AS v FROM ({FOUND}))) AS median_width, sum(len(f)) = 0 AS empty FROM ({FOUND})""")
def a37(spark, sf_dir):
    f = found_boxes(spark, sf_dir)
    b = f.select(F.explode("found").alias("b")).select((F.col("b")[1] + F.col("b")[3] / 2).alias("cy"), F.col("b")[2].alias("bw"))
    med = lambda c: F.round(F.lit(ranks.quantiles(b, c, {"m": 0.5}).first()["m"]), 6)
    n = F.greatest(F.size("found"), F.lit(0))
    return f.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((n > 0).cast("int").cast("double")), 6).alias("share_with_boxes"), F.sum(n).alias("n_boxes"),
    ).select("n", "share_with_boxes", "n_boxes", med("cy").alias("median_centre_y"), med("bw").alias("median_width"), (F.col("n_boxes") == 0).alias("empty"))


# ---- scalar functions ------------------------------------------------------------------------

PROB = "SELECT event_id, least(greatest((value % 100) / 100, 0.0001), 0.9999) AS p, least(greatest(((value * 7) % 100) / 100, 0.0001), 0.9999) AS q FROM events"
LG = "ln({0} / (1 - {0}))"


def probabilities(spark, sf_dir):
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0001)), F.lit(0.9999))
    return table(spark, sf_dir, "events").select(
        "event_id", clip((F.col("value") % 100) / 100).alias("p"), clip(((F.col("value") * 7) % 100) / 100).alias("q"))


@query("x1_dot_and_distance", with_ctes("o q g p r", "SELECT q_ord, g_ord, round(sim, 6) AS cosine, round(2 - 2 * sim, 6) AS distance FROM r WHERE pos <= 3"))
def x1(spark, sf_dir):
    return nearest(*sides(spark, sf_dir), 3).select("q_ord", "g_ord", F.round("sim", 6).alias("cosine"), F.round(cosine_distance(F.col("sim")), 6).alias("distance"))


@query("x3_threshold_shift", f"""
SELECT event_id, round(z, 6) AS shifted, p >= 0.4 AS accepted FROM (SELECT event_id, p, 1 / (1 + exp(-({LG.format('p')} - {LG.format('0.4::DOUBLE')} + {LG.format('0.55::DOUBLE')}))) AS z FROM ({PROB}))""")
def x3(spark, sf_dir):
    s = cal.shift_to_boundary(F.col("p"), 0.4, 0.55)
    return probabilities(spark, sf_dir).select("event_id", F.round(s, 6).alias("shifted"), (s >= 0.55).alias("accepted"))


@query("x4_log_odds_blend", f"SELECT event_id, round(1 / (1 + exp(-(0.7::DOUBLE * {LG.format('p')} + 0.3::DOUBLE * {LG.format('q')}))), 6) AS blended FROM ({PROB})")
def x4(spark, sf_dir):
    return probabilities(spark, sf_dir).select("event_id", F.round(cal.log_odds_blend(F.col("p"), F.col("q"), 0.3), 6).alias("blended"))


@query("x5_relative_odds", f"SELECT event_id, round(1 / (1 + exp(-({LG.format('p')} - {LG.format('q')}))), 6) AS odds, round(p / (p + q), 6) AS share FROM ({PROB})")
def x5(spark, sf_dir):
    return probabilities(spark, sf_dir).select(
        "event_id", F.round(cal.relative_odds(F.col("p"), F.col("q")), 6).alias("odds"), F.round(cal.probability_share(F.col("p"), F.col("q")), 6).alias("share"))


@query("x7_box_conversion", with_ctes("o", "SELECT ord, x, y, (x + w) - x AS w, (y + h) - y AS h, round((x + w - x) / (y + h - y), 6) AS aspect FROM o"))
def x7(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("x2", F.col("x") + F.col("w")).withColumn("y2", F.col("y") + F.col("h"))
    w, h = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    return o.select("ord", "x", "y", w.alias("w"), h.alias("h"), F.round(w / h, 6).alias("aspect"))


@query("x8_names", r"""
SELECT page_id, split_part(url, '#', 1) AS before_hash, regexp_replace(split_part(url, '/', -1), '(.)\.[^.]*$', '\1') AS stem,
       regexp_replace(url, '[^\p{L}\p{N}_.\-]', '_', 'g') AS safe, regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') AS slug, lower(url) AS lowered FROM pages""")
def x8(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", frame_of(u).alias("before_hash"), stem(u).alias("stem"), safe_filename(u).alias("safe"), slug(u).alias("slug"), F.lower(u).alias("lowered"))


@query("x9_content_hashes", "SELECT doc_id, sha256(text) AS digest, sha256(lang || '|' || sha256(text)) AS keyed FROM documents")
def x9(spark, sf_dir):
    d = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", d.alias("digest"), F.sha2(F.concat_ws("|", "lang", d), 256).alias("keyed"))


@query("x9_feature_references")
def x9_ref(spark, sf_dir):
    from matchbook.sources.store import feature_reference
    return observations(spark, sf_dir).select("ord", feature_reference("ns1", "emb").alias("feature_ref"))


@query("x10_box_json", with_ctes("o", "SELECT ord, x, h, '[' || x::BIGINT || ',' || y::BIGINT || ',' || w::BIGINT || ',' || h::BIGINT || ']' AS box FROM o"))
def x10(spark, sf_dir):
    j = observations(spark, sf_dir).select("ord", F.to_json(F.array(*[F.col(c).cast("long") for c in "xywh"])).alias("box"))
    parsed = F.from_json("box", "array<double>")
    return j.select("ord", parsed[0].alias("x"), parsed[3].alias("h"), "box")


@query("x11_utc_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS created_at FROM events")
def x11(spark, sf_dir):
    # The stored wall time is already UTC, whatever the session zone.
    wall = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


@query("x12_array_sets", with_ctes("o q g p r", """
SELECT q_ord, len(list_intersect(a, b)) AS common, a[1:2] AS head FROM (
  SELECT q_ord, list(g_ord ORDER BY pos) FILTER (pos <= 8) AS a, list(g_ord ORDER BY pos2) FILTER (pos2 <= 8) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim2 DESC, g_ord) AS pos2 FROM r) GROUP BY q_ord)"""))
def x12(spark, sf_dir):
    from matchbook.operators.fusion import ranked_list
    q, g = sides(spark, sf_dir)
    j = ranked_list(nearest(q, g, 8), "a").join(ranked_list(nearest(second_space(q), second_space(g), 8), "b"), "q_ord")
    return j.select("q_ord", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.slice("a", 1, 2).alias("head"))


@query("x13_linear_quantiles", "SELECT p, round(quantile, 6) AS x FROM (SELECT unnest([0.1, 0.25, 0.5, 0.9, 0.99])::DOUBLE AS p, unnest(quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.9, 0.99])) AS quantile FROM lineitem)")
def x13(spark, sf_dir):
    return ranks.quantile_rows(table(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", [0.1, 0.25, 0.5, 0.9, 0.99]).select("p", r6("x"))


@query("u5_sql_functions", with_ctes("o q g p r", f"""
SELECT q_ord, round(sim, 6) AS cosine, round(1 / (1 + exp(-(sim * 4 - 1))), 6) AS squashed FROM r WHERE pos = 1"""))
def u5(spark, sf_dir):
    """The scalar helpers as SQL functions, used from SQL text."""
    q, g = sides(spark, sf_dir)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION squash(z DOUBLE) RETURNS DOUBLE RETURN 1D / (1D + exp(-z))")
    best = nearest(q, g, 1)
    a = q.select(F.col("ord").alias("q_ord"), unit(F.col("emb")).alias("qe"))
    b = g.select(F.col("ord").alias("g_ord"), unit(F.col("emb")).alias("ge"))
    pairs = best.select("q_ord", "g_ord").join(a, "q_ord").join(b, "g_ord")
    return spark.sql("SELECT q_ord, round(vec_dot(qe, ge), 6) AS cosine, round(squash(vec_dot(qe, ge) * 4D - 1D), 6) AS squashed FROM {pairs}", pairs=pairs)


# ---- verification ----------------------------------------------------------------------------

def result_set(spark, sf_dir, q, g, spoil: bool = False):
    """Ranking, candidates and embeddings of one run; ``spoil`` plants known faults."""
    top = durable(nearest(q, g, 10, q_carry=["key"], g_carry=["key"]), "run")
    rank = top.select(F.col("q_ord"), F.col("q_key").alias("query_id"), "pos", F.col("g_key").alias("gallery_id"))
    cand = results.candidates(top, THRESHOLD)
    if spoil:
        rank = rank.filter("q_ord % 45 <> 0").withColumn("gallery_id", F.when((F.col("q_ord") % 35 == 0) & (F.col("pos") == 10), F.lit("nowhere")).otherwise(F.col("gallery_id")))
        cand = cand.withColumn("confidence", F.when(F.col("q_ord") % 55 == 0, F.lit(float("nan"))).otherwise(F.col("confidence")))
    emb = q.select(F.col("key").alias("id"), "emb").union(g.filter("ord % 51 <> 1" if spoil else "true").select(F.col("key").alias("id"), "emb"))
    return rank.drop("q_ord"), cand.drop("q_ord"), emb


PROBLEMS = f"""
SELECT 'ranking_missing_query' AS rule, 'error' AS severity, count(*) FILTER (ord % 45 = 0) AS violations FROM q
UNION ALL SELECT 'ranking_unknown_query', 'error', 0 UNION ALL SELECT 'ranking_wrong_length', 'error', 0
UNION ALL SELECT 'ranking_unknown_gallery', 'error', count(*) FROM q WHERE ord % 35 = 0 AND ord % 45 <> 0
UNION ALL SELECT 'ranking_repeated_gallery', 'warning', 0 UNION ALL SELECT 'candidate_unknown_id', 'error', 0
UNION ALL SELECT 'candidate_not_finite', 'error', count(*) FROM r WHERE pos = 1 AND sim >= {THRESHOLD} AND q_ord % 55 = 0
UNION ALL SELECT 'candidate_repeated_pair', 'error', 0 UNION ALL SELECT 'several_rows_per_query', 'warning', 0
UNION ALL SELECT 'nothing_refused', 'warning', (count(*) FILTER (sim >= {THRESHOLD}) = count(*))::BIGINT FROM r WHERE pos = 1
UNION ALL SELECT 'everything_refused', 'warning', (count(*) FILTER (sim >= {THRESHOLD}) = 0)::BIGINT FROM r WHERE pos = 1
UNION ALL SELECT 'embedding_not_finite', 'error', 0 UNION ALL SELECT 'embedding_zero', 'error', 0 UNION ALL SELECT 'embedding_wrong_dimension', 'error', 0
UNION ALL SELECT 'embedding_not_unit', 'warning', 0 UNION ALL SELECT 'embedding_missing', 'error', count(*) FROM g WHERE ord % 51 = 1"""


def problems(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    rank, cand, emb = result_set(spark, sf_dir, q, g, spoil=True)
    ids = lambda df: df.select(F.col("key").alias("id"))
    return verify.result_problems(ids(q), ids(g), rank, cand, emb, 10, 64)


@query("v1_result_validation", with_ctes("o q g p r", f"SELECT rule, violations FROM ({PROBLEMS}) WHERE severity = 'error'"))
def v1(spark, sf_dir):
    return problems(spark, sf_dir).filter("severity = 'error'").select("rule", "violations")


@query("v2_preflight_report", with_ctes("o q g p r", PROBLEMS))
def v2(spark, sf_dir):
    return problems(spark, sf_dir)


@query("v3_query_independence", "SELECT 0::BIGINT AS differing_rows, (SELECT count(*) FROM embeddings WHERE vec_id % 15 = 0) * 10 AS compared_rows")
def v3(spark, sf_dir):
    """Re-ranked results of a third of the queries alone equal those of all queries together."""
    q, g = sides(spark, sf_dir)
    gr = graph.build_graph(g, 3, 2)
    cols = ["q_ord", "g_ord", "pos", "dist"]
    every = durable(graph.k_reciprocal(q, g, 10, gr, 0.2).select(*cols).filter("q_ord % 15 = 0"), "all-queries")
    alone = durable(graph.k_reciprocal(q.filter("ord % 15 = 0"), g, 10, gr, 0.2).select(*cols), "some-queries")
    diff = every.exceptAll(alone).union(alone.exceptAll(every)).agg(F.count(F.lit(1)).alias("n")).scalar()
    return every.agg(diff.alias("differing_rows"), F.count(F.lit(1)).alias("compared_rows"))


@query("v4_tie_independence", "SELECT 0::BIGINT AS differing_rows")
def v4(spark, sf_dir):
    """With every fifth gallery row duplicated, block sizes and partitioning do not change the result."""
    q, g = sides(spark, sf_dir)
    twins = g.filter("ord % 5 = 1").withColumn("ord", F.col("ord") + 1000000).withColumn("frame", F.concat("frame", F.lit("t")))
    both = durable(g.unionByName(twins), "with-twins")
    a = durable(nearest(q, both, 10).select("q_ord", "g_ord", "pos"), "a")
    b = durable(nearest(q.repartition(5), both.repartition(7), 10, Plan(q_rows=17, g_rows=41)).select("q_ord", "g_ord", "pos"), "b")
    return a.exceptAll(b).union(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("differing_rows"))


CMP = dict(
    r2="SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim2 DESC, g_ord) AS pos FROM p",
    ca=f"SELECT q_key, g_key, round(sim, 5) AS c FROM r WHERE pos = 1 AND sim >= {THRESHOLD}", cb=f"SELECT q_key, g_key, round(sim2, 5) AS c FROM r2 WHERE pos = 1 AND sim2 >= {THRESHOLD}")
CMP_SQL = """
SELECT 'accepted_differ' AS measure, count(*)::DOUBLE AS value FROM ca FULL JOIN cb ON ca.q_key = cb.q_key WHERE ca.q_key IS NULL OR cb.q_key IS NULL
UNION ALL SELECT 'pairs_common', count(*)::DOUBLE FROM ca JOIN cb ON ca.q_key = cb.q_key AND ca.g_key = cb.g_key
UNION ALL SELECT 'pairs_differ', count(*)::DOUBLE FROM ca FULL JOIN cb ON ca.q_key = cb.q_key AND ca.g_key = cb.g_key WHERE ca.q_key IS NULL OR cb.q_key IS NULL
UNION ALL SELECT 'confidence_max_difference', round(coalesce(max(abs(ca.c - cb.c)), 0), 6) FROM ca JOIN cb ON ca.q_key = cb.q_key AND ca.g_key = cb.g_key
UNION ALL SELECT 'top1_same', count(*)::DOUBLE FROM r JOIN r2 ON r.q_ord = r2.q_ord AND r.pos = 1 AND r2.pos = 1 AND r.g_ord = r2.g_ord
UNION ALL SELECT 'cells_differ', count(*)::DOUBLE FROM r JOIN r2 ON r.q_ord = r2.q_ord AND r.pos = r2.pos AND r.pos <= 10 AND r.g_ord <> r2.g_ord"""


def two_runs(spark, sf_dir, a, b):
    ra, ca, ea = result_set(spark, sf_dir, *a)
    rb, cb, eb = result_set(spark, sf_dir, *b)
    return verify.compare_runs(ra, rb, ca, cb, ea, eb)


@query("j15_two_run_differences", with_ctes("o q g p r", CMP_SQL, **CMP))
def j15(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return two_runs(spark, sf_dir, (q, g), (second_space(q), second_space(g))).filter("measure <> 'min_cosine'").select("measure", r6("value"))


@query("v5_compare_outputs", with_ctes("o q g p r", """
SELECT unnest(['accepted_differ', 'pairs_common', 'pairs_differ', 'confidence_max_difference', 'top1_same', 'cells_differ', 'min_cosine']) AS measure,
       unnest([0, (SELECT count(*) FROM ca), 0, 0, (SELECT count(*) FROM q), 0, 1])::DOUBLE AS value""", ca=CMP["ca"]))
def v5(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return two_runs(spark, sf_dir, (q, g), (q.repartition(3), g.repartition(5))).select("measure", r6("value"))


@query("v6_cached_replay", with_ctes("o q", "SELECT count(*) AS n_queries, 0::BIGINT AS changed_cells, 0::BIGINT AS changed_top1 FROM q"))
def v6(spark, sf_dir):
    """Rankings rebuilt from stored embeddings against the first ones."""
    q, g = sides(spark, sf_dir)
    a = nearest(q, g, 10).select("q_ord", "pos", F.col("g_ord").alias("a"))
    b = nearest(durable(q, "q-cache"), durable(g, "g-cache"), 10).select("q_ord", "pos", F.col("g_ord").alias("b"))
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    return a.join(b, ["q_ord", "pos"], "full_outer").agg(
        F.countDistinct("q_ord").alias("n_queries"), F.sum(differ.cast("long")).alias("changed_cells"), F.sum((differ & (F.col("pos") == 1)).cast("long")).alias("changed_top1"))


def digest_sql(columns: list[str], t: str) -> str:
    text = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n')" for c in columns)
    return (f"SELECT count(*) AS n, bit_xor(('0x' || substr(d, 1, 15))::BIGINT) AS digest, sum(('0x' || substr(d, 16, 8))::BIGINT)::BIGINT AS total "
            f"FROM (SELECT md5({text}) AS d FROM {t})")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("v8_table_fingerprint", digest_sql(ORDER_COLUMNS, "orders"))
def v8(spark, sf_dir):
    return verify.fingerprint(table(spark, sf_dir, "orders"), ORDER_COLUMNS)


@query("v7_rebuild_equivalence", "SELECT count(*) AS n, true AS same FROM lineitem")
def v7(spark, sf_dir):
    """Digest of a table before and after it is rewritten with another layout."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    li = table(spark, sf_dir, "lineitem").select(*cols)
    after = verify.fingerprint(durable(li.repartition(5, "l_partkey"), "rebuilt"), cols).select(F.struct("n", "digest", "total").alias("d")).scalar()
    return verify.fingerprint(li, cols).select("n", (F.struct("n", "digest", "total") == after).alias("same"))


@query("v8_file_inventory", "SELECT count(*) AS n_files, sum(n_chars)::BIGINT AS total_bytes FROM documents")
def v8_files(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("w/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length"))
    return verify.inventory(files, 2_000_000_000_000)


V9 = """SELECT doc_id, i, regexp_replace(regexp_replace(line, '\\d+[.,]\\d+\\s*(?:мс|ms|c\\)|с\\)|s\\))|\\d+[.,]\\d+\\s*batch/s|\\d+:\\d\\d(?:<|,|\\])|\\([\\d.,]+\\s*(?:c|с|s)\\)', '<t>', 'g'), '[ \\t\\n\\f\\r]+$', '') AS line
        FROM ({0}) WHERE NOT (contains(line, chr(13)) OR contains(line, 'it/s') OR contains(line, 'batch/s') OR contains(line, '%|') OR contains(line, 'Warning') OR contains(line, 'warning'))"""
LINES = "SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query("v9_scrubbed_text_comparison", f"""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, count(*) AS differing_lines FROM (SELECT * FROM ({V9.format(LINES)}) WHERE line <> '') a
FULL JOIN (SELECT * FROM ({V9.format("SELECT doc_id, i, CASE WHEN doc_id % 7 = 0 THEN upper(line) ELSE line END AS line FROM (" + LINES + ")")}) WHERE line <> '') b
ON a.doc_id = b.doc_id AND a.i = b.i WHERE a.line IS DISTINCT FROM b.line GROUP BY 1""")
def v9(spark, sf_dir):
    """Text lines of every document against a rewritten copy, volatile parts removed."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    other = lines.withColumn("line", F.when(F.col("doc_id") % 7 == 0, F.upper("line")).otherwise(F.col("line")))
    a, b = verify.scrub(lines), verify.scrub(other)
    j = a.withColumnRenamed("line", "a").join(b.withColumnRenamed("line", "b"), ["doc_id", "i"], "full_outer")
    return j.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("differing_lines"))
