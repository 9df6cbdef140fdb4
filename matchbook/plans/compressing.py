"""Compression, approximate search, linear maps, insertion graph and streaming queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions import calibration as cal
from matchbook.functions.extensions import embed, knn_lateral
from matchbook.functions.half import half_codes, half_decoded
from matchbook.functions.vectors import doubles, unit
from matchbook.model import gallery_side, observations, table
from matchbook.operators import ann, codes, compress, graph, insertion, metrics, patches, splits
from matchbook.operators.similarity import Plan, nearest
from matchbook.plans.registry import query, with_ctes
from matchbook.plans.reranking import graph_ctes, two_space_rank
from matchbook.plans.searching import THRESHOLD, r6, sides
from matchbook.plans.storing import items
from matchbook.session import durable, scratch_path
from matchbook.sources.store import GalleryStore
from matchbook.streaming import ingest, oplog
from matchbook.streaming.search import search_stream

# ---- variants and codes ----------------------------------------------------------------------

VARIANT = """SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN 'f32' WHEN 1 THEN 'f16' WHEN 2 THEN 'pca' || p_size WHEN 3 THEN 'pcaw' || p_size || '_i8'
             WHEN 4 THEN 'pca' || p_size || '_bin' ELSE 'pq' || (1 + p_size % 16) END AS name FROM part"""


def variants(spark, sf_dir) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    name = (
        F.when(k == 0, "f32").when(k == 1, "f16").when(k == 2, F.concat(F.lit("pca"), size)).when(k == 3, F.concat(F.lit("pcaw"), size, F.lit("_i8")))
        .when(k == 4, F.concat(F.lit("pca"), size, F.lit("_bin"))).otherwise(F.concat(F.lit("pq"), (1 + F.col("p_size") % 16).cast("string"))))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query("u6_variant_names", f"""
SELECT p_partkey, name, CASE WHEN p_partkey % 6 = 0 THEN 'f32' WHEN p_partkey % 6 IN (1, 2) THEN 'f16' WHEN p_partkey % 6 = 3 THEN 'i8' WHEN p_partkey % 6 = 4 THEN 'bin' ELSE 'pq' END AS kind,
       CASE WHEN p_partkey % 6 IN (2, 3, 4) THEN p_size END::INTEGER AS d, CASE WHEN p_partkey % 6 = 5 THEN 1 + p_size % 16 END::INTEGER AS m, p_partkey % 6 = 3 AS whiten FROM ({VARIANT})""")
def u6(spark, sf_dir):
    v = variants(spark, sf_dir)
    return v.select("p_partkey", "name", *compress.variant_columns(F.col("name"), 64)).drop("bytes")


@query("c1_bytes_per_vector", f"""
SELECT name, count(*) AS n, max(CASE WHEN name = 'f32' THEN 256 WHEN name = 'f16' THEN 128 WHEN p_partkey % 6 = 2 THEN 2 * p_size WHEN p_partkey % 6 = 3 THEN p_size
       WHEN p_partkey % 6 = 4 THEN (p_size + 7) // 8 ELSE 1 + p_size % 16 END)::BIGINT AS bytes FROM ({VARIANT}) GROUP BY name""")
def c1(spark, sf_dir):
    v = variants(spark, sf_dir)
    return v.select("name", *compress.variant_columns(F.col("name"), 64)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"))


@query("c1_half_precision", with_ctes("o g", """
SELECT ord, bits::INTEGER[] AS bits, list_transform(vals, lambda v: round(v, 9)) AS decoded FROM (
  SELECT ord, list_transform(st, lambda t: ((t[1] + 14) * 1024 + t[2] + t[3])) AS bits, list_transform(st, lambda t: t[2] * pow(2::DOUBLE, t[1] - 10) * (CASE WHEN t[3] > 0 THEN -1 ELSE 1 END)) AS vals FROM (
    SELECT ord, list_transform(emb, lambda x: [greatest(-14, CASE WHEN x = 0 THEN -14 ELSE floor(log2(abs(x))) END)::DOUBLE,
      round_even(abs(x) / pow(2::DOUBLE, greatest(-14, CASE WHEN x = 0 THEN -14 ELSE floor(log2(abs(x))) END) - 10), 0)::DOUBLE, CASE WHEN x < 0 THEN 32768 ELSE 0 END::DOUBLE]) AS st FROM g))"""))
def c1_half(spark, sf_dir):
    """Unit gallery vectors as 16-bit floats and back."""
    rows = gallery_side(spark, sf_dir).select("ord", half_codes(unit(F.col("emb"))).alias("codes"))
    return rows.select("ord", F.transform("codes", lambda c: c.cast("int").bitwiseAND(0xFFFF)).alias("bits"), F.transform(half_decoded(F.col("codes")), lambda v: F.round(v, 9)).alias("decoded"))


@query("c2_principal_projection")
def c2(spark, sf_dir):
    g = gallery_side(spark, sf_dir)
    pca = compress.fit_pca(g, 8)
    return compress.project(g.select("ord", "emb"), pca).select("ord", F.col("z").alias("projected"), F.lit(pca.explained).alias("explained"))


@query("c3_int8_codes")
def c3(spark, sf_dir):
    g = gallery_side(spark, sf_dir).select("ord", "emb")
    z = durable(compress.project(g, compress.fit_pca(g, 8)).select("ord", "z"), "projected")
    scale = compress.int8_scale(z)
    codes = compress.int8_codes(F.col("z"), scale)
    return z.select("ord", codes.alias("codes"), F.lit(scale).alias("scale"))


@query("c4_sign_code_search", with_ctes("o q g", """
SELECT q_ord, g_ord, round(s, 6) AS similarity, pos::INTEGER AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY s DESC, g_ord) AS pos FROM (
    SELECT q.ord AS q_ord, g.ord AS g_ord, 1 - list_sum(list_transform(list_zip(q.emb, g.emb), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT)) / 64 AS s
    FROM q JOIN g ON q.frame <> g.frame)) WHERE pos <= 5"""))
def c4(spark, sf_dir):
    """Nearest rows by Hamming similarity of sign codes.

    Codes as +1/-1 vectors have cosine 1 - 2 ham / d, so the blocked search ranks them exactly.
    """
    q, g = sides(spark, sf_dir)
    signs = lambda df: df.withColumn("emb", F.transform("emb", lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(-1.0))))
    top = nearest(signs(q), signs(g), 5, Plan(normalise=False))
    return top.select("q_ord", "g_ord", F.round(0.5 + F.col("sim") / 128.0, 6).alias("similarity"), "pos")


@query("x6_packed_hamming", with_ctes("o q g p r", """
SELECT q_ord, g_ord, round(1 - list_sum(list_transform(list_zip(a.emb, b.emb), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT)) / 64, 6) AS similarity
FROM r JOIN o a ON a.ord = q_ord JOIN o b ON b.ord = g_ord WHERE pos <= 5"""))
def x6(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    word = lambda df, k: df.select(F.col("ord").alias(k), compress.sign_words(doubles(F.col("emb")), 64).alias("w_" + k))
    j = nearest(q, g, 5).select("q_ord", "g_ord").join(word(q, "q_ord"), "q_ord").join(word(g, "g_ord"), "g_ord")
    return j.select("q_ord", "g_ord", F.round(compress.hamming_similarity(F.col("w_q_ord"), F.col("w_g_ord"), 64), 6).alias("similarity"))


FIXED_SCALE = 0.004


@query("c3_int8_codes_of_fixed_scale", with_ctes("o g", f"""
SELECT ord, list_transform(emb, lambda x: greatest(-127, least(127, round_even(x / {FIXED_SCALE}::DOUBLE, 0)))::INTEGER) AS codes,
       list_max(list_transform(emb, lambda x: abs(x))) <= 127.5 * {FIXED_SCALE} AS in_range FROM g"""))
def c3_fixed(spark, sf_dir):
    """Codes of a given scale, and whether every value of the row lies within it."""
    g = gallery_side(spark, sf_dir)
    codes = compress.int8_codes(F.col("emb"), FIXED_SCALE)
    return g.select("ord", codes.cast("array<int>").alias("codes"), (F.array_max(F.transform("emb", F.abs)) <= 127.5 * FIXED_SCALE).alias("in_range"))


@query("c2_projection_error", with_ctes("o g", "SELECT count(*) AS n, true AS lengths_add_up, true AS explained_agrees FROM g"))
def c2_error(spark, sf_dir):
    """A principal projection and what it leaves add up to each centred vector; its explained share is that of the lengths."""
    g = gallery_side(spark, sf_dir).select("ord", "emb")
    pca = compress.fit_pca(g, 8)
    mean, weights = [float(v) for v in pca.mean], pca.weights.tolist()
    z = compress.project(g, pca).select("ord", "z")
    centred = F.zip_with(doubles(F.col("emb")), F.lit(mean).cast("array<double>"), lambda x, m: x - m)
    back = F.transform(F.lit(weights).cast("array<array<double>>"), lambda row: F.aggregate(F.zip_with(row, F.col("z"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    rows = g.join(z, "ord").withColumn("c", centred).withColumn("r", F.zip_with("c", back, lambda x, y: x - y))
    rows = rows.select(square(F.col("c")).alias("all"), square(F.col("z")).alias("kept"), square(F.col("r")).alias("left"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("all") - F.col("kept") - F.col("left"))) < 1e-9).alias("lengths_add_up"),
        (F.abs(F.sum("kept") / F.sum("all") - float(pca.explained)) < 1e-6).alias("explained_agrees"))


@query("c5_product_codes")
def c5(spark, sf_dir):
    """Codes of 256 fitted centroids in each of eight parts, and how far the decoded vector is from the unit vector."""
    g = gallery_side(spark, sf_dir).select("ord", "emb")
    books = codes.fitted_books(g, 8, 64)
    rows = durable(codes.encoded(g, books), "codes")
    back = codes.decoded(rows, books).select("ord", F.col("emb").alias("back"))
    gap = F.aggregate(F.zip_with(unit(F.col("emb")), "back", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, v: t + v)
    return rows.join(back, "ord").join(g, "ord").select("ord", F.hex("code").alias("code"), F.sqrt(gap).alias("error"))


POOL = 50


@query("c5_code_search", with_ctes("o q g", f"""
SELECT q_ord, g_ord, round(sim, 6) AS sim, pos::INTEGER AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY q_ord ORDER BY sim DESC, g_ord) AS pos FROM (
    SELECT q.ord AS q_ord, c.ord AS g_ord, list_inner_product(q.emb, c.emb) AS sim,
           row_number() OVER (PARTITION BY q.ord ORDER BY list_inner_product(q.emb, c.decoded) DESC, c.ord) AS by_code
    FROM q JOIN c ON q.frame <> c.frame) WHERE by_code <= {POOL}) WHERE pos <= 10""",
    b="SELECT part, row_number() OVER (PARTITION BY part ORDER BY ord) AS number, emb[8 * part + 1 : 8 * part + 8] AS piece FROM (SELECT ord, emb FROM g ORDER BY ord LIMIT 256), range(8) AS r(part)",
    n="""SELECT g.ord, b.part, arg_min(b.piece, struct_pack(d := list_sum(list_transform(list_zip(g.emb[8 * b.part + 1 : 8 * b.part + 8], b.piece), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), i := b.number)) AS piece
         FROM g CROSS JOIN b GROUP BY g.ord, b.part""",
    c="SELECT g.ord, any_value(g.frame) AS frame, any_value(g.emb) AS emb, flatten(list(n.piece ORDER BY n.part)) AS decoded FROM g JOIN n ON n.ord = g.ord GROUP BY g.ord"))
def c5_search(spark, sf_dir):
    """Top ten by exact scores among the 50 best by distance tables; the books are the parts of the first 256 rows."""
    q, g = sides(spark, sf_dir)
    index = codes.CodeIndex(g, 8, 64, codes.books_of_rows(g, 8, 64))
    return index.search(q, 10, POOL).select("q_ord", "g_ord", r6("sim"), "pos")


@query("c5_code_recall")
def c5_recall(spark, sf_dir):
    """Share of the true ten that searches on fitted codes of 8 and 16 bytes find, before and after re-scoring 100 rows a query."""
    q, g = sides(spark, sf_dir)
    true = durable(nearest(q, g, 10).select("q_ord", "g_ord"), "true")
    total, out = true.count(), []
    for m in (8, 16):
        index = codes.CodeIndex(g, m, 64)
        pool = durable(index.pool(q, 100).select("q_ord", "g_ord", "pos"), "code-pool")
        for kind, found in (("codes", pool.filter("pos <= 10")), ("re-scored", index.rescored(q, pool.select("q_ord", "g_ord"), 10))):
            hits = true.join(found.select("q_ord", "g_ord"), ["q_ord", "g_ord"]).agg((F.count(F.lit(1)) / float(max(1, total))).alias("recall"))
            out.append(hits.select(F.lit(f"pq{m}").alias("variant"), F.lit(kind).alias("scores"), F.lit(index.bytes_per_vector).alias("bytes"), "recall"))
    return reduce(DataFrame.unionByName, out)


@query("c6_token_reduction")
def c6(spark, sf_dir):
    """Principal directions of patch tokens, applied to every token."""
    g = gallery_side(spark, sf_dir)
    tokens = patches.token_table(g, 16, 4).select("ord", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("tokens", i * 4 + 1, 4))).alias("cell", "emb"))
    tokens = durable(tokens, "tokens")
    return compress.project(tokens, compress.fit_pca(tokens, 2), normalise=True).select("ord", "cell", F.col("z").alias("token"))


@query("a34_compression_quality")
def a34(spark, sf_dir):
    """Bytes, rank-1 and mAP of storage variants, in the standard and strict protocols."""
    q, g = sides(spark, sf_dir)
    base = lambda df: df.select("ord", "frame", "vehicle_id", "camera_id", "emb")
    q, g = base(q), base(g)
    pca = compress.fit_pca(g, 32)
    proj = lambda df: durable(compress.project(df, pca).drop("emb").withColumnRenamed("z", "emb"), "projected")
    pq_, pg_ = proj(q), proj(g)
    scale = compress.int8_scale(pg_, "emb")
    i8 = lambda df: df.withColumn("emb", F.transform(compress.int8_codes(F.col("emb"), scale), lambda x: x.cast("double") * scale))
    sign = lambda df: df.withColumn("emb", F.transform("emb", lambda x: F.when(x > 0, 1.0).otherwise(-1.0)))
    # Sign codes are compared as integers, so that equal Hamming distances are ties.
    sets = {"f32": (q, g, None, True), "pca32_i8": (i8(pq_), i8(pg_), pca.explained, True), "pca32_bin": (sign(pq_), sign(pg_), pca.explained, False)}
    out = []
    for name, (a, b, explained, normalise) in sets.items():
        ap = metrics.both_average_precisions(a, b, normalise)
        first = lambda c: F.avg((F.col(c) <= 1).cast("int").cast("double"))
        both = ap.agg(F.avg("ap").alias("map"), first("first_hit").alias("rank1"), F.avg("ap_cross").alias("map_cross"), first("first_hit_cross").alias("rank1_cross"))
        out.append(both.select(F.lit(name).alias("variant"), F.lit(compress.Variant.parse(name).bytes_per_vector(64)).alias("bytes"),
                               "map", "rank1", "map_cross", "rank1_cross", F.lit(explained).cast("double").alias("explained")))
    return reduce(DataFrame.unionByName, out)


# ---- approximate search ----------------------------------------------------------------------

def cell_shortlist(q: DataFrame, g: DataFrame) -> DataFrame:
    """Top ten from the cells that hold at least 0.9 of the true ten."""
    index = ann.CellIndex(g)
    return index.search(q, 10, probes=index.probes_for(q, 10))


@query("j10_cell_shortlist")
def j10(spark, sf_dir):
    return cell_shortlist(*sides(spark, sf_dir))


@query("j10_index_recall", with_ctes("o q g", "SELECT count(*) AS n_queries, true AS recall_reached, true AS scores_exact FROM q"))
def j10_recall(spark, sf_dir):
    """The search of j10_cell_shortlist against exact search: at least 0.9 of the true ten found, every score the exact one."""
    q, g = sides(spark, sf_dir)
    found = cell_shortlist(q, g).select("q_ord", "g_ord", F.col("sim").alias("found"))
    exact = nearest(q, g, 10).select("q_ord", "g_ord", "sim")
    both = exact.join(found, ["q_ord", "g_ord"], "left")
    return both.agg(F.countDistinct("q_ord").alias("n_queries"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
                    (F.coalesce(F.max(F.abs(F.col("sim") - F.col("found"))), F.lit(0.0)) < 1e-12).alias("scores_exact"))


@query("k8_completed_shortlist", with_ctes("o q g p r", "SELECT q_ord, g_ord, round(sim, 6) AS sim, pos::INTEGER AS pos FROM r WHERE pos <= 10"))
def k8(spark, sf_dir):
    """The approximate pool made exact by adding every row that could still enter."""
    q, g = sides(spark, sf_dir)
    index = ann.CellIndex(g)
    pool = durable(index.search(q, 10, probes=2), "pool")
    return index.complete(q, pool, 10).select("q_ord", "g_ord", r6("sim"), "pos")


@query("u4_lateral_knn", with_ctes("o q g", """
SELECT q_ord, pos::INTEGER AS pos, g_ord, round(s, 6) AS sim FROM (SELECT q.ord AS q_ord, g.ord AS g_ord, list_inner_product(q.emb, g.emb) AS s,
  row_number() OVER (PARTITION BY q.ord ORDER BY list_inner_product(q.emb, g.emb) DESC, g.ord) AS pos FROM q JOIN g ON true) WHERE pos <= 5"""))
def u4(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return knn_lateral(q, g, 5).select("q_ord", "pos", "g_ord", r6("sim"))


@query("u1_embedding_function", """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
v AS (SELECT doc_id, unnest(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::INTEGER % 32)) AS v FROM b),
n AS (SELECT doc_id, v, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT doc_id, coalesce(max(n) FILTER (v = 0), 0) + 1 AS first, sum((n + 1) * (n + 1)) + 32 - count(*) AS square FROM n GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(first, 1) / sqrt(coalesce(square, 32)), 6) AS first_value, 32::INTEGER AS dim FROM documents d LEFT JOIN s USING (doc_id)""")
def u1(spark, sf_dir):
    """A user's function from text to vectors, applied in Arrow batches and validated."""

    def letters(texts: list) -> np.ndarray:
        out = np.zeros((len(texts), 32))
        for i, t in enumerate(texts):
            codes = np.frombuffer((t or "").encode(), dtype=np.uint8)
            out[i] = np.bincount(codes % 32, minlength=32) + 1.0
        return out

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed(d, "text", letters, 32).select("doc_id", F.round(F.element_at("emb", 1), 6).alias("first_value"), F.size("emb").alias("dim"))


# ---- linear maps -----------------------------------------------------------------------------

def fixed_map(shift: int) -> compress.LinearMap:
    i, j = np.meshgrid(np.arange(64), np.arange(4), indexing="ij")
    return compress.LinearMap(np.full(64, 0.01), ((i * (j + 2) + shift) % 7 - 3) / 10.0)


def mapped_sql(shift: int) -> str:
    z = f"list_transform(range(0, 4), lambda j: list_sum(list_transform(e, lambda x, i: (x - 0.01::DOUBLE) * ((((i - 1) * (j + 2) + {shift}) % 7 - 3) / 10))))"
    return f"SELECT ord, vehicle_id, camera_id, list_transform(z, lambda x: x / (sqrt(list_inner_product(z, z)) + 1e-12)) AS z FROM (SELECT o.*, {z} AS z FROM (SELECT vec_id AS ord, label AS vehicle_id, vec_id % 4 AS camera_id, embedding::DOUBLE[] AS e FROM embeddings) o)"


Z = ", ".join(f"round(z[{i}], 6) AS z{i}" for i in range(1, 5))


@query("p5_affine_map", f"SELECT ord, {Z} FROM ({mapped_sql(0)})")
def p5(spark, sf_dir):
    m = compress.project(observations(spark, sf_dir).select("ord", "emb"), fixed_map(0), normalise=True)
    return m.select("ord", *[F.round(F.element_at("z", i), 6).alias(f"z{i}") for i in range(1, 5)])


@query("p6_domain_gated_map", f"""
WITH a AS ({mapped_sql(0)}), b AS ({mapped_sql(3)})
SELECT ord, night, {Z} FROM (SELECT a.ord, 1 / (1 + exp(-(a.z[1] * 8))) >= 0.95 AS night, CASE WHEN 1 / (1 + exp(-(a.z[1] * 8))) >= 0.95 THEN b.z ELSE a.z END AS z FROM a JOIN b ON a.ord = b.ord)""")
def p6(spark, sf_dir):
    """The night map replaces the source map where the domain probability is high enough."""
    base = compress.project(observations(spark, sf_dir).select("ord", "emb"), fixed_map(0), out="z0", normalise=True)
    both = compress.project(base, fixed_map(3), out="zn", normalise=True)
    p = cal.sigmoid(8.0 * F.element_at("z0", 1))
    g = both.withColumn("night", p >= 0.95).withColumn("z", F.when(F.col("night"), F.col("zn")).otherwise(F.col("z0")))
    return g.select("ord", "night", *[F.round(F.element_at("z", i), 6).alias(f"z{i}") for i in range(1, 5)])


@query("r17_gallery_adaptation")
def r17(spark, sf_dir):
    """Top five after centring and flattening the gallery's spectrum, the same map on queries."""
    q, g = sides(spark, sf_dir)
    m = compress.gallery_adaptation(g, 0.5, 0.25)
    adapt = lambda df: compress.project(df, m, normalise=True).drop("emb").withColumnRenamed("z", "emb")
    return nearest(adapt(q), adapt(g), 5).select("q_ord", "g_ord", "sim", "pos")


@query("d5_pseudo_cameras")
def d5(spark, sf_dir):
    frames = observations(spark, sf_dir).select("ord", (F.col("ord") % 3).alias("resolution"), "emb")
    return splits.pseudo_cameras(frames, 0.7)


@query("r16_patch_pair_descriptors")
def r16(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    pairs = patches.with_tokens(nearest(q, g, 3).select("q_ord", "g_ord", "pos"), patches.token_table(q, 16, 4), patches.token_table(g, 16, 4))
    return patches.pair_descriptors(pairs, 4)


@query("r6_current_query_insertion")
def r6_insertion(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    return insertion.current_query_ranking(q, g, 10, graph.build_graph(g, 3, 2), 0.2)


@query("r18_fusion_with_insertion")
def r18_insertion(spark, sf_dir):
    """Three quarters of the two-branch ranking and one quarter of the insertion ranking of the joint space."""
    return two_space_rank(*sides(spark, sf_dir), insertion_weight=0.25)


# ---- streaming -------------------------------------------------------------------------------

@query("t1_query_stream", with_ctes("o q g p r", f"""
SELECT q_key, pos::INTEGER AS pos, g_key, round(sim, 6) AS sim, max(CASE WHEN pos = 1 THEN sim END) OVER (PARTITION BY q_ord) >= {THRESHOLD} AS accepted FROM r WHERE pos <= 5"""))
def t1(spark, sf_dir):
    q, g = sides(spark, sf_dir)
    source, out = scratch_path(spark, "queries"), scratch_path(spark, "results")
    q.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 2).parquet(source)
    search_stream(stream, durable(g, "snapshot"), out, scratch_path(spark, "checkpoint"), 5, THRESHOLD).awaitTermination()
    return spark.read.option("basePath", out).parquet(out).select("q_key", "pos", "g_key", r6("sim"), "accepted")


@query("t2_incremental_ingest", with_ctes("o g", "SELECT replace(key, '#', '-') AS image_id, x, w FROM g"))
def t2(spark, sf_dir):
    """Two overlapping files arrive; every id is stored once."""
    g = items(gallery_side(spark, sf_dir))
    source = scratch_path(spark, "arrivals")
    g.filter("ord % 3 <> 0").coalesce(1).write.parquet(source)
    g.filter("ord % 3 <> 1").coalesce(1).write.mode("append").parquet(source)
    store = GalleryStore(spark, scratch_path(spark, "store"), 64)
    stream = spark.readStream.schema(g.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ingest.ingest_stream(stream, store, scratch_path(spark, "checkpoint")).awaitTermination()
    return store.snapshot().select("image_id", "x", "w")


@query("t3_generation_switch", with_ctes("o g", "SELECT 'first' AS step, count(*) AS n, 1 AS registrations, 0 AS hits FROM g UNION ALL SELECT 'again', count(*), 1, 1 FROM g UNION ALL SELECT 'smaller', count(*), 2, 1 FROM g WHERE ord % 9 <> 1"))
def t3(spark, sf_dir):
    g = gallery_side(spark, sf_dir)
    gen, out = ingest.Generations(), []
    for step, df in (("first", g), ("again", g.repartition(3)), ("smaller", g.filter("ord % 9 <> 1"))):
        gen.register(df)
        out.append(gen.gallery.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(step).alias("step"), "n", F.lit(gen.registrations).alias("registrations"), F.lit(gen.hits).alias("hits")))
    return reduce(DataFrame.unionByName, out)


@query("t4_delete_propagation", with_ctes("o g", "SELECT (SELECT count(*) FROM g) - 1 AS n, 0::BIGINT AS edges_left FROM (SELECT 1)"))
def t4(spark, sf_dir):
    """After a delete neither the snapshot nor the graph mentions the row."""
    g = gallery_side(spark, sf_dir)
    first = g.agg(F.min_by("key", "ord").alias("k"), F.min("ord").alias("o")).first()
    gen = ingest.Generations()
    gen.register(g)
    gen.delete(first["k"])
    left = gen.graph.nn.filter((F.col("i") == first["o"]) | (F.col("j") == first["o"])).agg(F.count(F.lit(1)).alias("n")).scalar()
    return gen.gallery.agg(F.count(F.lit(1)).alias("n"), left.alias("edges_left"))


def kept_graph(spark, sf_dir) -> ingest.Generations:
    """The gallery's graph after an insert of every ninth observation, a changed seventh and the delete of the first."""
    g = gallery_side(spark, sf_dir)
    gen = ingest.Generations()
    gen.register(durable(g.filter("ord % 9 <> 1").withColumn("emb", F.when(F.col("ord") % 7 == 2, F.reverse("emb")).otherwise(F.col("emb"))), "gallery"))
    gen.insert(g.filter("ord % 9 = 1"))
    gen.register(g)
    gen.delete(g.agg(F.min_by("key", "ord")).first()[0])
    return gen


REST = "SELECT * FROM g WHERE ord <> (SELECT min(ord) FROM g)"


@query("t3_updated_graph", with_ctes("o g", """
SELECT 'before' AS kind, i, j, round(w, 6) AS w FROM bf UNION ALL SELECT 'after', i, j, round(w, 6) FROM af""", gx=REST, **graph_ctes(3, 2, src="gx")))
def t3_graph(spark, sf_dir):
    """Brought up to date three times; the SQL builds the graph of the final gallery as a whole."""
    gr = kept_graph(spark, sf_dir).graph
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "i", "j", r6("w"))
    return tag(gr.before, "before").union(tag(gr.after, "after"))


@query("t4_changed_lists", with_ctes("o g", """
SELECT 1::BIGINT AS builds, 4::BIGINT AS registrations, count(DISTINCT i) AS lists FROM nn WHERE j = (SELECT min(ord) FROM g) AND i <> j""", **graph_ctes(3, 2)))
def t4_lists(spark, sf_dir):
    """Lists computed for the delete: those that held the row. The graph is built as a whole only once."""
    gen = kept_graph(spark, sf_dir)
    return spark.createDataFrame([(gen.builds, gen.registrations, gen.touched.lists)], "builds long, registrations long, lists long")


def log(df: DataFrame) -> DataFrame:
    return df.select("ts", F.col("event_type").alias("phase"), F.col("value").alias("duration_ms"), (F.col("value") > 250).alias("failed"))


@query("t5_operation_log_summary", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS phase, count(*) AS n, round(avg((value > 250)::INT), 6) AS error_rate,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL""")
def t5(spark, sf_dir):
    s = oplog.summarise(log(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))))
    return s.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "phase", "n", r6("error_rate"), r6("p50"), r6("p95"))


@query("t5_operation_log_stream", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS phase, count(*) AS n, round(avg((value > 250)::INT), 6) AS error_rate FROM events GROUP BY ALL""")
def t5_stream(spark, sf_dir):
    """The same counts from the streaming form, in complete mode."""
    events = table(spark, sf_dir, "events")
    source = scratch_path(spark, "log")
    log(events.withColumn("ts", F.col("ts").cast("timestamp"))).repartition(2).write.parquet(source)
    out = scratch_path(spark, "summary")
    stream = spark.readStream.schema("ts timestamp, phase string, duration_ms double, failed boolean").parquet(source)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    oplog.summarise_stream(stream).writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "phase", "n", r6("error_rate"))
