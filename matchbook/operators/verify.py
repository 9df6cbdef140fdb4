"""Checks of result sets and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions.vectors import all_finite, dot, finite, norm

#: The parts of report lines that change from run to run.
VOLATILE = (
    r"\d+[.,]\d+\s*(?:мс|ms|c\)|с\)|s\))"
    r"|\d+[.,]\d+\s*batch/s"
    r"|\d+:\d\d(?:<|,|\])"
    r"|\([\d.,]+\s*(?:c|с|s)\)"
)
DROPPED_LINES = ("it/s", "batch/s", "%|", "Warning", "warning", "/кроп всего", "чтение кадров")


def result_problems(queries: DataFrame, gallery: DataFrame, ranking: DataFrame, candidates: DataFrame,
                    embeddings: DataFrame, k: int = 10, dimension: int | None = None) -> DataFrame:
    """One row per rule: ``rule, severity, violations``.

    queries and gallery have ``id``; ranking ``query_id, pos, gallery_id``; candidates
    ``query_id, gallery_id, confidence``; embeddings ``id, emb``.
    """
    g = gallery.select(F.col("id").alias("gallery_id")).distinct().withColumn("_g", F.lit(1))
    q = queries.select(F.col("id").alias("query_id")).distinct().withColumn("_q", F.lit(1))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))

    lists = ranking.join(g, "gallery_id", "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("gallery_id").alias("_d"), F.sum(F.col("_g").isNull().cast("long")).alias("_u"))
    r = q.join(lists, "query_id", "full_outer").agg(
        n(F.col("_n").isNull()).alias("ranking_missing_query"), n(F.col("_q").isNull()).alias("ranking_unknown_query"),
        n(F.col("_n") != k).alias("ranking_wrong_length"), n(F.col("_u") > 0).alias("ranking_unknown_gallery"),
        n(F.col("_d") < F.col("_n")).alias("ranking_repeated_gallery"))

    c = candidates.join(q, "query_id", "left").join(g, "gallery_id", "left").groupBy("query_id", "gallery_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_q").alias("_q"), F.max("_g").alias("_g"), F.max((~finite(F.col("confidence"))).cast("int")).alias("_bad"))
    cc = c.agg(
        n(F.col("_q").isNull() | F.col("_g").isNull()).alias("candidate_unknown_id"), n(F.col("_bad") == 1).alias("candidate_not_finite"),
        n(F.col("_n") > 1).alias("candidate_repeated_pair"))
    per_query = c.groupBy("query_id").agg(F.count(F.lit(1)).alias("_m"))
    answered = q.join(per_query, "query_id", "left").agg(
        n(F.col("_m") > 1).alias("several_rows_per_query"), F.count("_m").alias("_answered"), F.count(F.lit(1)).alias("_all"))
    answered = answered.select(
        "several_rows_per_query", (F.col("_answered") == F.col("_all")).cast("long").alias("nothing_refused"),
        (F.col("_answered") == 0).cast("long").alias("everything_refused"))

    e = embeddings.withColumn("_e", F.col("emb").cast("array<double>"))
    # Without a given dimension the commonest one is expected.
    size = F.lit(dimension) if dimension else embeddings.agg(F.mode(F.size("emb"))).scalar()
    ee = e.agg(
        n(~all_finite(F.col("_e"))).alias("embedding_not_finite"), n(norm(F.col("_e")) <= 1e-8).alias("embedding_zero"),
        n(F.size("emb") != size).alias("embedding_wrong_dimension"), n(F.abs(norm(F.col("_e")) - 1.0) > 0.01).alias("embedding_not_unit"))
    ids = queries.select("id").union(gallery.select("id"))
    missing = ids.join(embeddings.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("embedding_missing"))

    warnings = {"several_rows_per_query", "nothing_refused", "everything_refused", "embedding_not_unit", "ranking_repeated_gallery"}
    parts = [x.unpivot([], x.columns, "rule", "violations") for x in (r, cc, answered, ee, missing)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("rule", F.when(F.col("rule").isin(*warnings), "warning").otherwise("error").alias("severity"),
                       F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def compare_runs(a_rank: DataFrame, b_rank: DataFrame, a_cand: DataFrame, b_cand: DataFrame, a_emb: DataFrame, b_emb: DataFrame) -> DataFrame:
    """Differences of two result sets as ``measure, value``."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long")).cast("double")
    tag = lambda df, p, cols: df.select(*cols, F.lit(1).alias("_" + p))
    acc = tag(a_cand.select("query_id").distinct(), "a", ["query_id"]).join(tag(b_cand.select("query_id").distinct(), "b", ["query_id"]), "query_id", "full_outer").agg(
        n(F.col("_a").isNull() | F.col("_b").isNull()).alias("accepted_differ"))
    pairs = a_cand.withColumnRenamed("confidence", "ca").join(b_cand.withColumnRenamed("confidence", "cb"), ["query_id", "gallery_id"], "full_outer").agg(
        n(F.col("ca").isNotNull() & F.col("cb").isNotNull()).alias("pairs_common"), n(F.col("ca").isNull() | F.col("cb").isNull()).alias("pairs_differ"),
        F.coalesce(F.max(F.abs(F.col("ca") - F.col("cb"))), F.lit(0.0)).alias("confidence_max_difference"))
    cells = a_rank.withColumnRenamed("gallery_id", "ga").join(b_rank.withColumnRenamed("gallery_id", "gb"), ["query_id", "pos"], "full_outer").agg(
        n((F.col("pos") == 1) & (F.col("ga") == F.col("gb"))).alias("top1_same"), n(~F.col("ga").eqNullSafe(F.col("gb"))).alias("cells_differ"))
    va, vb = F.col("va").cast("array<double>"), F.col("vb").cast("array<double>")
    emb = a_emb.withColumnRenamed("emb", "va").join(b_emb.withColumnRenamed("emb", "vb"), "id").agg(
        F.min(dot(va, vb) / (norm(va) * norm(vb) + 1e-12)).alias("min_cosine"))
    return reduce(DataFrame.unionByName, [x.unpivot([], x.columns, "measure", "value") for x in (acc, pairs, cells, emb)])


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free digest of a table: row count, xor and sum of row hashes.

    Every value goes in with its length, a null as ``n``, so rows differ as texts if they differ
    at all; the sum tells apart tables in which equal rows cancel each other in the xor.
    """
    value = lambda c: F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("n"))
    digest = F.md5(F.concat(*[value(F.col(c).cast("string")) for c in columns]))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 16, 8), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("digest"), F.sum(low).alias("total"))


def inventory(files: DataFrame, budget: int) -> DataFrame:
    """Total bytes of listed files (``path, length``) against a budget; more than that fails."""
    t = files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("total_bytes"))
    ok = F.when(F.col("total_bytes") <= budget, F.col("total_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("files exceed the budget: "), F.col("total_bytes").cast("string"))).cast("long"))
    return t.withColumn("total_bytes", ok)


def scrub(lines: DataFrame, column: str = "line") -> DataFrame:
    """Report lines without their volatile parts; lines that are all noise, or empty, leave."""
    c = F.col(column)
    noise = c.contains("\r")
    for word in DROPPED_LINES:
        noise = noise | c.contains(word)
    clean = F.regexp_replace(F.regexp_replace(c, VOLATILE, "<t>"), r"\s+$", "")
    return lines.filter(~noise).withColumn(column, clean).filter(F.col(column) != "")
