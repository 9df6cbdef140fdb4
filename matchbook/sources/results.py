"""Result tables: rankings, candidates, embeddings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchbook.functions.vectors import all_finite, finite, norm
from matchbook.operators.refusal import accepts


def ranking_table(top: DataFrame, k: int) -> DataFrame:
    """Exactly k distinct gallery keys per query, one column each; anything else fails."""
    lists = top.filter((F.col("pos") <= k) & finite(F.col("sim"))).groupBy("q_ord", "q_key").agg(
        F.array_sort(F.collect_list(F.struct("pos", "g_key"))).alias("_l")).withColumn("_g", F.col("_l.g_key"))
    whole = F.size(F.array_distinct("_g")) == k
    checked = F.when(whole, F.col("_g")).otherwise(
        F.raise_error(F.concat(F.lit("not enough distinct candidates for "), F.col("q_key"))).cast("array<string>"))
    rows = lists.withColumn("_g", checked)
    return rows.select("q_ord", F.col("q_key").alias("query_id"), *[F.element_at("_g", i + 1).alias(f"g{i + 1}") for i in range(k)])


def write_ranking(table: DataFrame, path: str) -> None:
    """Headerless CSV, sorted by query order across the files."""
    cols = [c for c in table.columns if c != "q_ord"]
    table.repartitionByRange("q_ord").sortWithinPartitions("q_ord").select(*cols).write.csv(path, header=False)


def read_ranking(spark: SparkSession, path: str, k: int = 10) -> DataFrame:
    """Ranking file as ``query_id, pos, gallery_id``; an old header row is skipped, a wrong width fails."""
    cells = spark.read.text(path).select(F.split("value", ",", -1).alias("c")).filter(F.element_at("c", 1) != "query_id")
    ok = F.when(F.size("c") == k + 1, F.col("c")).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of cells for "), F.element_at("c", 1))).cast("array<string>"))
    return cells.withColumn("c", ok).select(
        F.element_at("c", 1).alias("query_id"), F.posexplode(F.slice("c", 2, k)).alias("_p", "gallery_id")
    ).select("query_id", (F.col("_p") + 1).alias("pos"), "gallery_id")


def candidates(top: DataFrame, threshold: float, k: int = 1, min_sim: float | None = None, score: str = "sim",
               exclude_self: bool = True) -> DataFrame:
    """Accepted candidates: ``query_id, gallery_id, confidence``; a refusal leaves no row.

    The decision uses the cosine of the first candidate that would be written; a value
    that is not finite refuses, and is never written.
    """
    rows = top.filter(F.col("q_key") != F.col("g_key")) if exclude_self else top
    if min_sim is not None:
        rows = rows.filter(~(F.col(score) < min_sim))
    per_query = Window.partitionBy("q_ord")
    # The deciding candidate is the first eligible one, finite or not.
    first = F.min_by(score, "pos").over(per_query)
    kept = rows.withColumn("_decide", first).filter(accepts(F.col("_decide"), threshold)).filter(finite(F.col(score)))
    at = F.row_number().over(per_query.orderBy("pos"))
    return kept.withColumn("_at", at).filter(F.col("_at") <= k).select(
        F.col("q_ord"), F.col("q_key").alias("query_id"), F.col("g_key").alias("gallery_id"), F.round(score, 5).alias("confidence"))


def refusal_counts(top: DataFrame, written: DataFrame, score: str = "sim") -> DataFrame:
    """Queries in total, refused, and values that were not finite."""
    per = top.groupBy("q_ord").agg(F.sum((~finite(F.col(score))).cast("long")).alias("bad"))
    hit = written.select("q_ord").distinct().withColumn("_w", F.lit(1))
    return per.join(hit, "q_ord", "left").agg(
        F.count(F.lit(1)).alias("n_query"), F.sum(F.col("_w").isNull().cast("long")).alias("n_refused"), F.sum("bad").alias("n_nonfinite"))


def write_candidates(rows: DataFrame, path: str) -> None:
    rows.select("query_id", "gallery_id", F.format_string("%.5f", "confidence").alias("confidence")).write.csv(path, header=True)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate file; the header must be exactly the three expected columns."""
    return spark.read.csv(path, schema="query_id string, gallery_id string, confidence double", header=True, enforceSchema=False, mode="FAILFAST")


def embedding_export(q: DataFrame, g: DataFrame) -> DataFrame:
    """Query rows then gallery rows, each in its order; unusable vectors fail."""
    both = q.select(F.lit(0).alias("side"), "ord", "key", "emb").unionByName(g.select(F.lit(1).alias("side"), "ord", "key", "emb"))
    e = F.col("emb").cast("array<double>")
    ok = (F.size("emb") > 0) & all_finite(e) & (norm(e) > 1e-8)
    return both.withColumn("emb", F.when(ok, F.col("emb")).otherwise(
        F.raise_error(F.concat(F.lit("unusable vector of "), F.col("key"))).cast("array<float>")))


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric rows (name, value) as JSON; a value that is not a number fails."""
    v = F.when(finite(F.col("value")), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("not a number: "), F.col("name"))).cast("double"))
    metrics.withColumn("value", v).write.json(path)
