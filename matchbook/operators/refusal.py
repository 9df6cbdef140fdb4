"""Accept/refuse curves, thresholds and confidence measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.functions.vectors import finite
from matchbook.operators.ranks import quantile_rows, running

#: Weights of the refusal score.
W_F1, W_TNR = 0.7, 0.3


def accepts(conf: Column, threshold) -> Column:
    """NaN and infinities refuse; the comparison alone would accept NaN."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(finite(conf) & (conf >= t), F.lit(False))


def score_columns(df: DataFrame) -> DataFrame:
    """Add precision, recall, f1, tnr and score to tp, fp, fn, tn.

    Without rows that have no match there is no tnr (null); the score then takes it as 0.
    """
    c = F.col
    precision = c("tp") / F.greatest(c("tp") + c("fp"), F.lit(1))
    recall = c("tp") / F.greatest(c("tp") + c("fn"), F.lit(1))
    return (
        df.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", 2.0 * c("precision") * c("recall") / F.greatest(c("precision") + c("recall"), F.lit(1e-12)))
        .withColumn("tnr", F.when(c("tn") + c("fp_absent") > 0, c("tn") / (c("tn") + c("fp_absent"))))
        .withColumn("score", 100.0 * (W_F1 * c("f1") + W_TNR * F.coalesce(c("tnr"), F.lit(0.0))))
    )


def confusion(df: DataFrame, accepted: Column, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and the derived rates; needs boolean ``has_match`` and ``correct``."""
    has, ok = F.col("has_match"), F.col("correct")
    n = lambda cond: F.sum(cond.cast("long"))
    out = df.withColumn("_a", accepted).groupBy(*keys).agg(
        n(F.col("_a") & has & ok).alias("tp"),
        n(F.col("_a") & ~(has & ok)).alias("fp"),
        n(~F.col("_a") & has).alias("fn"),
        n(~F.col("_a") & ~has).alias("tn"),
        n(F.col("_a") & ~has).alias("fp_absent"),
        F.avg(F.col("_a").cast("int").cast("double")).alias("accept_rate"),
    )
    return score_columns(out).drop("fp_absent")


def _from_totals(c: dict[str, Column], *keep) -> list[Column]:
    acc, ok, has, n, n_has = c["acc"], c["acc_ok"], c["acc_has"], c["n"], c["n_has"]
    return [
        *keep,
        ok.cast("long").alias("tp"),
        (acc - ok).cast("long").alias("fp"),
        (n_has - has).cast("long").alias("fn"),
        (n - n_has - (acc - has)).cast("long").alias("tn"),
        (acc - has).cast("long").alias("fp_absent"),
        (acc / n).alias("accept_rate"),
    ]


def _flags(df: DataFrame, conf: str) -> DataFrame:
    has, ok = F.col("has_match"), F.col("correct")
    return df.withColumn("_ok", (has & ok).cast("long")).withColumn("_has", has.cast("long"))


def sweep(df: DataFrame, thresholds: DataFrame, keys: Sequence[str] = (), conf: str = "conf") -> DataFrame:
    """Confusion at every threshold of a grid.

    ``thresholds`` has the keys and ``ths``, an ascending array of distinct values. Each
    row is placed in its bin once; suffix sums over the bins give all thresholds.
    """
    keys = list(keys)
    rows = _flags(df, conf)
    rows = rows.join(thresholds, keys) if keys else rows.withColumn("ths", thresholds.select("ths").scalar())
    placed = F.when(finite(F.col(conf)), F.size(F.filter("ths", lambda t: t <= F.col(conf)))).otherwise(F.lit(0))
    bins = rows.groupBy(*keys, placed.alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_ok").alias("_ok"), F.sum("_has").alias("_has")
    )
    part = keys or [F.lit(0)]
    whole = Window.partitionBy(*part)
    grid = thresholds.select(*keys, F.posexplode("ths").alias("_i", "threshold")).withColumn("bin", F.col("_i") + 1)
    zero = thresholds.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0).alias("bin"))
    every = grid.select(*keys, "threshold", "bin").unionByName(zero)
    joined = every.join(bins, [*keys, "bin"], "left").fillna(0, ["_n", "_ok", "_has"])
    tail = Window.partitionBy(*part).orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    c = {
        "acc": F.sum("_n").over(tail), "acc_ok": F.sum("_ok").over(tail), "acc_has": F.sum("_has").over(tail),
        "n": F.sum("_n").over(whole), "n_has": F.sum("_has").over(whole),
    }
    out = joined.select(*_from_totals(c, *keys, "threshold")).filter(F.col("threshold").isNotNull())
    return score_columns(out).drop("fp_absent")


def sweep_all_values(df: DataFrame, conf: str = "conf") -> DataFrame:
    """Confusion with every occurring finite confidence as the threshold (any number of them).

    Rows without a finite confidence are refused at every threshold: they come last, below all.
    """
    rows = _flags(df, conf).withColumn(conf, F.when(finite(F.col(conf)), F.col(conf)).otherwise(F.lit(float("-inf"))))
    by_value = rows.groupBy(F.col(conf).alias("threshold")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_ok").alias("_ok"), F.sum("_has").alias("_has")
    ).withColumn("_tie", F.lit(0).cast("long"))
    r = running(by_value, "threshold", "_tie", descending=True, sums=["_n", "_ok", "_has"])
    c = {"acc": F.col("run__n"), "acc_ok": F.col("run__ok"), "acc_has": F.col("run__has"),
         "n": F.col("total__n"), "n_has": F.col("total__has")}
    return score_columns(r.filter(F.col("threshold") > float("-inf")).select(*_from_totals(c, "threshold"))).drop("fp_absent")


def quantile_grid(df: DataFrame, points: int, keys: Sequence[str] = (), conf: str = "conf") -> DataFrame:
    """Distinct quantiles at evenly spaced probabilities, as the array ``ths``."""
    rows = quantile_rows(df.filter(finite(F.col(conf))), conf, [i / (points - 1) for i in range(points)], keys)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set("x")).alias("ths"))


def best(curve: DataFrame, keys: Sequence[str] = (), score: str = "score", min_tnr: float | None = None) -> DataFrame:
    """The row with the highest score; among equals the lowest threshold.

    With ``min_tnr`` only rows reaching it compete, unless there are none.
    """
    row = F.struct(*[c for c in curve.columns if c not in keys])
    order = F.struct(F.col(score), -F.col("threshold"))
    pick = F.max_by(row, order)
    if min_tnr is not None:
        pick = F.coalesce(F.max_by(F.when(F.col("tnr") >= min_tnr, row), F.when(F.col("tnr") >= min_tnr, order)), pick)
    return curve.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def pr_auc(df: DataFrame, conf: str = "conf", tie: str = "q_ord", keys: Sequence[str] = ()) -> DataFrame:
    """Step integral of precision over recall; equal confidences keep query order."""
    keys = list(keys)
    rows = df.select(*keys, F.col(conf).alias("_c"), F.col(tie).alias("_t"),
                     (F.col("has_match") & F.col("correct")).cast("long").alias("pos"))
    r = running(rows, "_c", "_t", keys, descending=True, sums=["pos"])
    step = F.when(F.col("pos") == 1, (F.col("run_pos") / F.col("rank")) / F.col("total_pos"))
    return r.groupBy(*keys).agg(F.sum(step).alias("pr_auc"))


def measures(top: DataFrame, width: int = 10) -> DataFrame:
    """Confidence measures of each query from its ranked scores (``q_ord, pos, sim``).

    top1, margin to the second (a missing second counts as -1), gap to the mean of
    the rest, and ratio to the second.
    """
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col("sim")))
    return (
        top.filter(F.col("pos") <= width)
        .groupBy("q_ord")
        .agg(
            at(1).alias("top1"),
            F.coalesce(at(2), F.lit(-1.0)).alias("_second"),
            F.avg(F.when(F.col("pos") > 1, F.col("sim"))).alias("_rest"),
        )
        .select(
            "q_ord",
            "top1",
            (F.col("top1") - F.col("_second")).alias("margin"),
            (F.col("top1") - F.col("_rest")).alias("gap_to_rest"),
            (F.col("top1") / F.when(F.abs("_second") < 1e-6, F.lit(1e-6)).otherwise(F.col("_second"))).alias("ratio"),
        )
    )


def bits(n_candidates: Column, n_gallery: Column) -> Column:
    """Information of a candidate count, in bits."""
    return -F.log2(F.greatest(n_candidates, F.lit(1)) / n_gallery)
