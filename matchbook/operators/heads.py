"""Trained heads on feature tables, scored out of fold by identity.

A head is a Spark ML estimator on a vector column. Three families are named: logistic, boosted
trees, and extra trees, whose nodes choose among randomly drawn cut points. Folds hold whole
identities, so no identity is scored by a head that has seen it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.functions.text import seeded_order
from matchbook.operators.ranks import running
from matchbook.session import durable

#: Random cut points of a feature that all trees of one extra-trees head draw from.
CUTS = 32


def group_folds(group: Column, folds: int, seed: int = 0) -> Column:
    """Fold of an identity, from 0: the same for all its rows, in every engine. Null is an identity."""
    return (seeded_order(seed, F.coalesce(group.cast("string"), F.lit("none"))) % folds).cast("int")


def logistic(rows: DataFrame, inputs: Sequence[str]) -> Estimator:
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="features"), LogisticRegression(maxIter=20, regParam=0.01)])


def boosted(rows: DataFrame, inputs: Sequence[str], rounds: int = 20, depth: int = 3, seed: int = 7) -> Estimator:
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="features"), GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)])


def cut_points(rows: DataFrame, inputs: Sequence[str], cuts: int = CUTS, seed: int = 7) -> dict[str, list[float]]:
    """Per feature, cut points drawn evenly between its least and largest value in ``rows``."""
    ends = rows.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(inputs) for n, f in (("a", F.min), ("b", F.max))]).first()
    rng = np.random.default_rng(seed)
    return {c: sorted((ends[f"a_{i}"] + (ends[f"b_{i}"] - ends[f"a_{i}"]) * rng.random(cuts)).tolist()) if ends[f"a_{i}"] is not None else [0.0]
            for i, c in enumerate(inputs)}


def extra_trees(rows: DataFrame, inputs: Sequence[str], trees: int = 40, depth: int = 7, cuts: int = CUTS, seed: int = 7) -> Estimator:
    """Trees grown on all rows, whose nodes see a random subset of (feature, random cut) pairs and take the best.

    Each pair is an indicator column, so the forest's own choice of a feature is the choice of a cut.
    """
    drawn = cut_points(rows, inputs, cuts, seed)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", bootstrap=False, seed=seed)
    return _Sides(drawn, forest)


class _Sides(Estimator):
    """Fits a forest on the indicators of the cut points."""

    def __init__(self, drawn: dict[str, list[float]], forest: RandomForestClassifier):
        super().__init__()
        self.drawn, self.forest = drawn, forest

    def indicators(self, df: DataFrame) -> DataFrame:
        above = lambda x, at: F.transform(F.array(*map(F.lit, at)), lambda c: (x > c).cast("double"))
        sides = [above(F.col(name), at) for name, at in self.drawn.items()]
        return df.withColumn("features", array_to_vector(F.concat(*sides)))

    def _fit(self, dataset: DataFrame):
        model, sides = self.forest.fit(self.indicators(dataset)), self.indicators

        class Fitted:
            def transform(self, df: DataFrame) -> DataFrame:
                return model.transform(sides(df))

        return Fitted()


HEADS: dict[str, Callable[[DataFrame, Sequence[str]], Estimator]] = {"logistic": logistic, "boosted": boosted, "extra": extra_trees}


def cross_fit(df: DataFrame, inputs: Sequence[str], group: str, keys: Sequence[str], heads: dict[str, Callable] | None = None, folds: int = 5, seed: int = 0) -> DataFrame:
    """``keys``, fold, label and out-of-fold ``p_<head>`` of every row of ``df`` (inputs, label 0/1, group).

    A fold whose training rows have one label only is scored by that label's share. Rows with a
    null feature or label are an error of the caller.
    """
    data = durable(df.select(*keys, *inputs, F.col("label").cast("double").alias("label"), group_folds(F.col(group), folds, seed).alias("fold")), "training")
    found = {r.fold: (r.n, r.positive) for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive")).collect()}
    out = []
    for fold in sorted(found):
        fit, held = data.filter(F.col("fold") != fold), data.filter(F.col("fold") == fold)
        n, positive = (sum(v[i] for k, v in found.items() if k != fold) for i in (0, 1))
        scored = held
        for name, head in (heads or HEADS).items():
            if 0 < positive < n:
                model = head(fit, inputs).fit(fit)
                scored = model.transform(scored).withColumn("p_" + name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
            else:
                scored = scored.withColumn("p_" + name, F.lit(float(positive / n) if n else 0.0))
        out.append(scored.select(*keys, "fold", "label", *[f"p_{name}" for name in (heads or HEADS)]))
    return reduce(DataFrame.unionByName, out)


def auc(scored: DataFrame, score: str) -> DataFrame:
    """One row ``auc``: the share of (positive, negative) pairs in order, ties half; null without both labels."""
    per = scored.groupBy(F.col(score).alias("s")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    parts = running(per.withColumn("tie", F.lit(0).cast("long")), "s", "tie", sums=["neg"]).select("pos", "neg", (F.col("run_neg") - F.col("neg")).alias("under"))
    return parts.agg((F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)) / F.when(F.sum("pos") * F.sum("neg") > 0, F.sum("pos") * F.sum("neg"))).alias("auc"))
