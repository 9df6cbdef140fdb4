"""Heads scored out of fold by identity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbook.operators import heads


@pytest.fixture(scope="module")
def table(spark):
    """Labels that need two features at once (no line separates them), spread over 60 identities."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(1500) < 0.05)).astype(float)
    who = rng.integers(0, 60, 1500)
    luck = rng.integers(0, 2, 60)[who].astype(float)  # a label that the identity alone decides
    rows = [(i, int(w), *map(float, v), float(a), float(b), float(w)) for i, (w, v, a, b) in enumerate(zip(who, x, y, luck))]
    return spark.createDataFrame(rows, "id long, who long, a double, b double, c double, label double, luck double, tell double").cache()


def test_trees_beat_the_logistic_head_out_of_fold(table):
    out = heads.cross_fit(table, ["a", "b", "c"], "who", ["id"], folds=3).cache()
    assert out.count() == 1500 and out.select("id").distinct().count() == 1500
    seen = table.select("id", "who").join(out, "id").groupBy("who").agg(F.countDistinct("fold").alias("n"))
    assert seen.agg(F.max("n")).first()[0] == 1
    score = {h: heads.auc(out, f"p_{h}").first()["auc"] for h in heads.HEADS}
    assert score["boosted"] > 0.85 and score["extra"] > 0.8 and score["logistic"] < 0.65, score
    pos, neg = (np.array([r.p_boosted for r in out.filter(F.col("label") == v).collect()]) for v in (1, 0))
    assert abs(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2) - score["boosted"]) < 1e-9


def test_what_only_the_identity_tells_is_not_learnt(table):
    data = table.withColumn("label", F.col("luck"))
    fair = heads.cross_fit(data, ["tell", "a"], "who", ["id"], {"extra": heads.extra_trees}, folds=3)
    mixed = heads.cross_fit(data, ["tell", "a"], "id", ["id"], {"extra": heads.extra_trees}, folds=3)
    assert heads.auc(mixed, "p_extra").first()["auc"] > heads.auc(fair, "p_extra").first()["auc"] + 0.2


def test_one_label_and_cut_points(table):
    alone = heads.cross_fit(table.withColumn("label", F.lit(1.0)), ["a"], "who", ["id"], {"logistic": heads.logistic}, folds=2)
    assert {r.p_logistic for r in alone.collect()} == {1.0} and heads.auc(alone, "p_logistic").first()["auc"] is None
    cuts = heads.cut_points(table, ["a", "b"], 8)
    low, high = table.agg(F.min("a"), F.max("a")).first()
    assert len(cuts["a"]) == 8 and all(low <= c <= high for c in cuts["a"]) and cuts["a"] != cuts["b"]
