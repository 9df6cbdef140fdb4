"""Distributed ranks, running sums and quantiles against NumPy."""

import numpy as np

from matchbook.operators import ranks


def table(spark, values, keys=None):
    data = [(i, float(v), int(keys[i]) if keys is not None else 0, i % 3) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "ord long, v double, k int, s int")


def test_rank_and_running_sum_with_a_heavy_value(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=700), 2)
    v[rng.random(700) < 0.4] = 0.25
    got = ranks.running(table(spark, v), "v", "ord", descending=True, sums=["s"]).collect()
    order = np.lexsort((np.arange(700), -v))
    rank = np.empty(700, dtype=int)
    rank[order] = np.arange(1, 701)
    cum = np.cumsum((np.arange(700) % 3)[order])
    assert all(r["rank"] == rank[r.ord] and r.run_s == cum[rank[r.ord] - 1] and r.total == 700 for r in got)


def test_rank_within_a_hot_key(spark):
    rng = np.random.default_rng(1)
    v, k = rng.normal(size=600), np.where(np.arange(600) % 3 == 0, 7, np.arange(600) % 11)
    got = ranks.running(table(spark, v, k), "v", "ord", keys=["k"]).collect()
    for key in set(k.tolist()):
        mine = np.flatnonzero(k == key)
        want = {int(o): i + 1 for i, o in enumerate(mine[np.argsort(v[mine], kind="stable")])}
        assert {r.ord: r["rank"] for r in got if r.k == key} == want


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=501)
    v[:200] = 1.5
    row = ranks.quantiles(table(spark, v), "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95, "top": 1.0}).first()
    np.testing.assert_allclose([row.lo, row.mid, row.hi, row.top], np.quantile(v, [0.05, 0.5, 0.95, 1.0]), atol=1e-12)
    assert row.n == 501
