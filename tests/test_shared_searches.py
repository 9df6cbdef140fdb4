"""Queries that use one search several times make it once."""

import numpy as np
import pyarrow as pa
import pytest

from __spark_entry__ import queries
from matchbook.operators import features, graph, metrics, similarity
from matchbook.plans import deciding, reranking


def test_two_space_features_search_each_gallery_once_for_its_density(spark, monkeypatch):
    # The density of the second space was once computed for its features and again for the chosen candidate.
    seen = []
    monkeypatch.setattr(features, "density", lambda g, f=features.density: seen.append(g) or f(g))
    queries()["f2_two_space_features"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2


def test_compression_quality_passes_the_gallery_once_per_variant(spark, monkeypatch):
    # Both protocols were once ranked apart: six passes over the gallery for three variants.
    seen = []
    monkeypatch.setattr(metrics, "streamed", lambda *a, f=metrics.streamed: seen.append(a) or f(*a))
    rows = queries()["a34_compression_quality"](spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 3 and [r.variant for r in rows] == ["f32", "pca32_i8", "pca32_bin"]


def test_grid_points_share_the_searches_of_a_space(spark, monkeypatch):
    # Every point once searched the gallery three times and its own neighbours once.
    seen = []
    for module in (graph, reranking):
        monkeypatch.setattr(module, "nearest", lambda *a, f=module.nearest: seen.append(a) or f(*a))
    q, g = reranking.sides(spark, "/root/testdata/sf0.001")
    reranking.grid_runs(q, g)
    assert len(seen) == 2


def test_a_search_moves_every_row_once(rows):
    # Rows were once sent to each block of the other side; now packed blocks meet.
    q, g = rows(np.eye(4)), rows(np.eye(4), start=10)
    plan = similarity.nearest(q, g, 2, similarity.Plan(q_rows=1, g_rows=1))._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan and "explode" not in plan


def test_reranking_adds_common_weights_a_bounded_number_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    v, w = rng.random((6, 9)) * (rng.random((6, 9)) < 0.5), rng.random((8, 9)) * (rng.random((8, 9)) < 0.5)
    entries = lambda m: (*np.nonzero(m), m[np.nonzero(m)])
    row, member, weight = entries(w)
    order = np.argsort(member, kind="stable")
    for most in (1, 5, 1000):
        monkeypatch.setattr(graph, "TILE", most)
        got = graph._minima(entries(v), {"row": row[order], "member": member[order], "weight": weight[order]}, (6, 8))
        np.testing.assert_allclose(got, np.minimum(v[:, None], w[None]).sum(axis=2))


@pytest.mark.parametrize("name,most", [("f2_two_space_features", 6), ("f6_alternative_candidate", 3), ("r24_postprocessing_ablation", 7), ("head_rows", 3)])
def test_queries_compare_both_sides_once_per_need(spark, monkeypatch, name, most):
    # These once made 10, 4, 11 and 6 comparisons of blocks: every list had a search of its own.
    seen = []
    for module in (similarity, graph):
        monkeypatch.setattr(module, "blocked", lambda *a, f=module.blocked, **k: seen.append(a) or f(*a, **k))
    (deciding.head_rows if name == "head_rows" else queries()[name])(spark, "/root/testdata/sf0.001")
    assert 0 < len(seen) <= most


def test_grid_points_score_only_pairs_with_common_members(monkeypatch):
    # Re-ranking once scored and sorted all pairs of a block, whether they shared a member or not.
    rng = np.random.default_rng(2)
    table = lambda n, at, members: pa.table({
        "ord": np.arange(n) + at, "emb": pa.array(rng.normal(size=(n, 4)).tolist()), "frame": [f"f{(at + i) // 2}" for i in range(n)],
        "members": pa.array(members, pa.list_(pa.int64())), "weights": pa.array([[0.5] * len(m) for m in members], pa.list_(pa.float64()))})
    q, g = table(100, 0, [[i % 7] for i in range(100)]), table(300, 90, [[i] for i in range(300)])
    seen = []
    monkeypatch.setattr(graph, "fold", lambda a, b, f=graph.fold: seen.append(len(a)) or f(a, b))
    found = graph._Reranked(q, g, similarity.Plan(), 0.2).best(3)
    assert sum(seen) <= 100 and set(zip(found["q_ord"], found["g_ord"])) == {(i, 90 + i % 7) for i in range(100) if i // 2 != (90 + i % 7) // 2}
