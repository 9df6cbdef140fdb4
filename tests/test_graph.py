"""k-reciprocal re-ranking and query insertion against dense brute force."""

import numpy as np
import pytest

from matchbook.operators import graph, insertion
from matchbook.operators.similarity import Plan, nearest
from matchbook.plans import reranking


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dense_weights(d, k1, k2):
    """Weights before and after averaging of a dense distance matrix, and its rankings."""
    n = len(d)
    order = np.argsort(np.round(d, 12), axis=1, kind="stable")
    near = lambda i, k: order[i, : k + 1]
    mutual = lambda i, k: {int(j) for j in near(i, k) if i in near(j, k)}
    before = np.zeros((n, n))
    for i in range(n):
        core = mutual(i, k1)
        full = set(core)
        for j in core:
            h = mutual(j, max(1, k1 // 2))
            if 3 * len(core & h) > 2 * len(h):
                full |= h
        for j in full:
            before[i, j] = np.exp(-d[i, j])
        before[i] /= before[i].sum()
    after = np.array([before[order[i, :k2]].mean(axis=0) for i in range(n)])
    return before, after, order


def distances(v, after, d, lam):
    t = np.minimum(v[None, :], after).sum(axis=1)
    return (1 - lam) * (1 - t / (2 - t)) + lam * d


def gallery_distances(g, frames):
    d = 2 - 2 * unit(g) @ unit(g).T
    d[frames[:, None] == frames[None, :]] = 8
    np.fill_diagonal(d, 0)
    return d


def isolated(q, g, frames, k1, k2, lam):
    before, after, _ = dense_weights(gallery_distances(g, frames), k1, k2)
    out = []
    for x in unit(q):
        d = 2 - 2 * unit(g) @ x
        near = np.argsort(np.round(d, 12), kind="stable")[: k2 - 1]
        out.append(distances(before[near].sum(axis=0) / k2, after, d, lam))
    return np.array(out)


def inserted(q, g, frames, k1, k2, lam):
    """The query is node 0 of a dense graph over itself and the gallery."""
    out = []
    base = gallery_distances(g, frames)
    for x in unit(q):
        d = 2 - 2 * unit(g) @ x
        full = np.zeros((len(g) + 1, len(g) + 1))
        full[1:, 1:] = base
        full[0, 1:] = full[1:, 0] = d
        _, after, _ = dense_weights(full, k1, k2)
        out.append(distances(after[0], after[1:], d, lam))
    return np.array(out)


def data(seed=0, n=40, m=6, dim=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    g = centres[rng.integers(0, 8, n)] + 0.5 * rng.normal(size=(n, dim))
    q = centres[rng.integers(0, 8, m)] + 0.5 * rng.normal(size=(m, dim))
    return q, g, np.array([f"g{i // 2}" for i in range(n)])


def check(got, want, k, start=100):
    for i in range(len(want)):
        mine = sorted((r for r in got if r.q_ord == i), key=lambda r: r.pos)
        order = np.argsort(np.round(want[i], 10), kind="stable")[:k]
        np.testing.assert_allclose([r.dist for r in mine], want[i][order], atol=1e-9)
        np.testing.assert_allclose([want[i][r.g_ord - start] for r in mine], want[i][order], atol=1e-9)


@pytest.mark.parametrize("k1,k2", [(3, 2), (6, 3)])
def test_k_reciprocal(rows, k1, k2):
    q, g, frames = data()
    dq, dg = rows(q), rows(g, frames=frames, start=100)
    for plan in (Plan(), Plan(q_rows=4, g_rows=13)):
        got = graph.k_reciprocal(dq, dg, 10, graph.build_graph(dg, k1, k2, plan), 0.3).collect()
        check(got, isolated(q, g, frames, k1, k2, 0.3), 10)


def test_duplicates_and_k2_one(rows):
    q, g, frames = data(3)
    g[7], g[21] = g[2], g[2]
    dq, dg = rows(q), rows(g, frames=frames, start=100)
    check(graph.k_reciprocal(dq, dg, 10, graph.build_graph(dg, 4, 2), 0.3).collect(), isolated(q, g, frames, 4, 2, 0.3), 10)
    # One neighbour for the mean means the query itself: the order is the cosine order.
    plain = {(r.q_ord, r.pos): r.g_ord for r in nearest(dq, dg, 10).collect()}
    only = graph.k_reciprocal(dq, dg, 10, graph.build_graph(dg, 4, 1), 0.3).collect()
    assert {(r.q_ord, r.pos): r.g_ord for r in only} == plain


def test_other_queries_do_not_matter(rows):
    q, g, frames = data(4)
    dg = rows(g, frames=frames, start=100)
    gr = graph.build_graph(dg, 3, 2)
    every = {(r.q_ord, r.pos): r.g_ord for r in graph.k_reciprocal(rows(q), dg, 10, gr, 0.2).collect()}
    alone = graph.k_reciprocal(rows(q[2:3], start=2), dg, 10, gr, 0.2).collect()
    assert all(every[(2, r.pos)] == r.g_ord for r in alone)


@pytest.mark.parametrize("seed", [0, 5])
def test_query_insertion(rows, seed):
    q, g, frames = data(seed)
    if seed == 5:
        q[1] = g[3]
    dq, dg = rows(q), rows(g, frames=frames, start=100)
    got = insertion.current_query_ranking(dq, dg, 10, graph.build_graph(dg, 3, 2), 0.2).collect()
    check(got, inserted(q, g, frames, 3, 2, 0.2), 10)


def test_sparse_gallery_is_refused(rows):
    _, g, _ = data()
    with pytest.raises(ValueError, match="too sparse"):
        graph.build_graph(rows(g[:6], frames=["a"] * 3 + ["b"] * 3), 4, 2, check=True)


def test_insertion_works_on_few_rows_of_the_gallery(rows, monkeypatch):
    # Four rings of the graph around every changed row were once worked on: over 1,100 list entries for these five queries.
    q, g, frames = data(1, n=400, m=5)
    dq, dg = rows(q), rows(g, frames=frames, start=1000)
    gr, seen = graph.build_graph(dg, 3, 2), []
    monkeypatch.setattr(insertion, "durable", lambda df, name, f=insertion.durable: seen.append(f(df, name)) or seen[-1])
    check(insertion.current_query_ranking(dq, dg, 10, gr, 0.2).collect(), inserted(q, g, frames, 3, 2, 0.2), 10, 1000)
    assert max(stage.count() for stage in seen) < 700


def test_insertion_with_long_lists_and_copies(rows):
    q, g, frames = data(6, n=60)
    g[7], g[21], q[2] = g[2], g[2], g[2]
    dq, dg = rows(q), rows(g, frames=frames, start=100)
    got = insertion.current_query_ranking(dq, dg, 10, graph.build_graph(dg, 6, 3), 0.3).collect()
    check(got, inserted(q, g, frames, 6, 3, 0.3), 10)


def test_fusion_with_insertion_ranks_all_pairs(rows):
    # Every pair is scored here: the weight of the insertion and the short lists leave no pair out.
    q, g, frames = data(2, n=60, dim=40)
    dq, dg = rows(q), rows(g, frames=frames, start=100)
    got = reranking.two_space_rank(dq, dg, insertion_weight=0.25).collect()
    second = lambda x: unit(unit(x)[:, 32:])
    joint = lambda x: np.hstack([unit(x), second(x)])
    parts = [isolated(q, g, frames, 3, 2, 0.2), isolated(second(q), second(g), frames, 3, 2, 0.2), inserted(joint(q), joint(g), frames, 3, 2, 0.2)]
    want = 0.75 * (parts[0] + parts[1]) / 2 + 0.25 * parts[2]
    for i, row in enumerate(want):
        mine = sorted((r for r in got if r.q_ord == i), key=lambda r: r.pos)
        order = np.argsort(np.round(row, 10), kind="stable")[:10]
        assert [r.g_ord - 100 for r in mine] == order.tolist()
        np.testing.assert_allclose([-r.rank for r in mine], row[order], atol=1e-9)
