"""Blocked similarity: exactness, ties, copies, exclusions, thresholds and profiles."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchbook.operators import ann, features, similarity
from matchbook.operators.search import FAR_ORD, reciprocal_rank_fusion
from matchbook.operators.similarity import CAMERA, FRAME, JUNK, SELF, Plan, counts_ahead, nearest, within


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(q, g, k, allowed=None):
    s = unit(q) @ unit(g).T
    if allowed is not None:
        s = np.where(allowed, s, -np.inf)
    order = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(s, order, axis=1)


def collect(df, k):
    out = {}
    for r in df.collect():
        out.setdefault(r.q_ord, [None] * k)[r.pos - 1] = r.g_ord
    return out


def test_topk_matches_brute_force_for_any_blocks(rows):
    rng = np.random.default_rng(1)
    q, g = rng.normal(size=(23, 12)), rng.normal(size=(90, 12))
    want, _ = brute(q, g, 5)
    dq, dg = rows(q), rows(g, start=1000)
    for plan in (Plan(), Plan(q_rows=7, g_rows=20), Plan(q_rows=5, g_rows=1000)):
        got = collect(nearest(dq, dg, 5, plan), 5)
        assert all(got[i] == [1000 + j for j in want[i]] for i in range(23))


def test_a_third_of_identical_rows_keeps_ordinal_order(rows):
    rng = np.random.default_rng(2)
    g = rng.normal(size=(60, 8))
    g[5:45:2] = g[5]
    q = np.vstack([g[5] + 0.01, rng.normal(size=8)])
    want = [5 + 2 * i for i in range(20)]
    for plan in (Plan(), Plan(q_rows=1, g_rows=11)):
        got = collect(nearest(rows(q), rows(g, start=0, frames=[f"g{i}" for i in range(60)]), 20, plan), 20)
        assert got[0] == want
        assert got[1] == collect(nearest(rows(q), rows(g, frames=[f"g{i}" for i in range(60)]), 20), 20)[1]


def test_exclusions(rows):
    e = np.eye(3)
    q = rows(e[:1], vehicles=[1], cameras=[1], frames=["a"])
    g = rows(np.array([[1, 0, 0], [0.9, 0.1, 0], [0.8, 0.3, 0.0], [0.5, 0.5, 0.1]]), vehicles=[1, 1, 2, 1], cameras=[1, 2, 1, 3],
             frames=["z", "a", "b", "c"], start=10)
    ids = lambda plan: collect(nearest(q, g, 4, plan), 4)[0]
    assert ids(Plan(exclude=())) == [10, 11, 12, 13]
    assert ids(Plan(exclude=(FRAME,)))[:3] == [10, 12, 13]
    assert ids(Plan(exclude=(JUNK,)))[:3] == [11, 12, 13]
    assert ids(Plan(exclude=(CAMERA,)))[:2] == [11, 13]
    assert ids(Plan(exclude=(), require=("vehicle_id",)))[:3] == [10, 11, 13]


def test_radius_and_counts(rows):
    rng = np.random.default_rng(3)
    q, g = rng.normal(size=(10, 6)), rng.normal(size=(70, 6))
    s = unit(q) @ unit(g).T
    for plan in (Plan(), Plan(q_rows=3, g_rows=9)):
        hits = {(r.q_ord, r.g_ord) for r in within(rows(q), rows(g, start=500), 0.4, plan).collect()}
        assert hits == {(i, 500 + j) for i, j in zip(*np.nonzero(s >= 0.4))}
        marked = rows(q).withColumn("marks", F.array(F.lit(0.4), F.lit(-0.2))).withColumn("mark_ords", F.array(F.lit(FAR_ORD), F.lit(FAR_ORD)))
        n = {(r.q_ord, r["mark"]): r.n for r in counts_ahead(marked, rows(g, start=500), plan).collect()}
        assert all(n[(i, 0)] == (s[i] >= 0.4).sum() and n[(i, 1)] == (s[i] >= -0.2).sum() for i in range(10))


def test_profile_equals_numpy(rows):
    rng = np.random.default_rng(4)
    q, g = rng.normal(size=(6, 5)), rng.normal(size=(101, 5))
    g[10:40] = g[10]
    s = unit(q) @ unit(g).T
    names = {"a": 0.1, "m": 0.5, "z": 0.95}
    for plan in (Plan(), Plan(q_rows=2, g_rows=30)):
        for r in features.profile(rows(q), rows(g, start=300), names, plan).collect():
            x = s[r.q_ord]
            assert r.n == 101
            np.testing.assert_allclose([r["mean"], r["std"]], [x.mean(), x.std()], atol=1e-9)
            np.testing.assert_allclose([r.a, r.m, r.z], np.quantile(x, [0.1, 0.5, 0.95]), atol=1e-12)


def test_rank_fusion_is_exact(rows):
    rng = np.random.default_rng(5)
    q, g, q2, g2 = rng.normal(size=(5, 6)), rng.normal(size=(200, 6)), rng.normal(size=(5, 6)), rng.normal(size=(200, 6))
    got = collect(reciprocal_rank_fusion(rows(q), rows(g, start=900), rows(q2), rows(g2, start=900), 10), 10)
    rank = lambda a, b: np.argsort(np.argsort(-(unit(a) @ unit(b).T), axis=1, kind="stable"), axis=1)
    score = 0.65 / (20 + rank(q, g)) + 0.35 / (20 + rank(q2, g2))
    want = np.argsort(-score, axis=1, kind="stable")[:, :10]
    assert all(got[i] == [900 + j for j in want[i]] for i in range(5))


def test_cells_with_a_hot_cell_and_completion(rows):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8)) * 3
    # Half of all rows lie in one cluster.
    which = np.where(rng.random(400) < 0.5, 0, rng.integers(0, 6, size=400))
    g = centres[which] + rng.normal(size=(400, 8)) * 0.4
    q = centres[rng.integers(0, 6, size=12)] + rng.normal(size=(12, 8)) * 0.4
    dq, dg = rows(q), rows(g, start=1000)
    want, _ = brute(q, g, 10)
    index = ann.CellIndex(dg, 6)
    pool = index.search(dq, 10, probes=2, plan=Plan(g_rows=50))
    got = collect(pool, 10)
    recall = np.mean([len(set(got[i]) & {1000 + j for j in want[i]}) / 10 for i in range(12)])
    assert recall >= 0.8
    exact = collect(index.complete(dq, pool, 10), 10)
    assert all(exact[i] == [1000 + j for j in want[i]] for i in range(12))


def test_required_columns_are_block_keys(rows):
    """Rows meet only where they agree; a value held by half of the rows is cut into blocks."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 6))
    who = np.where(rng.random(120) < 0.5, 0, rng.integers(1, 6, size=120))
    q, g = rows(x[:40], vehicles=who[:40]), rows(x[40:], vehicles=who[40:], start=1000, frames=[f"g{i}" for i in range(80)])
    want, _ = brute(x[:40], x[40:], 3, who[:40, None] == who[None, 40:])
    for plan in (Plan(require=("vehicle_id",)), Plan(require=("vehicle_id",), q_rows=5, g_rows=9)):
        got = collect(nearest(q, g, 3, plan), 3)
        for i in range(40):
            many = min(3, int((who[40:] == who[i]).sum()))
            assert (got.get(i, [])[:many]) == [1000 + j for j in want[i][:many]]


@pytest.mark.parametrize("per_part", [256, 4])
def test_joint_counts_in_one_and_in_several_parts(rows, monkeypatch, per_part):
    from pyspark.sql import functions as F

    from matchbook.operators import similarity

    monkeypatch.setattr(similarity, "TRACK_ROWS", per_part)
    rng = np.random.default_rng(9)
    centre = rng.normal(size=5)
    x, y = centre + 0.8 * rng.normal(size=(40, 5)), centre + 0.8 * rng.normal(size=(60, 5))
    track = np.where(np.arange(40) < 25, 7, np.arange(40) // 2)  # one long track, short ones
    q = rows(x, frames=[f"f{i}" for i in range(40)]).join(
        rows(x).sparkSession.createDataFrame([(i, int(t)) for i, t in enumerate(track)], "ord long, track long"), "ord")
    g = rows(y, frames=[f"f{i}" for i in range(20, 80)], start=100)
    u, v = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    hit = (u @ v.T >= 0.3) & (np.arange(40)[:, None] != np.arange(20, 80)[None])
    want = {int(t): (int((track == t).sum()), int(hit[track == t].all(axis=0).sum())) for t in set(track)}
    got = similarity.joint_counts(q, g, 0.3, Plan(q_rows=16, g_rows=23))
    assert {r.track: (r.m, r.n_cand) for r in got.collect()} == want and any(n for _, n in want.values())
    none = similarity.joint_counts(q, g.filter(F.lit(False)), 0.3)
    assert {r.n_cand for r in none.collect()} == {0}


def test_lateral_table_function_over_many_blocks(rows, monkeypatch):
    from matchbook.functions import extensions

    monkeypatch.setattr(extensions, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 5))
    x[20:25] = x[50]  # ties
    q, g = rows(x[:40]), rows(x, start=100)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.q_ord, r.pos): r.g_ord for r in extensions.knn_lateral(q, g, 7).collect()}
    sims = np.round(unit[:40] @ unit.T, 12)
    for i in range(40):
        assert [got[i, p] for p in range(1, 8)] == [j + 100 for j in sorted(range(90), key=lambda j: (-sims[i, j], j))[:7]]
    assert len(got) == 280
    assert extensions.knn_lateral(q, g.limit(0), 7).count() == 0 and extensions.knn_lateral(q.limit(0), g, 7).count() == 0
    assert extensions.knn_lateral(q, g.limit(3), 7).count() == 120


def test_quantiles_of_a_gallery_seen_in_parts():
    # Copies make buckets of many equal scores; the held scores are merged after every part.
    rng = np.random.default_rng(8)
    qe, ge = rng.normal(size=(6, 5)), rng.normal(size=(200, 5))
    ge[:120] = ge[0]
    table = lambda e, start: pa.table({"ord": np.arange(len(e)) + start, "emb": pa.array(e.tolist())})
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    state = features._Quantiles(table(qe, 0), Plan(exclude=(SELF,)), probs)
    state.HELD = 10
    for side in (0, 1):
        for at in range(0, 200, 30):
            state.see(side, table(ge, 3).slice(at, 30))
    out = state.result()
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    for i in range(6):
        s = np.delete(unit(ge) @ unit(qe)[i], [i - 3] if i >= 3 else [])
        assert out["n"][i] == len(s)
        assert [out["mean"][i], out["std"][i]] == pytest.approx([s.mean(), s.std()])
        assert [out[f"p{p}"][i] for p in range(5)] == pytest.approx(np.quantile(s, probs).tolist())


def test_a_block_is_scored_in_slices_of_its_queries():
    seen = []

    def body(b):
        seen.append(b.scores.shape)
        return {"q_ord": b.qo, "n": b.allowed.sum(axis=1)}

    table = lambda n: pa.table({"ord": np.arange(n), "emb": pa.array(np.ones((n, 2)).tolist())})
    schema = T.StructType([T.StructField("q_ord", T.LongType()), T.StructField("n", T.LongType())])
    out = similarity._task(Plan(exclude=(SELF,)), schema, body, similarity.Block, False)(table(3000), table(4096))
    assert out.num_rows == 3000 and set(out["n"].to_pylist()) == {4095}
    assert len(seen) == 3 and max(a * b for a, b in seen) <= similarity.TILE


def test_blocks_widen_before_they_become_many(rows):
    # Rows of 17 x 41 once made a group per pair of such blocks, quadratic in number.
    rng = np.random.default_rng(9)
    q, g = rng.normal(size=(200, 3)), rng.normal(size=(500, 3))
    schema = T.StructType([T.StructField("n", T.LongType())])
    pairs = similarity.blocked(rows(q), rows(g, start=1000), Plan(q_rows=3, g_rows=5), schema, lambda b: {"n": [b.scores.size]})
    n = [r.n for r in pairs.collect()]
    assert sum(n) == 200 * 500 and len(n) <= similarity.FEW**2


def test_counts_ahead_of_ties_at_the_marks(rows):
    q, g = rows(np.array([[1.0, 0.0]])), rows(np.array([[1.0, 0.0]] * 4 + [[0.0, 1.0]] * 3), start=10)
    marked = q.withColumn("marks", F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(-1.0))).withColumn(
        "mark_ords", F.array(F.lit(12).cast("long"), F.lit(15).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")))
    assert {r["mark"]: r.n for r in counts_ahead(marked, g).collect()} == {0: 2, 1: 5, 2: 0, 3: 7}


def test_one_comparison_gives_moments_marks_and_best_scores(rows):
    # Three comparisons of all pairs (moments, counts, two best) once did this.
    rng = np.random.default_rng(11)
    q, g = rng.normal(size=(9, 5)), rng.normal(size=(70, 5))
    g[10:20] = g[10]
    g[30] = g[40]
    s = unit(q) @ unit(g).T
    mark = [int(np.argsort(-r)[3]) for r in s]
    values = {i: float(similarity.fold(unit(q)[i : i + 1], unit(g)[j : j + 1])[0]) for i, j in enumerate(mark)}
    at = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("ord")]
    marked = rows(q).withColumn("marks", F.array(at(values))).withColumn("mark_ords", F.array(at({i: j + 1000 for i, j in enumerate(mark)}).cast("long")))
    for plan in (Plan(), Plan(q_rows=4, g_rows=13)):
        got = {r.q_ord: r for r in similarity.moments_and_marks(marked, rows(g, start=1000), 2, plan).collect()}
        n = {r.q_ord: r.n for r in counts_ahead(marked, rows(g, start=1000), plan).collect()}
        for i, r in enumerate(s):
            e = np.round(r, 12)
            assert got[i].n == 70 and abs(got[i].s1 - r.sum()) < 1e-9 and abs(got[i].s2 - (r * r).sum()) < 1e-9
            assert np.allclose(got[i].best, np.sort(r)[::-1][:2], atol=1e-12)
            assert got[i].ahead == n[i] == (e > e[mark[i]]).sum() + (e[: mark[i]] == e[mark[i]]).sum()


def test_best_rows_in_one_group_of_maxima_and_few_pairs_at_once(monkeypatch):
    # The 8 best rows fall into one group of maxima; most scores are equal, which once gathered the vectors of all of them.
    monkeypatch.setattr(similarity, "EXACT_ROWS", 1000)
    n = 16 * 8 * 8
    g = np.tile([0.0, 1.0], (n, 1))
    g[:: 16 * 8] = [[1.0, 0.1 * i] for i in range(8)]
    table = lambda x, at: pa.table({"ord": np.arange(len(x)) + at, "emb": pa.array(x.tolist())})
    seen = []
    monkeypatch.setattr(similarity, "fold", lambda a, b, f=similarity.fold: seen.append(len(a)) or f(a, b))
    b = similarity.Block(table(np.array([[1.0, 0.0], [0.0, 1.0]]), 5000), table(g, 0), Plan(exclude=()))
    i, j, _ = b.top(8)
    assert j[i == 0].tolist() == list(range(0, n, 16 * 8)) and j[i == 1].tolist() == list(range(1, 9))
    assert max(seen) <= 1000


def test_pairs_of_blocks_are_dealt_to_many_tasks(rows):
    # Partitions sized by bytes once put all pairs of blocks of a small table into a few tasks.
    schema = T.StructType([T.StructField("n", T.LongType())])
    rng = np.random.default_rng(9)
    pairs = similarity.blocked(rows(rng.normal(size=(90, 3))), rows(rng.normal(size=(200, 3))), Plan(q_rows=3, g_rows=5), schema, lambda b: {"n": [1]})
    assert pairs.rdd.getNumPartitions() == similarity.TASKS


@pytest.mark.parametrize("seed", range(12))
def test_proposals_in_single_precision_lose_no_row(monkeypatch, seed):
    # Scores of all pairs were once formed and masked in double precision; now only what may be among the best is.
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(similarity, "HELD", int(rng.choice([30, 1 << 20])))
    n, m, d, k = (int(x) for x in (rng.integers(1, 600), rng.integers(1, 900), rng.integers(1, 9), rng.integers(1, 12)))
    x, y = rng.normal(size=(n, d)), rng.normal(size=(m, d))
    if seed % 3 == 0:
        x[: n // 2], y[rng.integers(0, m, m // 2)] = y[0], y[0]
    if seed % 4 == 1:
        x, y = np.round(x), np.round(y) * rng.choice([1e-3, 1e3], size=(m, 1))
    if seed % 5 == 3:
        y[0, 0] = np.inf
    frames = lambda n: pa.array([None if f == 0 else f"f{f}" for f in rng.integers(0, 400 if seed % 2 else 20, n)])
    table = lambda v, at: pa.table({"ord": np.arange(len(v)) + at, "emb": pa.array(v.tolist()), "frame": frames(len(v))})
    q, g = table(x, 0), table(y, n // 2)
    wanted = [(k, Plan(normalise=seed % 2 == 0, self_sim=1.0)), (3, Plan(exclude=(SELF,), normalise=seed % 2 == 0))]
    with np.errstate(all="ignore"):
        got = similarity.Search(q, g, wanted[0][1]).tops(wanted)
        want = [similarity.Block(q, g, plan).top(k) for k, plan in wanted]
    assert all(np.array_equal(a, b) for one, other in zip(got, want) for a, b in zip(one, other))
