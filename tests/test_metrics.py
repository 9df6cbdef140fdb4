"""Hand-computed metrics and refusal rules."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from matchbook.operators import cascade, metrics, refusal
from matchbook.operators.similarity import CAMERA, Plan, nearest


def towards(sims):
    """Gallery vectors with the given cosines to the first axis."""
    return np.array([[s, math.sqrt(1 - s * s)] for s in sims])


def case(rows, sims, g_vid, g_cam, q_vid=1, q_cam=0):
    return rows(np.array([[1.0, 0.0]]), [q_vid], [q_cam]), rows(towards(sims), g_vid, g_cam, start=100)


def test_average_precision_by_hand(rows):
    q, g = case(rows, [0.9, 0.8, 0.7, 0.6], [1, 2, 1, 3], [1, 1, 1, 1])
    r = metrics.full_average_precision(q, g).first()
    assert r.ap == pytest.approx((1 + 2 / 3) / 2) and r.first_hit == 1 and r.last_hit == 3 and r.n_pos == 2
    assert metrics.mean_inverse_negative_penalty(metrics.full_average_precision(q, g)).first().minp == pytest.approx(2 / 3)


def test_junk_is_not_a_match(rows):
    q, g = case(rows, [0.9, 0.8], [1, 2], [0, 1])
    assert metrics.full_average_precision(q, g).count() == 0
    assert metrics.average_precision_at_k(nearest(q, g, 2, Plan(exclude=()), ["vehicle_id", "camera_id"], ["vehicle_id", "camera_id"]), q, g, 2).count() == 0


def test_standard_and_strict_protocols(rows):
    q, g = case(rows, [0.95, 0.5, 0.9], [1, 1, 2], [0, 1, 0])
    assert metrics.full_average_precision(q, g).first().ap == pytest.approx(0.5)
    assert metrics.full_average_precision(q, g, exclude=CAMERA).first().ap == pytest.approx(1.0)


def test_cutoff_truncates_before_junk_leaves(rows):
    # Junk holds the first place; the list of two keeps one row and is not refilled.
    q, g = case(rows, [0.95, 0.9, 0.8], [1, 2, 1], [0, 1, 1])
    top = nearest(q, g, 2, Plan(exclude=()), ["vehicle_id", "camera_id"], ["vehicle_id", "camera_id"])
    r = metrics.average_precision_at_k(top, q, g, 2).first()
    assert r.ap == 0.0 and r.n_valid == 1


def test_no_valid_query_is_an_error(rows):
    q, g = case(rows, [0.9], [2], [1])
    with pytest.raises(Exception, match="no query has a valid positive"):
        metrics.require_valid(metrics.summary(metrics.full_average_precision(q, g))).collect()


def decisions(spark, conf, correct, has):
    return spark.createDataFrame([(i, float(c), bool(k), bool(h)) for i, (c, k, h) in enumerate(zip(conf, correct, has))],
                                 "q_ord long, conf double, correct boolean, has_match boolean")


def test_perfect_separation(spark):
    d = decisions(spark, [0.9, 0.8, 0.7, 0.2, 0.1], [1, 1, 1, 0, 0], [1, 1, 1, 0, 0])
    best = refusal.best(refusal.sweep(d, refusal.quantile_grid(d, 200))).first()
    assert best.f1 == pytest.approx(1) and best.tnr == pytest.approx(1)
    assert refusal.pr_auc(d).first().pr_auc == pytest.approx(1)


def test_nan_and_infinity_refuse(spark):
    d = decisions(spark, [float("nan"), float("inf"), 0.9], [1, 1, 1], [1, 1, 1])
    r = refusal.confusion(d, refusal.accepts(F.col("conf"), 0.5)).first()
    assert (r.tp, r.fn) == (1, 2)
    swept = refusal.sweep(d, d.limit(1).select(F.array(F.lit(0.5)).alias("ths"))).first()
    assert (swept.tp, swept.fn) == (1, 2)


def test_sweep_equals_direct_counts(spark):
    rng = np.random.default_rng(3)
    conf, ok, has = rng.random(80).round(2), rng.random(80) < 0.6, rng.random(80) < 0.7
    d = decisions(spark, conf, ok, has)
    for r in refusal.sweep_all_values(d).collect():
        a = conf >= r.threshold
        assert (r.tp, r.fp, r.fn, r.tn) == ((a & has & ok).sum(), (a & ~(has & ok)).sum(), (~a & has).sum(), (~a & ~has).sum())


def test_bits(spark):
    row = spark.range(1).select(*[refusal.bits(F.lit(n), F.lit(1024)).alias(f"b{n}") for n in (1, 1024, 0)]).first()
    assert (row.b1, row.b1024, row.b0) == (10.0, 0.0, 10.0)


def test_cascade_properties(spark):
    rng = np.random.default_rng(4)
    data = [(q, g, float(rng.random()), float(rng.random())) for q in range(4) for g in range(12)]
    short = spark.createDataFrame(data, "q_ord long, g_ord long, score double, heavy double")
    same = cascade.rescore(short, 0.0).collect()
    for q in range(4):
        want = [g for _, g in sorted((-s, g) for a, g, s, _ in data if a == q)]
        assert [r.g_ord for r in sorted((r for r in same if r.q_ord == q), key=lambda r: r.pos)] == want
        floor = min(s for a, _, s, _ in data if a == q)
        assert all(r.rescored >= floor + 1 for r in same if r.q_ord == q)
    with pytest.raises(ValueError):
        cascade.rescore(short, 1.5)


def brute_places(qe, ge, qv, gv, qc, gc):
    out = {}
    for i in range(len(qe)):
        rows = [(-sum(a * b for a, b in zip(qe[i], ge[j])), j) for j in range(len(ge)) if not (qv[i] == gv[j] and qc[i] == gc[j])]
        at = [p for p, (_, j) in enumerate(sorted(rows), 1) if gv[j] == qv[i]]
        if at:
            out[i] = (sum(h / p for h, p in enumerate(at, 1)) / len(at), at[0], at[-1], len(at))
    return out


@pytest.mark.parametrize("cells", [12 << 20, 150])
def test_full_ranking_with_copies_in_several_blocks(rows, cells):
    rng = np.random.default_rng(5)
    signs = lambda n: np.where(rng.random((n, 4)) < 0.5, -0.5, 0.5)
    qe, ge = signs(60), signs(400)
    qv, gv, qc, gc = rng.integers(0, 5, 60), rng.integers(0, 4, 400), rng.integers(0, 3, 60), rng.integers(0, 3, 400)
    got = metrics.full_average_precision(rows(qe, qv, qc), rows(ge, gv, gc), q_rows=7, cells=cells).collect()
    want = brute_places(qe, ge, qv, gv, qc, gc)
    assert {r.q_ord: (r.first_hit, r.last_hit, r.n_pos) for r in got} == {i: w[1:] for i, w in want.items()}
    assert all(r.ap == pytest.approx(want[r.q_ord][0]) for r in got)


def test_a_gallery_seen_in_parts_gives_the_same_places():
    # One task: a block of two identities, the gallery in parts of 50 rows with copies across them.
    rng = np.random.default_rng(6)
    qe, ge = np.where(rng.random((9, 4)) < 0.5, -0.5, 0.5), np.where(rng.random((300, 4)) < 0.5, -0.5, 0.5)
    ge[::3] = rng.normal(size=(100, 4))
    ge /= np.linalg.norm(ge, axis=1)[:, None]
    qv, gv, qc, gc = rng.integers(0, 2, 9), rng.integers(0, 3, 300), rng.integers(0, 2, 9), rng.integers(0, 2, 300)
    table = lambda e, v, c: pa.table({"ord": np.arange(len(e)), "emb": pa.array(e.tolist()), "vehicle_id": v, "camera_id": c})
    state, g = metrics._Ranks(table(qe, qv, qc), (("vehicle_id", "camera_id"),)), table(ge, gv, gc)
    for side in (0, 1):
        for at in range(0, 300, 50):
            part = g.slice(at, 50)
            state.see(side, part.filter(pc.less(part["vehicle_id"], 2)) if side == 0 else part)
    r = state.result()
    want = brute_places(qe, ge, qv, gv, qc, gc)
    assert {i: (f, l, n) for i, f, l, n in zip(r["q_ord"], r["first_hit"], r["last_hit"], r["n_pos"])} == {i: w[1:] for i, w in want.items()}


@pytest.mark.parametrize("normalise", [True, False])
def test_both_protocols_in_one_pass(rows, normalise):
    # Sign codes of 32 values: normalised, equal Hamming distances differ by rounding; as integers they are ties.
    rng = np.random.default_rng(7)
    qe, ge = rng.normal(size=(50, 32)), rng.normal(size=(300, 32))
    if not normalise:
        qe, ge = np.where(qe > 0, 1.0, -1.0), np.where(ge > 0, 1.0, -1.0)
    qv, gv, qc, gc = rng.integers(0, 5, 50), rng.integers(0, 4, 300), rng.integers(0, 3, 50), rng.integers(0, 3, 300)
    q, g = rows(qe, qv, qc), rows(ge, gv, gc, start=1000)
    got = {r.q_ord: r for r in metrics.both_average_precisions(q, g, normalise, q_rows=7).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None] if normalise else m
    std = brute_places(unit(qe).tolist(), unit(ge).tolist(), qv, gv, qc, gc)
    assert got.keys() == std.keys()
    for i, r in got.items():
        s = unit(ge) @ unit(qe)[i]
        order = [j for j in sorted(range(300), key=lambda j: (-s[j], j)) if gc[j] != qc[i]]
        at = [p for p, j in enumerate(order, 1) if gv[j] == qv[i]]
        assert (r.ap, r.first_hit) == (pytest.approx(std[i][0]), std[i][1])
        assert (r.ap_cross, r.first_hit_cross) == (pytest.approx(np.mean(np.arange(1, len(at) + 1) / at)), at[0])
