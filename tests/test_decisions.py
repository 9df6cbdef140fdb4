"""Policies, patches, compression, splits and generations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbook.operators import compress, features, patches, policies, splits
from matchbook.operators.similarity import Plan
from matchbook.streaming.ingest import Generations


def test_rescue_guard(spark):
    # night, absent, raw, before, now, road
    cases = [(False, 0.85, 0.3, False, True, 0.5), (True, 0.85, 0.3, False, True, 0.5), (False, 0.7, 0.3, False, True, 0.5),
             (False, 0.85, 0.6, False, True, 0.5), (False, 0.85, 0.3, True, True, 0.5), (False, 0.85, 0.3, False, True, 0.95)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, night boolean, absent double, raw double, b boolean, n boolean, road double")
    c = F.col
    got = df.select("i", policies.contradictory_rescue(c("absent"), c("road"), c("raw"), c("night"), c("b"), c("n")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [True, False, False, False, False, False]


def test_supplement_never_revokes(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(c), bool(c >= 0.6), float(s)) for i, (c, s) in enumerate(rng.random((60, 2)))]
    df = spark.createDataFrame(data, "q_ord long, confidence double, accepted boolean, s double")
    out = {r.q_ord: r for r in policies.checked(policies.supplement(df, F.col("s"), 0.7, 0.6), 0.6).collect()}
    for i, conf, acc, s in data:
        assert out[i].accepted == (acc or s >= 0.7)
        if acc:
            assert out[i].confidence == conf
    staged = policies.run_chain(df, [policies.Stage("one", lambda d: d.withColumn("score", F.col("s")), 0.7)], 0.6).collect()
    assert {r.q_ord: r.accepted for r in staged} == {k: v.accepted for k, v in out.items()}


def test_rule_count():
    assert len(policies.evidence_rules()) == 22


def test_shifted_grid_matches(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(8, 8, 16))
    b = np.roll(a, 1, axis=1)
    b[:, 0] = rng.normal(size=(8, 16))
    norm = lambda x: (x / np.linalg.norm(x, axis=-1, keepdims=True)).reshape(-1).tolist()
    df = spark.createDataFrame([(0, 1, norm(a), norm(b)), (0, 2, norm(a), norm(rng.normal(size=(8, 8, 16))))],
                               "q_ord long, g_ord long, qt array<double>, gt array<double>")
    got = {r.g_ord: r for r in patches.shift_matches(df, 16, 8, 0.9).collect()}
    assert got[1].n_inliers == 56 and got[2].n_inliers == 0


def test_pair_descriptor_size():
    rng = np.random.default_rng(2)
    d = patches.describe(rng.normal(size=(2, 36, 10)), rng.normal(size=(2, 36, 10)))
    assert d.shape == (2, 120) and np.isfinite(d).all()


def test_bytes_per_vector():
    size = lambda n: compress.Variant.parse(n).bytes_per_vector(768)
    assert [size(n) for n in ("f32", "pca128", "pca128_i8", "pca256_bin", "pq16")] == [3072, 256, 128, 32, 16]
    with pytest.raises(ValueError):
        compress.Variant.parse("zip9")


def test_pca_matches_numpy(rows):
    x = np.random.default_rng(3).normal(size=(80, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2])
    df = rows(x).repartition(4)
    pca = compress.fit_pca(df, 3)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    np.testing.assert_allclose(pca.eigenvalues, values[::-1][:3], rtol=1e-9)
    np.testing.assert_allclose(np.abs(pca.weights.T @ vectors[:, ::-1][:, :3]), np.eye(3), atol=1e-8)
    white = np.array([r.z for r in compress.project(df, compress.fit_pca(df, 3, whiten=True)).collect()])
    np.testing.assert_allclose(np.cov(white.T), np.eye(3), atol=1e-4)


def test_adaptation_matches_numpy(rows):
    x = np.random.default_rng(4).normal(size=(50, 5)) + 1.0
    m = compress.gallery_adaptation(rows(x), 0.5, 0.25)
    c = x.mean(0) * 0.5
    values, vectors = np.linalg.eigh((x - c).T @ (x - c) / len(x))
    s = np.maximum(values, 0.1 * values.mean()) ** -0.25
    np.testing.assert_allclose(m.weights, (vectors * (s / np.median(s))) @ vectors.T, atol=1e-9)


def test_sign_words(rows):
    x = np.random.default_rng(5).normal(size=(4, 70))
    r = rows(x).select("ord", compress.sign_words(F.col("emb"), 70).alias("w")).orderBy("ord").collect()
    for i, row in enumerate(r):
        for word, lo, hi in ((row.w[0], 0, 64), (row.w[1], 64, 70)):
            want = sum(1 << b for b in range(hi - lo) if x[i, lo + b] > 0)
            assert word % (1 << 64) == want


def test_balanced_batches(rows):
    vid = np.array([0] * 60 + [1] * 2 + [2] * 9 + [3] * 20)
    cam = np.arange(91) % 5
    df = rows(np.ones((91, 2)), vid, cam)
    for by_camera in (False, True):
        got = splits.identity_batches(df, 3, 4, 6, 1, by_camera).toPandas()
        assert (got.groupby("batch").vehicle_id.nunique() == 3).all() and (got.groupby(["batch", "vehicle_id"]).size() == 4).all()
        big = got[got.vehicle_id != 1].groupby(["batch", "vehicle_id"])
        assert (big.ord.nunique() == 4).all()
        if by_camera:
            assert (big.camera_id.nunique() == 4).all()


def test_open_set_split_keeps_identities_apart(rows):
    df = rows(np.ones((50, 2)), np.arange(50) % 10)
    got = splits.open_set_split(df, 0.3, 5).toPandas()
    fit, val = set(got[got.part == "fit"].vehicle_id), set(got[got.part == "val"].vehicle_id)
    assert not fit & val and len(val) == 3


def test_pseudo_cameras_follow_average_linkage(spark):
    rng = np.random.default_rng(6)
    centres = np.linalg.qr(rng.normal(size=(6, 6)))[0][:3]
    which = np.arange(30) % 3
    x = centres[which] + 0.1 * rng.normal(size=(30, 6))
    df = spark.createDataFrame([(i, int(i >= 15), [float(v) for v in x[i]]) for i in range(30)], "ord long, resolution int, emb array<double>")
    got = {r.ord: r.camera_id for r in splits.pseudo_cameras(df, 0.35).collect()}
    groups = {}
    for i in range(30):
        groups.setdefault(got[i], set()).add((int(i >= 15), int(which[i])))
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == 6


def linkage(x, resolution, threshold):
    """Average linkage by its definition: the nearest two clusters merge, averaged over all pairs of members."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(len(x))]
    while True:
        near = [(np.mean([1 - x[i] @ x[j] for i in a for j in b]), a, b) for n, a in enumerate(groups) for b in groups[n + 1 :] if resolution[a[0]] == resolution[b[0]]]
        best = min(near, default=(np.inf, None, None), key=lambda t: t[0])
        if not best[0] < threshold:
            return sorted(sorted(g) for g in groups)
        groups = [g for g in groups if g not in (best[1], best[2])] + [best[1] + best[2]]


def test_average_linkage_by_rounds_equals_its_definition(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(48, 3))
    x[40:44] = x[3]  # equal vectors, also across resolutions
    resolution = [i % 2 for i in range(44)] + [2, 2, 2, 3]
    df = spark.createDataFrame([(i, resolution[i], [float(v) for v in x[i]]) for i in range(48)], "ord long, resolution int, emb array<double>")
    for threshold in (0.35, 0.9):
        want = linkage(x, resolution, threshold)
        for task_clusters in (1024, 4, 0):
            groups = {}
            for r in splits.average_linkage(df, threshold, task_clusters).collect():
                groups.setdefault(r.first, []).append(r.ord)
            assert sorted(sorted(g) for g in groups.values()) == want and all(k == min(g) for k, g in groups.items())
    assert splits.pseudo_cameras(df.limit(0)).count() == 0


def test_local_geometry_shape(rows):
    rng = np.random.default_rng(7)
    q, g = rows(rng.normal(size=(3, 6))), rows(rng.normal(size=(30, 6)), start=50)
    top = q.select(F.col("ord").alias("q_ord"), (F.col("ord") + 50).alias("top"))
    got = features.local_geometry(q, g, top).toPandas()
    assert got.shape == (3, 19) and np.isfinite(got.to_numpy()).all()


def test_failed_registration_keeps_the_generation(rows):
    rng = np.random.default_rng(8)
    good = rows(rng.normal(size=(20, 4)))
    gen = Generations()
    first = gen.register(good)
    with pytest.raises(ValueError):
        gen.register(rows(rng.normal(size=(5, 4))))
    assert gen.generation == first and gen.gallery.count() == 20
    assert gen.register(good.repartition(2)) == first and gen.hits == 1


def test_no_rows_without_match_and_non_finite_confidence(spark):
    from pyspark.sql import functions as F

    from matchbook.operators import refusal

    rows = spark.createDataFrame([(0.9, True, True), (0.2, True, False), (float("nan"), True, False), (float("inf"), True, True)], "conf double, has_match boolean, correct boolean")
    got = {round(r.threshold, 3): r for r in refusal.sweep_all_values(rows).collect()}
    assert set(got) == {0.9, 0.2}
    assert (got[0.9].tp, got[0.9].fn, got[0.9].accept_rate, got[0.9].tnr) == (1, 3, 0.25, None)
    assert (got[0.2].tp, got[0.2].fp, got[0.2].fn) == (1, 1, 2)
    one = refusal.confusion(rows, refusal.accepts(F.col("conf"), 0.5)).first()
    assert one.tnr is None and abs(one.score - 100 * 0.7 * one.f1) < 1e-9


def test_fingerprint_tells_cancelling_rows_and_separators_apart(spark):
    from matchbook.operators.verify import fingerprint

    table = lambda *rows: spark.createDataFrame(list(rows), "a string, b string")
    digest = lambda t: tuple(fingerprint(t, ["a", "b"]).first())
    assert digest(table(("a", "x"), ("a", "x"))) != digest(table(("b", "x"), ("b", "x")))
    assert digest(table(("a|b", "c"))) != digest(table(("a", "b|c"))) and digest(table(("~", "c"))) != digest(table((None, "c")))
    assert digest(table(("1", "2"), ("3", "4"))) == digest(table(("3", "4"), ("1", "2")))


def test_a_round_of_average_linkage_takes_few_stages(spark, monkeypatch):
    # A round once stored eight tables (and one without small resolutions counted three times more); now three.
    stored = []
    monkeypatch.setattr(splits, "durable", lambda df, name, f=splits.durable: stored.append(name) or f(df, name))
    x = np.random.default_rng(3).normal(size=(60, 3))
    df = spark.createDataFrame([(i, 0, [float(v) for v in x[i]]) for i in range(60)], "ord long, resolution int, emb array<double>")
    groups = {}
    for r in splits.average_linkage(df, 0.6, 5).collect():
        groups.setdefault(r.first, []).append(r.ord)
    assert sorted(sorted(g) for g in groups.values()) == linkage(x, [0] * 60, 0.6)
    rounds = stored.count("nearest")
    assert rounds > 1 and len(stored) <= 2 + 3 * rounds + 1
