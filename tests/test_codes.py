"""Product codes against plain arithmetic; half precision against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbook.functions.half import half_codes, half_decoded
from matchbook.operators import codes, compress
from matchbook.operators.similarity import Plan

FREE = Plan(exclude=())


def frame(spark, x, at=0):
    return spark.createDataFrame([(i + at, v.tolist()) for i, v in enumerate(x)], "ord long, emb array<double>")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 700)] + 0.2 * rng.normal(size=(700, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_half_precision_is_that_of_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-9, 5, 300), [0.0, 1.0, -2.0, 0.5, 2049.0, 2047.9999, 2.0**-14, 2.0**-24, 2.0**-25, 3 * 2.0**-26, 65504.0, 65519.9, 65520.0, -1e6]])
    row = frame(spark, [x]).select(half_codes(F.col("emb")).alias("c")).select("c", half_decoded(F.col("c")).alias("d")).first()
    with np.errstate(over="ignore"):
        want = x.astype(np.float16)
    assert (np.array(row.c, np.int16).view(np.uint16) & 0x7FFF).tolist() == (want.view(np.uint16) & 0x7FFF).tolist()
    assert np.array(row.d).tolist() == want.astype(np.float64).tolist()


def test_codes_name_the_nearest_centroid_and_tables_score_the_decoded_row(spark, vectors):
    g, q = frame(spark, vectors[:600]), frame(spark, vectors[600:], 10_000)
    index = codes.CodeIndex(g, 4, 16, codes.books_of_rows(g, 4, 16))
    book = [b for b in index.books]
    assert [b.shape for b in book] == [(256, 4)] * 4
    code = {r.ord: list(r.code) for r in index.rows.collect()}
    want = np.stack([((vectors[:600, None, 4 * i:4 * i + 4] - book[i][None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(4)], axis=1)
    assert [code[i] for i in range(600)] == want.tolist()
    back = np.hstack([book[i][want[:, i]] for i in range(4)])
    assert np.allclose([r.emb for r in codes.decoded(index.rows, book).orderBy("ord").collect()], back)
    scores = vectors[600:] @ back.T
    best = {i: np.lexsort((np.arange(600), -np.round(s, 12)))[:5].tolist() for i, s in enumerate(scores)}
    got = {}
    for r in index.pool(q, 5, FREE).orderBy("q_ord", "pos").collect():
        got.setdefault(r.q_ord - 10_000, []).append(r.g_ord)
        assert abs(r.sim - scores[r.q_ord - 10_000, r.g_ord]) < 1e-9
    assert got == best


def test_recall_of_fitted_codes_and_exact_scores(spark, vectors):
    g, q = frame(spark, vectors[:600]), frame(spark, vectors[600:], 10_000)
    exact = vectors[600:] @ vectors[:600].T
    true = {(i + 10_000, int(j)) for i, s in enumerate(exact) for j in np.argsort(-s)[:10]}
    index = codes.CodeIndex(g, 8, 16)
    found = index.search(q, 10, plan=FREE).collect()
    assert len(found) == len(true) and len(true & {(r.q_ord, r.g_ord) for r in found}) >= 0.9 * len(true)
    assert all(abs(r.sim - exact[r.q_ord - 10_000, r.g_ord]) < 1e-12 for r in found)


def test_variants_that_fit():
    assert compress.fitting(compress.NAMED, 64, 1000) == ["f32", "f16", "pca64_i8", "pq32", "pq16"]
    assert compress.fitting(compress.NAMED, 64, 50) == ["f32", "f16", "pq32", "pq16"]
    assert len(compress.fitting(compress.NAMED, 512, 1000)) == len(compress.NAMED)


def test_small_and_empty_galleries(spark, vectors):
    few = frame(spark, vectors[:3])
    index = codes.CodeIndex(few, 4, 16, codes.books_of_rows(few, 4, 16))
    assert index.search(frame(spark, vectors[:1], 99), 10, plan=FREE).count() == 3
    assert index.search(few.limit(0), 10, plan=FREE).count() == 0


def test_scores_of_codes_are_sums_of_table_entries(spark, vectors):
    # Rows of equal codes have equal scores however their products round, and go by ordinal.
    g, q = frame(spark, vectors[:600]), frame(spark, vectors[600:605], 10_000)
    index = codes.CodeIndex(g, 4, 16, [b[:6] for b in codes.books_of_rows(g, 4, 16)])
    code = {r.ord: list(r.code) for r in index.rows.collect()}
    x = np.array([v / np.sqrt(sum(y * y for y in v)) for v in vectors[600:605]])
    pool = index.pool(q, 40, FREE)
    for i in range(5):
        score = {}
        for o, c in code.items():
            s = 0.0
            for p, entry in enumerate(c):
                e = 0.0
                for d in range(4):
                    e += x[i, 4 * p + d] * index.books[p][entry, d]
                s += e
            score[o] = s
        want = sorted(score, key=lambda o: (-round(score[o], 12), o))[:40]
        got = [r.g_ord for r in pool.filter(F.col("q_ord") == 10_000 + i).orderBy("pos").collect()]
        assert got == want
    kept = index.rescored(q, pool.select("q_ord", "g_ord"), 10, FREE).select("q_ord", "g_ord", "pos").collect()
    assert sorted(kept) == sorted(index.search(q, 10, 40, FREE).select("q_ord", "g_ord", "pos").collect())
