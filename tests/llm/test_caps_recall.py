"""Recall of the spherical-cap filters at every table size and dimension."""

import math

import numpy as np
import pytest

from matchbook.llm import caps


@pytest.mark.parametrize("dim, vectors", [(64, 51_000), (64, 3_000_000), (512, 1_000_000)])
def test_filters_hold_their_recall_as_the_table_grows(dim, vectors):
    """Pairs at cosine 0.9 share a filter of the codes for 51,000 vectors and for 60 times as many."""
    rng = np.random.default_rng(3)
    x, off = rng.normal(size=(2, 500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(0.19) * off / np.linalg.norm(off, axis=1, keepdims=True)
    met = set()
    if hasattr(caps, "heights"):
        codes = [caps.Code(dim, vectors, i, h) for i, h in enumerate(caps.heights(dim, vectors))]
    else:  # as it was: a fixed number of codes
        codes = [caps.Code(dim, vectors, i) for i in range(caps.CODES)]
    for code in codes:
        (i, f), (j, g) = code.decode(x), code.decode(y)
        met |= {r for r, _ in set(zip(i.tolist(), f.tolist())) & set(zip(j.tolist(), g.tolist()))}
    assert len(met) >= 0.998 * len(x)


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_few_coordinates(spark, dim):
    """In few coordinates no direction lies far out; brute force over 700 vectors."""
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(700, dim))
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: int(n) for i, n in enumerate(links)}
