"""A graph brought up to date equals one built as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbook.operators import upkeep
from matchbook.operators.graph import build_graph
from matchbook.streaming.ingest import Generations


def edges(df, *columns):
    return {tuple(r[:2]): r[2:] for r in map(tuple, df.select("i", "j", *columns).collect())}


def assert_same(graph, gallery):
    want = build_graph(gallery, graph.k1, graph.k2, graph.plan)
    assert edges(graph.nn, "p", "sim", "d") == edges(want.nn, "p", "sim", "d")
    for got, built in ((graph.before, want.before), (graph.after, want.after)):
        a, b = edges(got, "w"), edges(built, "w")
        assert a.keys() == b.keys() and all(abs(a[k][0] - b[k][0]) < 1e-12 for k in a)


@pytest.mark.parametrize("k1, k2, seed", [(6, 3, 2), (4, 1, 3)])
def test_inserts_deletes_and_new_vectors(rows, k1, k2, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 5))
    x = centres[rng.integers(0, 9, 72)] + 0.5 * rng.normal(size=(72, 5))
    x[20:24] = x[20]  # equal vectors, ranked by ordinal
    g = rows(x, frames=[f"f{i // 2}" for i in range(72)])
    gen = Generations(k1, k2)
    gen.register(g.filter("ord % 8 <> 3 and ord <> 22"))
    gen.insert(g.filter("ord % 8 = 3"))
    assert_same(gen.graph, g.filter("ord <> 22"))
    assert gen.builds == 1 and 0 < gen.touched.lists
    gen.delete("f5#10")
    assert gen.touched.lists < 40
    assert_same(gen.graph, g.filter("ord not in (22, 10)"))
    # One step with rows that come, go and change their vectors.
    changed = g.filter("ord not in (10, 30, 31)").withColumn("emb", F.when(F.col("ord").isin(5, 40), F.reverse("emb")).otherwise(F.col("emb")))
    gen.register(changed)
    assert gen.builds == 1 and gen.touched.lists < 72
    assert_same(gen.graph, changed)


def test_overlays_are_written_out_and_nothing_changes_for_unknown_keys(rows, monkeypatch):
    from matchbook.streaming import ingest

    monkeypatch.setattr(ingest, "OVERLAYS", 2)
    g = rows(np.random.default_rng(5).normal(size=(30, 4)))
    gen = Generations()
    first = gen.register(g)
    assert gen.delete("nothing#1") == first and gen.hits == 1
    for i in (3, 4, 5):
        gen.delete(f"f{i}#{i}")
    assert gen._overlays == 1 and gen.builds == 1
    assert_same(gen.graph, g.filter("ord not in (3, 4, 5)"))


def test_a_gallery_that_becomes_too_sparse_keeps_the_old_generation(rows):
    x = np.random.default_rng(6).normal(size=(11, 4))
    g = rows(x, frames=["a"] * 6 + [f"b{i}" for i in range(5)])
    gen = Generations()
    first = gen.register(g)
    with pytest.raises(ValueError):  # b4 and the six rows of frame a are left with too few
        gen.register(g.filter("ord not in (7, 8, 9)").unionByName(rows(x[:2], frames=["a", "a"], start=90)))
    assert gen.generation == first and gen.graph is not None
    assert upkeep.OVERLAYS > 1
