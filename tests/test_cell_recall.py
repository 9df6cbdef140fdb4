"""Recall of the registered cell index against brute force."""

import os

import numpy as np
import pytest

from matchbook.operators import ann
from matchbook.operators.similarity import nearest
from matchbook.plans import compressing  # noqa: F401  registers the queries
from matchbook.plans.registry import QUERIES
from matchbook.plans.searching import sides

SF = "/root/testdata/sf0.001"


def pairs(df) -> set:
    return {(r.q_ord, r.g_ord) for r in df.select("q_ord", "g_ord").collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_shortlist_reaches_its_recall(spark):
    exact = pairs(nearest(*sides(spark, SF), 10))
    assert len(exact & pairs(QUERIES["j10_cell_shortlist"](spark, SF))) >= 0.9 * len(exact)


def test_probes_measured_on_some_queries_hold_for_all(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "MEASURED", 100)
    x = np.random.default_rng(1).normal(size=(1100, 24))
    q, g = rows(x[:300]), rows(x[300:], start=300)
    index = ann.CellIndex(g)
    exact = pairs(nearest(q, g, 10))
    assert len(exact & pairs(index.search(q, 10, index.probes_for(q, 10)))) >= 0.9 * len(exact)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_recall_is_measured_on_the_shortlist(spark, monkeypatch):
    """j10_index_recall searches with the very probes of j10_cell_shortlist."""
    seen, search = [], ann.CellIndex.search

    def noted(self, q, k, probes=4, *rest):
        seen.append((k, probes, len(self.units)))
        return search(self, q, k, probes, *rest)

    monkeypatch.setattr(ann.CellIndex, "search", noted)
    QUERIES["j10_cell_shortlist"](spark, SF)
    row = QUERIES["j10_index_recall"](spark, SF).collect()[0]
    assert seen[0] == seen[1] and row.recall_reached and row.scores_exact
