"""Registered queries of the folder against SQL, and the pipeline's stages."""

import importlib.util
import os

import oracle
import pytest
from brute import near, passages, strings, variants

import __spark_entry__ as entry
from matchbook.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    text, _, ok = oracle.compare(spark, oracle.connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, text


@pytest.mark.parametrize("name, brute", [("op2_repeated_strings", strings), ("op7_minhash_near_dedup", near), ("op10_repeated_passages", passages), ("op13_spelling_variants", variants)])
def test_against_brute_force(spark, name, brute):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))


def test_queries_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and set(QUERIES) <= set(entry.queries())


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(k.columns == columns for k in kept[:-1])
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    assert set(ids[1]) <= set(ids[0]) and len(ids[1]) > 0.7 * len(ids[0])
    texts = [" ".join((r.text or "").split()) for r in kept[2].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {" ".join((r.text or "").split()) for r in kept[1].collect()}
    groups = near([(r.doc_id, r.text) for r in kept[2].collect()], 5)
    assert sorted(ids[3]) == sorted(i for i, _, c, _ in groups if i == c)
    assert sorted(set(ids[5])) == sorted(set(ids[4]))
    assert "pipeline" in entry.queries()
