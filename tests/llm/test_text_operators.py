"""Operators on documents against brute force, on texts with all the awkward cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from brute import DOCS, documents, near, passages, strings

from matchbook.llm import exact, minhash, substrings, suffixes


def pairs():
    return [(r[0], r[1]) for r in documents()]


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_passages(docs, empty, monkeypatch):
    pick = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = substrings.remove_repeats(docs)
    assert sorted_rows(got.select(*pick).collect()) == sorted_rows(passages(pairs()))
    monkeypatch.setattr(substrings, "COMMON", 0)  # every anchor by aggregation
    monkeypatch.setattr(substrings, "SHARD_ROWS", 2)  # shards of several tasks,
    monkeypatch.setattr(substrings, "PASSAGE_BYTES", 400)  # and of several automata
    assert sorted_rows(substrings.remove_repeats(docs).select(*pick).collect()) == sorted_rows(passages(pairs()))
    assert substrings.remove_repeats(empty).count() == 0


def test_automaton_finds_every_occurrence(monkeypatch):
    monkeypatch.setattr(substrings, "WINDOW", 2)
    shard = substrings.Passages([b"a b a", b"a b"], [7, 5])
    assert [x.tolist() for x in shard.locate(b"a b a b c")] == [[0, 1, 2], [5, 7, 5]]
    assert [x.tolist() for x in shard.locate(b"ab a")] == [[], []]
    assert [x.tolist() for x in substrings.Passages([], []).locate(b"a b")] == [[], []]


def test_only_hits_of_the_automaton_are_removed():
    """What the hashes propose is not enough: stretches and passages of equal anchors but other words give nothing."""
    w = [f"w{i}".encode() for i in range(60)]
    stretch = pd.DataFrame({"id": [9], "seq": [0], "lo": [[0]], "text": [b" ".join(w)]})
    passage = lambda words: pd.DataFrame({"least": [1], "passage": [b" ".join(words)]})
    assert substrings._locate(stretch, passage(w[5:57]))[["from", "to"]].values.tolist() == [[5, 57]]
    assert not len(substrings._locate(stretch, passage(w[5:30] + [b"x"] + w[31:57])))
    assert not len(substrings._locate(stretch, passage(w[5:57]).assign(least=9)))


def test_strings(docs, empty, monkeypatch):
    pick = ["doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256"]
    assert sorted_rows(suffixes.remove_repeated_bytes(docs).selectExpr(*pick).collect()) == sorted_rows(strings(pairs()))
    monkeypatch.setattr(suffixes, "COMMON", 1)
    assert sorted_rows(suffixes.remove_repeated_bytes(docs).selectExpr(*pick).collect()) == sorted_rows(strings(pairs()))
    assert suffixes.remove_repeated_bytes(empty).count() == 0


def test_interval_expansion_against_counting():
    rng = np.random.default_rng(0)
    for _ in range(150):
        m = int(rng.integers(1, 9))
        texts = [rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 40)), dtype=np.uint8).tobytes() for _ in range(int(rng.integers(1, 6)))]
        count = Counter(t[s : s + m] for t in texts for s in range(len(t) - m + 1))
        want = [[s for s in range(len(t) - m + 1) if count[t[s : s + m]] > 1] for t in texts]
        assert [g.tolist() for g in suffixes.repeated_starts(texts, m)] == want


def test_near_duplicates(docs, empty):
    got = minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted_rows(got) == sorted_rows((i, n, c, k) for i, n, c, k in near(pairs()))
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_keep_one_of_each_group(docs):
    left = minhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} >= {1, 5, 6, 7, 8} and not {2, 4, 14} & {r.doc_id for r in left.collect()}


def test_shingle_length_is_an_argument(spark):
    """One edit in 43 words: 0.82 on shingles of four words, 0.77 on those of five."""
    base = [f"w{i}" for i in range(43)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:20] + ["x"] + base[21:])), (3, "a b c d"), (4, "a b c d e")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (4, 5):
        got = minhash.near_duplicates(table, length=length).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted_rows(got) == sorted_rows(near(rows, length))
    assert {r.doc_id for r in minhash.drop_near_copies(table).collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in minhash.drop_near_copies(table, length=4).collect()} == {1, 3, 4}


def exact_rows(rows):
    text = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(text(t), []).append(i)
    seen, out = set(), []
    for i, t in rows:
        ids = [x for x in groups[text(t)] if x is not None]
        keep = min(ids) if ids else None
        first = (text(t), i) not in seen
        seen.add((text(t), i))
        out.append((i, keep, len(groups[text(t)]), i == keep and first, hashlib.sha256(text(t).encode()).hexdigest()))
    return out


def test_exact(docs, empty):
    assert sorted_rows(exact.exact_dedup(docs).collect()) == sorted_rows(exact_rows(pairs()))
    assert exact.exact_dedup(empty).count() == 0
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == sum(r[3] for r in exact_rows(pairs()))


def test_exact_against_given_history(spark, docs):
    digest = hashlib.sha256(b"one two three").digest()
    history = spark.createDataFrame([(bytearray(digest), -5, 3)], "digest binary, winner long, n long")
    got = {r.doc_id: r for r in exact.exact_dedup(docs, history=history).collect()}
    assert (got[11].keep_id, got[11].group_size, got[11].kept) == (-5, 4, False)
    assert got[12].keep_id == 12 and got[12].kept


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        words = rng.integers(0, 2**63, (n, 4)).astype("<u8")
        levels, slot = exact.build(words)
        assert sorted(slot.tolist()) == list(range(n))
        assert (exact.find(words, levels) == slot).all()
