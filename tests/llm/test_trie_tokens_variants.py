"""Prefix trie, token counts and spelling variants against plain definitions."""

import os
import random
import re
import unicodedata

import brute
import pytest
from pyspark.sql import functions as F

from matchbook.llm import spelling, texts, tokencount, trie
from matchbook.llm.op9 import vocabulary

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, id long, path string, shard int"


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# Prefix trie

def conversations(n=260, seed=3):
    """Shared beginnings, copies, a long conversation, ties, nulls, repeated rows, negative ids."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 8)):
            rows.append((c, t, r.choice(["user", "assistant"]), f"t{r.randrange(3)}"))
    rows += [(1000 + c, t, "user", "same") for c in range(120) for t in range(9)]
    rows += [(5000, t, "user", f"x{t}") for t in range(300)] + [(5100, t, "user", f"x{t}") for t in range(300)]
    rows += [(7, None, "user", "first"), (7, None, None, None), (7, 1, "user", "é\n"), (7, 1, "user", "é\n"), (-7, 0, "user", "a"), (-107, 1, "user", "b"), (-100, 0, "user", "c")]
    rows += [(None, 0, "user", "t1"), (None, 1, "user", "t1"), (9000, 0, "a", "bc"), (9100, 0, "ab", "c")]
    return rows


@pytest.mark.parametrize("per_shard", [20_000, 40, 3])
def test_trie_against_brute_force(spark, per_shard):
    rows = conversations()
    df = spark.createDataFrame([(*row, 1, "x", 2) for row in rows], TURNS).repartition(5)
    same(trie.prefix_trie(df, per_shard).collect(), brute.trie(rows))


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    short = [(c, 0, "user", "t") for c in range(1, 60)]  # no base; most keep no turn
    same(trie.prefix_trie(spark.createDataFrame([(*r, 1, "x", 2) for r in short], TURNS), 5).collect(), brute.trie(short))
    assert [tuple(r)[:4] for r in trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "t", 1, "x", 2)], TURNS)).orderBy("depth").collect()] == [(None, 0, None, 1), (None, 1, None, 1)]


def test_ids_of_a_large_group_travel_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 16)
    rows = [(c, t, "user", f"s{t}") for c in range(0, 30000, 100) for t in range(7)]
    same(trie.prefix_trie(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS), 50).collect(), brute.trie(rows))


def test_the_skeleton_is_bounded():
    long = [(bytes([k % 256]) * trie.DIGEST * 3, k) for k in range(100)]
    s = trie.Skeleton(sorted(long))
    assert len(s.parent) == 1 + 3 * 100 and s.end[0] == len(s.parent)
    assert all(s.parent[i] < i for i in range(1, len(s.parent)))


# Token counts

HARD = ["a<|endoftext|>b \n  c", "<|endoftext|>" * 3, " \t\n ", "​\x85 x\x1c\x1d y\x1f", "漢字 ꟕ १२³ 1²½", "don't WE'LL 's 'S", "", "x" * 5000, "a  b   c  ", " <|endoftext|> ",
        "é \U0001F600 ok", "﻿ab c　 d", "\x00\x7f ", "<|startoftext|>", "ſ İ ß", "á ë", "é" * 900 + " " + "۩" * 30, None]


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_against_the_library(spark, name, monkeypatch):
    path = vocabulary(name)
    count = library(path)
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "null id"), (1, HARD[1])] + [(100 + r[0], r[1]) for r in brute.documents() if r[0] is not None]
    if os.path.isdir(SF):
        rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_tokens int, _text string")
    same(tokencount.token_counts(df, path).collect(), [(i, len((t or "").encode()), count(t), count(t) > 512) for i, t in rows])
    assert tokencount.token_counts(df.limit(0), path).count() == 0


def test_classes_agree_with_the_library():
    cut = tokencount.tokenizer(vocabulary("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    for c in range(tokencount.BEYOND_CHAR):
        text = f"a{chr(c)}1! {chr(c)}{chr(c)} b"
        assert [text[a:b] for _, (a, b) in cut(text)] == tokencount.PATTERN.findall(text), hex(c)


def test_proven_strings_are_single_tokens(spark):
    path = vocabulary("byte_bpe_50k.json")
    proven, count = tokencount.proven_strings(spark, path), library(path)
    assert len(proven) > 40_000 and all(count(s) == 1 for s in random.Random(1).sample(sorted(proven), 2000))
    costs = tokencount.Costs(path, proven)
    assert costs[" the"] == 1 and len(costs) == len(proven)  # no merge for a proven string
    assert costs[" thtionqx"] > 1 and len(costs) == len(proven) + 1


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 3)
    path = vocabulary("byte_bpe_50k.json")
    costs, count = tokencount.Costs(path, frozenset({"the"})), library(path)
    for k in range(20):
        assert costs[f"qzx{k}"[:4]] == count(f"qzx{k}"[:4]) and len(costs) <= 4
    assert costs["the"] == 1


def test_cuts_never_change_the_pieces():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["a", "bc ", " ", "\n", "'s", "1", "!", "\x1d", " ", " d"]) for _ in range(60))
        assert "".join(texts.cuts(text, 5)) == text
        assert [p for part in texts.cuts(text, 5) for p in tokencount.PATTERN.findall(part)] == tokencount.PATTERN.findall(text)
        assert [p for part in texts.cuts(text, 5) for p in re.findall("[a-z]+", part)] == re.findall("[a-z]+", text)


# Spelling variants

def misspelt(seed=2, words=60, docs=300):
    r = random.Random(seed)
    letters = "abcdeéÿ"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 12))) for _ in range(words)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ananan", "nanana", "anananan", "abcdef", "xabcdef", "abcdefx", "abcxdef"]
    vocabulary_ = []
    for w in base:
        vocabulary_ += [w] * 30
        for _ in range(6):
            k = r.randrange(len(w))
            vocabulary_ += [w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]] * r.choice([1, 2])
    out = [(i, " ".join(r.choice(vocabulary_).upper() if r.random() < 0.1 else r.choice(vocabulary_) for _ in range(60))) for i in range(docs)]
    return out + [(None, out[0][1]), (3, out[3][1]), (5001, None), (5002, ""), (5003, "a1b2 ×÷×÷×÷× Été!ÉTÉTÉTÉT " * 9), (5004, "longword" * 4000)] + [(6000 + i, "chainaa " + "chainab " * 8 + "chainbb " * 60) for i in range(6)]


def test_variants_against_brute_force(spark, monkeypatch):
    rows = misspelt()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n int, word string").repartition(4)
    want = brute.variants(rows)
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] not in (w[0], w[1]) for w in want)
    same(spelling.spelling_variants(df).collect(), want)
    monkeypatch.setattr(spelling, "DICTIONARY", 40)  # the threshold rises until 40 grams are left
    monkeypatch.setattr(spelling, "LEAST_THRESHOLD", 1)
    same(spelling.spelling_variants(df).collect(), want)
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_dictionary_is_bounded(spark, monkeypatch):
    words = spelling.word_counts(spark.createDataFrame(misspelt(), "doc_id long, text string"))
    monkeypatch.setattr(spelling, "LEAST_THRESHOLD", 1)
    for most in (10, 100, 1000):
        monkeypatch.setattr(spelling, "DICTIONARY", most)
        assert spelling.frequent_grams(words).count() <= most
    assert spelling.frequent_grams(words).agg(F.max(F.char_length("gram"))).first()[0] <= spelling.LONGEST


def test_some_rare_gram_survives_every_edit():
    r = random.Random(4)
    for _ in range(400):
        frequent = {"".join(r.choice("^ab$") for _ in range(r.randrange(2, 6))): r.randrange(1, 9) for _ in range(r.randrange(40))}
        w = "".join(r.choice("ab") for _ in range(r.randrange(6, 10)))
        k, c = r.randrange(len(w) + 1), r.choice("abc")
        for v in (w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]):
            if v == w or len(v) < 6:
                continue
            a, b = spelling.rare_end(w, frequent), spelling.rare_end(v, frequent)
            left = {(at, g) for at, g in a} & {(at, g) for at, g in b}
            right = {(len(w) - at - len(g), g) for at, g in a} & {(len(v) - at - len(g), g) for at, g in b}
            assert left or right, (w, v, frequent)


def test_letters_of_the_contract():
    assert all(bool(spelling.RUNS.fullmatch(chr(c) * 6)) == (chr(c).isascii() and chr(c).islower() or 0xC0 <= c <= 0xFF) for c in range(0x250))
    assert unicodedata.name("×") == "MULTIPLICATION SIGN" and spelling.RUNS.fullmatch("×" * 6)
