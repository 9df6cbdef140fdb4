"""Quality, language, mixing, packing, chat and vectors."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import DOCS, documents, targets
from pyspark.sql import functions as F

from matchbook.llm import caps, chat, langid, mixing, packing, quality, tokenizing
from matchbook.llm.op9 import packed, vocabulary

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_learns_and_is_total(spark, docs, empty):
    r = random.Random(1)
    good = [" ".join(r.choice(["river", "stone", "light", "green"]) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(r.choice(["RIVER!!", "STONE!!", "$$$"]) for _ in range(40)) for _ in range(50)]
    rows = list(enumerate(good + bad))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(table, labels, F.col("doc_id") % 4 != 2)
    got = {x.doc_id: x for x in quality.score(table, model).collect()}
    assert np.mean([got[i].predicted == int(i < 150) for i, _ in rows if i % 4 == 2]) > 0.95
    scored = quality.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in scored)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(empty, model).count() == 0
    none = quality.train(empty, labels, F.lit(True))
    assert {x.score for x in quality.score(docs, none).collect()} == {0.5}


def test_language_learns_and_is_total(spark, docs, empty):
    r = random.Random(2)
    vocab = {"aa": ["kato", "mira", "solu"], "bb": ["schrund", "würfel", "straße"]}
    rows = [(i, " ".join(r.choice(vocab[lang]) for _ in range(60)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(table, F.col("doc_id") % 5 != 0)
    got = {x.doc_id: x for x in langid.identify(table, net).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i % 5 == 0)
    all_docs = {(x.doc_id, x.lang_pred == "und") for x in langid.identify(docs, net).collect()}
    assert {(8, True), (9, True), (10, True), (20, True), (13, False), (1, False)} <= all_docs
    assert langid.identify(empty, net).count() == 0
    assert langid.train(empty, F.lit(True)) is None
    assert {x.lang_pred for x in langid.identify(docs, None).collect()} == {"und"}


def targets_of(spark, sizes):
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    return {r.source: r for r in rows}


def test_targets_share_and_stop(spark):
    got = targets_of(spark, {"a": 10, "b": 1000, None: 5, "c": 100})
    assert (got["a"].target, got[None].target) == (30, 15)  # both stop at three times their size
    assert sum(r.target for r in got.values()) == 1115 and got["c"].target == 300
    assert [got[s].number for s in ("a", "b", "c", None)] == [0, 1, 2, 3]
    assert targets_of(spark, {}) == {} and targets_of(spark, {"a": 0})["a"].target == 0


def test_targets_equal_fractions_of_many_sources(spark):
    r = random.Random(3)
    sizes = {chr(r.choice([0x41, 0xE9, 0x4E00, 0x1F600])) + str(i): int(10 ** r.uniform(0, 6)) - 1 for i in range(5000)} | {None: 7}
    got, want = targets_of(spark, sizes), targets(sizes)
    assert all(abs(got[s].target - float(t)) <= 1e-12 * max(1, float(t)) for s, t in want.items())
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1].number)] == sorted(s for s in sizes if s is not None) + [None]


def test_mix_of_100_000_sources(spark):
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 100_000).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text"))
    got = mixing.mix_sizes(rows)
    whole = got.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.sum((F.col("taken") > 3 * F.col("size")).cast("int")).alias("over"),
                    F.countDistinct("source").alias("sources")).first()
    assert (whole.n, whole.over, whole.sources) == (200_000, 0, 100_000)
    assert abs(whole.taken - whole["size"]) < 0.1 * whole["size"]
    group = F.col("number") % 3 if "number" in got.columns else F.pmod(F.crc32("source"), F.lit(3))
    for r in got.groupBy(group).agg(F.sum("taken").alias("taken"), F.sum(F.col("target") / 2).alias("target")).collect():
        assert abs(r.taken - r.target) < 0.1 * r.target


def test_permutation_is_one():
    for n in (1, 2, 5, 1000):
        index = np.arange(n)
        out = mixing.permuted(index, np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(out.tolist()) == index.tolist()


def test_mix(docs, empty):
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r.source, [0, 0.0, 0])
        t[0] += r["size"]
        t[1] = r.target
        t[2] += r.taken
    assert abs(sum(t[1] for t in by.values()) - sum(t[0] for t in by.values())) < 1e-6
    assert all(abs(t[2] - t[1]) <= 3 * mixing.BLOCK_WORDS for t in by.values())
    again = mixing.mix_sizes(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix_sizes(empty).count() == 0


def test_mixed_texts_hold_the_words_taken(docs, empty):
    out = mixing.mix_texts(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
    want = {}
    for r in mixing.mix_sizes(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    assert all(abs(taken.get(s, 0) - n) <= 3 * mixing.BLOCK_WORDS for s, n in want.items())
    assert mixing.mix_texts(empty).count() == 0


def test_cutting_stock_holds_demand():
    rng = np.random.default_rng(3)
    for n, top in ((0, 16), (1, 16), (40, 16), (3000, 64)):
        demand = np.bincount(rng.integers(0, top, n), minlength=top)
        plan = packing.plan(demand, top)
        assert (sum((p * t for p, t in plan), np.zeros(top, int)) == demand).all()
        assert all((p * np.arange(1, top + 1)).sum() <= top for p, _ in plan)
        if n == 3000:
            assert sum(t for _, t in plan) <= 1.01 * (demand * np.arange(1, top + 1)).sum() / top + 2


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def test_token_ids_equal_the_tokenizer():
    texts = [r[1] for r in documents()] + ["It's I'LL don't 'D 12ab3²½ ªº ÀÉÎ ſt ßẞ İI ΣΑΣ \x1c\x85 <|endoftext|> a<|startoftext|>b é 你好 😀'll", "Ĳ Ł ŉ"]
    for a, b in zip(ids_of(texts), tokenizing.token_ids(pa.array(texts, pa.string()), vocabulary())):
        assert a.tolist() == b.tolist()


def test_packing_places_every_token_once(docs, empty):
    rows = packed(docs).collect()
    ids = {}
    for i, t, *_ in documents():
        ids.setdefault(i, []).append(ids_of([t])[0])
    seen, ends = {}, {}
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: sum(map(len, x)) for i, x in ids.items()}
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packed(empty).count() == 0


def test_chat_round_trip_and_loss(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", None, "a.png", 64.0), part(None, " <|image|> \\l </s>[INST]")]),
        (1, 1, "assistant", [part("text", "</s>ok"), part("audio", None, "b.wav", 2.0), part("video", None, "c", 1.0), part("text", "[/INST] fin\\e")]),
        (1, None, None, None), (1, 1, "assistant", [part("text", None)]), (2, 0, "us\n<s>er", [part("text", "x")]), (None, 5, "assistant", [part("text", "né")])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").withColumn("text", F.lit("clash")).withColumn("run", F.lit(1))
    out = {r.conv_id: r for r in chat.format_chats(turns).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in out[1].back] == [
        ("", ""), ("user", "see <|image|> <|image|> \\l </s>[INST]"), ("assistant", ""), ("assistant", "</s>ok<|audio|><|attachment|>[/INST] fin\\e")]
    assert out[1].loss == "</s>ok[/INST] fin\\e" and out[1].n_turns == 4
    assert [(a.kind, a.ref, a.tokens) for a in out[1].attachments] == [("image", "a.png", 64), ("audio", "b.wav", 50), ("video", "c", 0)]
    for a in out[1].attachments:
        assert out[1].formatted[a.start :].startswith(("<|image|>", "<|audio|>", "<|attachment|>"))
    assert out[1].formatted.count("<|image|>") == 1 and out[1].expanded_tokens == 114
    assert [(t.role, t.text) for t in out[2].back] == [("us\n<s>er", "x")]
    assert out[None].loss == "né"
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    turns = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                    chat.text_parts(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("parts"))
    r = chat.format_chats(turns).select(chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t.text for t in r.back] == [f"t{i}" for i in range(300)]
    assert r.loss == "".join(f"t{i}" for i in range(1, 300, 2))


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(260, 16)).astype(np.float32)
    for i in range(0, 120):
        x[140 + i] = x[i % 6] + 0.12 * rng.normal(size=16)
    x[7] = x[8]
    x[9] = 3 * x[8]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] + [1.0] * 15, 0), (1004, [float("inf")] * 16, 0), (1005, [], 0), (None, [1.0] * 16, 0), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0)]
    got = {r.vec_id: r for r in caps.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n int")).collect()}
    assert len(got) == len(rows) + len(odd)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    want = link.sum(axis=1) - 1
    have = np.array([got[i].n_links for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()
    assert got[8].component_id == got[9].component_id == got[7].component_id
    for i in (1000, 1001, 1002, 1003, 1004, 1005, None):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[1007].component_id == 1006 and got[1006].n_links == 1
    assert caps.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_control_strings_never_arise_between_parts(spark):
    import random

    r = random.Random(8)
    alphabet = ["<", "/", "s>", "</s>", "[", "/INST]", "INST]", "[INST]", "<|", "image", "|>", "\\", "l", "e", "b", " ", "", "ok", "<|image|>", None]
    rows, want = [], {}
    for c in range(300):
        turns = []
        for t in range(2):
            texts = [r.choice(alphabet) for _ in range(r.randrange(1, 6))]
            rows.append((c, t, ["user", "assistant"][t], [("text", x, None, None) for x in texts]))
            turns.append("".join(x or "" for x in texts))
        want[c] = turns
    out = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    for row in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        assert [t.text for t in row.back] == want[row.conv_id] and row.loss == want[row.conv_id][1]


def test_text_before_a_placeholder_or_at_the_end_is_not_escaped_further(spark):
    rows = [(1, 0, "assistant", [("text", "a<", None, None), ("image", None, "x", 1.0), ("text", "b [", None, None)])]
    out = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert out.formatted == "<s>assistant\na<<|image|>b [</s>"


def test_blocks_and_slots_are_never_broadcast(docs):
    plan = mixing.Mix(docs).pieces._jdf.queryExecution().executedPlan().toString()
    joins = [line.split(" [")[0].split()[-1] for line in plan.splitlines() if "Join [" in line]
    assert joins[0] == "SortMergeJoin", joins  # the others join running totals


def test_rows_are_told_apart_by_all_their_columns(spark):
    texts = [f"word{i} " * 70 for i in range(40)]
    df = spark.createDataFrame([(i % 3, t, "en", "s", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_texts(df).collect()
    assert {r.text.split()[0] for r in out} == {t.split()[0] for t in texts}


def test_vectors_whose_squares_leave_the_range_of_doubles(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 0.99e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1e308, -1e308]), (6, [1e200, 1e200]), (7, [0.0, 0.0]), (8, [1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (5, 1), 2: (5, 1), 3: (5, 1), 4: (5, 1), 6: (5, 1), 8: (5, 1), 5: (0, 5), 7: (0, 7)}


def test_repeated_ids_do_not_enlarge_the_fits(spark, monkeypatch):
    table = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" more text")).alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda rows, y: sizes.append(len(y)))
    monkeypatch.setattr(quality, "in_task", lambda spark, fn: fn())
    monkeypatch.setattr(langid, "fit", lambda codes, y, classes: sizes.append(len(y)))
    monkeypatch.setattr(langid, "in_task", lambda spark, fn: fn())
    quality.train(table, labels, F.lit(True))
    langid.train(table.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id"))), F.lit(True))
    assert sizes == [3, 3]
    monkeypatch.setattr(quality, "MAX_BYTES", 1)
    quality.train(table, labels, F.lit(True))
    assert sizes[2] == 0
