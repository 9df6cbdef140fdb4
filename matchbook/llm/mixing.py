"""Mixing sources to target weights in fixed-length blocks.

The words of a source are laid end to end in a fixed order of its documents and cut into blocks
of BLOCK_WORDS. The mix is a row of slots in shards of SHARD_SLOTS. Every shard draws how many of
its slots each source fills: the whole part of the expected counts, and a multinomial draw for
the rest; more than FAN sources are drawn down a tree, group by group. The i-th slot of a source holds block p(i mod n) of its n blocks, where p is a
pseudorandom permutation of the pass i div n; slots and blocks are then joined by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.base import running_total, shards_for, stored
from matchbook.llm.words import mix

BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 16
#: No source is passed over more often than this.
PASSES = 3
WEIGHTS = (1, 2, 3)
#: Children of a node when slots are drawn, shards that one drawing task serves, sources per task when numbered.
FAN = 4096
SHARDS_EACH = 256
SOURCES_EACH = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"
SEED = 11


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """Per row of ``sources`` (source, source_size): these, number and target (its share of the total size).

    Sources are numbered in code-point order, null last, and take the weights in turn. A share
    stops at ``passes`` times the source's size and the excess goes to the others by weight until
    none is above. The sources stay a table however many they are: a round is one aggregate over
    it, and only the size and weight that are left come to the driver. Comparisons are exact.
    """
    order = F.col("source").asc_nulls_last()
    parts = shards_for(sources.count(), SOURCES_EACH)
    ranged = stored(sources.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "sources-ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order))).join(offsets, "_part")
    numbered = numbered.select("source", "source_size", (F.col("_before") + F.col("_at") - 1).alias("number"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    numbered = stored(numbered.withColumn("_weight", weight.cast("long")).withColumn("_most", F.col("source_size") * passes), "sources-numbered")
    exact = lambda n, digits: (F.lit(n) if isinstance(n, int) else F.col(n)).cast(f"decimal({digits},0)")
    sums = lambda size, rows: tuple(int(x or 0) for x in rows.agg(F.sum(exact(size, 20)), F.sum("_weight")).first())
    total = left = sums("source_size", numbered)
    while True:
        share = exact(left[0], 20) * exact("_weight", 10)
        over = share > exact(left[1], 17) * exact("_most", 20)
        stopped = sums("_most", numbered.filter(over))
        rest = (total[0] - stopped[0], total[1] - stopped[1])
        if rest == left:
            break
        left = rest
    target = F.when(over, F.col("_most").cast("double")).otherwise(share.cast("double") / F.lit(float(left[1] or 1)))
    return numbered.select("source", "source_size", "number", target.alias("target"))


def permuted(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..count-1 per key: a four-round Feistel network, walked until in range."""
    half = np.ones(len(index), np.uint64)
    while True:
        short = (np.uint64(1) << (half * np.uint64(2))) < count.astype(np.uint64)
        if not short.any():
            break
        half += short
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix(right ^ mix(k + np.uint64(turn))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= count[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little")


def _levels(leaves: DataFrame, count: int) -> list[DataFrame]:
    """The sources as a tree of nodes with at most FAN children, the level of the sources first.

    Each level: node and, in the order of the children, child, weight, blocks, name. Weights are
    summed in that order, so they do not depend on partitioning.
    """
    out, below = [], leaves
    while True:
        held = below.groupBy(F.expr(f"number div {FAN}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("number", "weight", "blocks", "name"))).alias("held"))
        level = stored(held.select("node", *[F.col(f"held.{c}").alias(c) for c in ("number", "weight", "blocks", "name")]), "mix-tree")
        out.append(level)
        count = shards_for(count, FAN)
        if count == 1:
            return out
        zero = F.lit(0).cast("long")
        below = level.select(F.col("node").alias("number"), F.aggregate("weight", F.lit(0.0), lambda a, w: a + w).alias("weight"), zero.alias("blocks"), zero.alias("name"))


def _drawn(asked: DataFrame, level: DataFrame, depth: int, seed: int) -> DataFrame:
    """Split the slots of every (shard, number) among the children of that node of ``level``.

    A task holds the children of one node and SHARDS_EACH shards that ask for it.
    """

    def draw(asked: pd.DataFrame, node: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(node):
            number, weight, blocks, name = (np.asarray(node[c].iloc[0]) for c in ("number", "weight", "blocks", "name"))
            share = weight / weight.sum()
            for shard, of, room in asked.sort_values("shard")[["shard", "node", "n"]].itertuples(index=False):
                want = share * room
                n = np.floor(want).astype(np.int64)
                rest = want - n
                if room > n.sum() and rest.sum() > 0:
                    n += np.random.default_rng(_seed(seed, depth, int(shard), int(of))).multinomial(room - n.sum(), rest / rest.sum())
                some = np.flatnonzero(n)
                out.append(pd.DataFrame({"shard": shard, "number": number[some], "n": n[some], "blocks": blocks[some], "name": name[some]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("shard", "number", "n", "blocks", "name")})

    asked = asked.select("shard", F.col("number").alias("node"), "n", F.expr(f"shard div {SHARDS_EACH}").alias("chunk"))
    sent = asked.select(F.col("node").alias("of"), F.col("chunk").alias("part")).distinct().join(level.withColumnRenamed("node", "of"), "of")
    groups = asked.groupBy("node", "chunk").cogroup(sent.groupBy("of", "part"))
    return groups.applyInPandas(draw, "shard long, number long, n long, blocks long, name long")


class Mix:
    """A planned mix: ``rows`` (doc_id, source, size, ... one per document) and its pieces."""

    def __init__(self, docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ()):
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *keep)
        base = stored(base, "mix-rows")
        found = stored(base.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
        self.sources = stored(source_targets(found), "source-targets")
        # Sources come to the rows by way of the bucket totals, so no source's rows meet in one task.
        placed = running_total(base, ["source"], ["doc_id", "size", *keep], {"start": "size"}, base.count(), self.sources)
        self.rows = stored(placed, "mix-placed")
        self.pieces = self._pieces(docs.sparkSession, seed)

    def _pieces(self, spark, seed) -> DataFrame:
        """shard, place, number, pass, start (names the document), from, to (its words)."""
        blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
        # Slots a source should fill, so that its words come to the target although its last block is short.
        weight = F.col("target") * blocks / F.col("source_size")
        leaves = self.sources.filter("target > 0").select("number", weight.alias("weight"), blocks.alias("blocks"), F.xxhash64(F.lit(seed), "source").alias("name"))
        levels = _levels(leaves, self.sources.count())
        top = levels[-1].select(F.aggregate("weight", F.lit(0.0), lambda a, w: a + w)).first()
        total = int(np.ceil(top[0])) if top else 0
        shards, zero = shards_for(total, SHARD_SLOTS), F.lit(0).cast("long")
        drawn = spark.range(0, shards if total else 0).select(F.col("id").alias("shard"), zero.alias("number"), F.least(F.lit(SHARD_SLOTS).cast("long"), F.lit(total) - F.col("id") * SHARD_SLOTS).alias("n"))
        for depth in reversed(range(len(levels))):
            drawn = stored(_drawn(drawn, levels[depth], depth, seed), "mix-draws")
        drawn = running_total(drawn, ["number"], ["shard"], {"first": "n"}, drawn.count())

        def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                inside = batch["slot"] < PASSES * batch["blocks"]  # a draw beyond the last pass stays empty
                batch = batch[inside]
                slot, of, name = batch["slot"].to_numpy(), batch["blocks"].to_numpy(), batch["name"].to_numpy().astype(np.uint64)
                turn = slot // of
                block = permuted(slot % of, of, mix(name + turn.astype(np.uint64)))
                place = mix(name ^ mix(slot.astype(np.uint64))).astype(np.int64)
                yield pd.DataFrame({"shard": batch["shard"], "place": place, "number": batch["number"], "pass": turn.astype(np.int32), "block": block})

        exploded = drawn.repartition(shards_for(total, 1 << 18), "shard", "number").select("shard", "number", "blocks", "name", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
        filled = exploded.mapInPandas(fill, "shard long, place long, number long, pass int, block long")
        last = F.col("start") + F.col("size")
        cut = self.rows.filter("size > 0").select("number", "start", "size", F.explode(F.sequence(F.expr(f"start div {BLOCK_WORDS}"), F.expr(f"(start + size - 1) div {BLOCK_WORDS}"))).alias("block"))
        cut = cut.select("number", "block", "start", (F.greatest(F.col("block") * BLOCK_WORDS, F.col("start")) - F.col("start")).alias("from"),
                         (F.least((F.col("block") + 1) * BLOCK_WORDS, last) - F.col("start")).alias("to"))
        # Both sides are exploded after their sizes were estimated and grow with the data: never broadcast.
        return filled.hint("merge").join(cut, ["number", "block"]).select("shard", "place", "number", "pass", "start", "from", "to")


def mix_sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (words, repeats counted).

    A null text has size 0 and is never taken; a null source is a source, the last one; a null id
    is an id; repeated rows are documents of their own. An empty table gives no rows. The same
    rows give the same result however they are partitioned.
    """
    plan = Mix(docs, seed)
    taken = plan.pieces.groupBy("number", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    rows = plan.rows.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
    taken = taken.withColumnRenamed("start", "key").withColumnRenamed("number", "n")
    return rows.join(taken, (rows["number"] == taken["n"]) & (rows["key"] == taken["key"]), "left").select(
        "doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_texts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: per document and pass, the words taken.

    Where a pass takes a whole text it stays as it is; else the taken words are joined by single
    spaces, and n_chars (if there is such a column) is counted anew. Rows are told apart by the
    SHA-256 digest of all their columns.
    """
    key = F.unhex(F.sha2(F.to_json(F.struct(*[F.col(c) for c in docs.columns])).cast("binary"), 256))
    keyed = docs.withColumn("_key", key)
    plan = Mix(keyed, seed, ("_key",))
    per = plan.pieces.groupBy("number", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("_cuts"))
    named = per.join(plan.rows.filter("size > 0").select("number", "start", "size", "_key"), ["number", "start"]).select("_key", F.col("size").alias("_size"), "_cuts")
    # Rows that share all columns are one text here; their pieces stay apart.
    texts = keyed.groupBy("_key").agg(*[F.first(c).alias(c) for c in docs.columns])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    taken = F.aggregate("_cuts", F.lit(0).cast("long"), lambda a, c: a + c["to"] - c["from"])
    slices = F.flatten(F.transform("_cuts", lambda c: F.slice(F.col("_words"), (c["from"] + 1).cast("int"), (c["to"] - c["from"]).cast("int"))))
    whole = F.col("_taken") == F.col("_size")
    out = texts.join(named, "_key").withColumn("_taken", taken)
    out = out.withColumn("_words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(slices, " ")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
