"""Prefix trie of conversations: splitter skeleton and local sorted shards.

A conversation is its *path*, the digests of its turns one after the other. Paths sorted as bytes
put the members of every trie node next to each other. A bounded sample of paths gives splitters
that deal the conversations, sorted by (path, id), to shards. Only nodes on the path of a splitter
can have members in two shards: they form the skeleton, whose trie is broadcast (at most
SHARDS * CUT_TURNS nodes, whatever the data). Each shard is streamed once in sorted order with a
stack of open nodes and finishes every other node alone; for skeleton nodes it passes on partial
aggregates, which a reduction by node adds up, and the skeleton's own subtree sums follow from its
order.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.base import stored

#: Bytes of a turn's digest.
DIGEST = 32
#: Conversations per shard, shards at most, sampled paths per shard, turns of a sampled path kept.
SHARD_CONVS, SHARDS, OVERSAMPLE, CUT_TURNS = 20_000, 8192, 8, 64
#: Ids that end at a skeleton node and travel in one row; rows of one Arrow batch.
CHUNK_IDS, BATCH_ROWS = 1 << 14, 1 << 14
#: Stands for a null id, which comes after all others.
NULL_ID = (1 << 63) - 1
#: Fixed value: the digest of the empty text.
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

OUT = pa.schema([
    ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()),
    ("ends_sha256", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("ids", pa.string())])
ROW = "node int, parent int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, shard int, part int, ids string"


def head_length(conv_id: Column) -> Column:
    """Turns that a conversation takes from its base; a null id is written as the empty text."""
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % 6


def rebuilt(turns: DataFrame) -> DataFrame:
    """id, pos, role, text of the turns of every rebuilt conversation (see :func:`prefix_trie`)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("turn").cast("long").alias("turn"), role, text)
    order = Window.partitionBy("id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.select("id", F.row_number().over(order).cast("long").alias("nth"), "role", "text")
    number = F.when(F.col("id") != NULL_ID, F.col("id"))
    placed = stored(placed.withColumn("h", head_length(number)), "turns")
    ids = placed.groupBy("id").agg(F.first("h").alias("h"), F.count(F.lit(1)).alias("own"))
    base = F.when(F.col("id") != NULL_ID, F.col("id") - F.col("id") % 100)
    # No more than five turns of a base go to each of the ids around it, of which there are fewer than 200.
    heads = placed.filter((F.col("nth") <= 5) & (F.col("id") % 100 == 0) & (F.col("id") != NULL_ID)).select(F.col("id").alias("base"), "nth", "role", "text")
    given = ids.select("id", "h", base.alias("base")).join(heads, "base").filter("nth <= h")
    taken = ids.select(F.col("id").alias("base"), F.col("own").alias("there"))
    sizes = ids.select("id", "h", base.alias("base")).join(taken, "base", "left").select("id", F.least("h", F.coalesce("there", F.lit(0))).alias("given"))
    own = placed.filter("nth > h").join(sizes, "id").select("id", (F.col("nth") - F.col("h") + F.col("given")).alias("pos"), "role", "text")
    return given.select("id", F.col("nth").alias("pos"), "role", "text").unionByName(own)


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """id, path (binary), chars (of each turn): one row per id, also of those without turns.

    A turn's digest covers the length of its role, its role and its text.
    """
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    of = turns.select("id", F.struct("pos", digest.alias("digest"), F.char_length("text").alias("chars")).alias("turn"))
    whole = of.groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    joined = ids.join(whole, "id", "left").withColumn("turns", F.coalesce("turns", F.array().cast("array<struct<pos:long,digest:string,chars:int>>")))
    return joined.select("id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


@dataclass
class Skeleton:
    """Splitters in order, and the trie of their paths: numbers in depth-first order, the root is 0."""

    splitters: list[tuple[bytes, int]]
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    end: list[int] = field(default_factory=list)

    def __post_init__(self):
        for path, _ in self.splitters:  # sorted, so that a new node comes after all that are there
            node = 0
            for at in range(0, len(path), DIGEST):
                turn = path[at : at + DIGEST]
                if (node, turn) not in self.child:
                    self.child[node, turn] = len(self.parent)
                    self.parent.append(node)
                node = self.child[node, turn]
        self.end = [i + 1 for i in range(len(self.parent))]
        for i in range(len(self.parent) - 1, 0, -1):
            self.end[self.parent[i]] = max(self.end[self.parent[i]], self.end[i])

    def shard(self, path: bytes, id_: int) -> int:
        return bisect.bisect_right(self.splitters, (path, id_))


def skeleton(convs: DataFrame, total: int, per_shard: int) -> Skeleton:
    """Splitters at even steps of a sorted sample; results do not depend on which paths are drawn."""
    n = max(1, min(SHARDS, -(-total // per_shard)))
    if n == 1:
        return Skeleton([])
    cut = convs.select(F.substring("path", F.lit(1), F.lit(CUT_TURNS * DIGEST)).alias("path"), "id")
    drawn = sorted((bytes(r.path), r.id) for r in cut.sample(min(1.0, OVERSAMPLE * n / total), seed=11).collect())
    at = sorted({len(drawn) * k // n for k in range(1, n)})
    return Skeleton(sorted({drawn[i] for i in at if i < len(drawn)}))


@dataclass
class Open:
    """A node whose members are still being read."""

    node: int  # number in the skeleton, -1 for a node that this shard finishes
    parent: int
    depth: int
    chars: int
    conv_id: int
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    digest: object = None
    ids: list[str] = field(default_factory=list)
    part: int = 0
    done: list[list] = field(default_factory=list)  # finished children that wait for this node's id


class Shard:
    """One pass over the sorted conversations of a shard."""

    def __init__(self, number: int, trie: Skeleton):
        self.number, self.trie, self.rows = number, trie, []
        self.stack = [Open(0, -1, 0, 0, NULL_ID)]
        self.path = b""

    def add(self, id_: int, path: bytes, chars: list[int]) -> None:
        depth = self._common(path)
        while len(self.stack) > depth + 1:
            self._close()
        for d in range(depth, len(chars)):
            above = self.stack[-1]
            node = self.trie.child.get((above.node, path[d * DIGEST : (d + 1) * DIGEST]), -1) if above.node >= 0 else -1
            self.stack.append(Open(node, above.node, d + 1, chars[d], id_))
        self.path = path
        top = self.stack[-1]
        top.n_convs += 1
        top.conv_id = min(top.conv_id, id_)
        text = "" if id_ == NULL_ID else str(id_)
        if top.node >= 0:
            top.ids.append(text)
            if len(top.ids) == CHUNK_IDS:
                self._chunk(top)
        elif top.digest is None:
            top.digest = hashlib.sha256(text.encode())
        else:
            top.digest.update(f",{text}".encode())

    def finish(self) -> None:
        while self.stack:
            self._close()

    def _common(self, path: bytes) -> int:
        """Turns that ``path`` shares with the path before it."""
        most = min(len(path), len(self.path)) // DIGEST
        if path[: most * DIGEST] == self.path[: most * DIGEST]:
            return most
        low, high = 0, most
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if path[: middle * DIGEST] == self.path[: middle * DIGEST] else (low, middle)
        return low

    def _chunk(self, node: Open) -> None:
        self.rows.append([node.node, node.parent, node.depth, None, None, None, None, None, None, None, None, self.number, node.part, ",".join(node.ids)])
        node.ids, node.part = [], node.part + 1

    def _close(self) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if above is not None:
            above.n_convs += node.n_convs
            above.conv_id = min(above.conv_id, node.conv_id)
        if node.node >= 0:
            if node.ids:
                self._chunk(node)
            self.rows.append([node.node, node.parent, node.depth, node.conv_id, None, node.n_convs, node.n_children, node.n_leaves, node.saved, node.chars, None, self.number, None, None])
            return
        leaves = node.n_leaves or 1
        saved = node.saved + (node.n_convs - 1) * node.chars
        above.n_children, above.n_leaves, above.saved = above.n_children + 1, above.n_leaves + leaves, above.saved + saved
        for row in node.done:
            row[4] = node.conv_id
            self.rows.append(row)
        ends = node.digest.hexdigest() if node.digest is not None else EMPTY_SHA256
        row = [-1, node.parent, node.depth, node.conv_id, None, node.n_convs, node.n_children, leaves, saved, node.chars, ends, self.number, None, None]
        (self.rows if above.node >= 0 else above.done).append(row)


def _rows(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(OUT), OUT.types)], schema=OUT)


def shard_rows(convs: DataFrame, trie) -> DataFrame:
    """Finished nodes (node -1), partial rows of skeleton nodes, and chunks of ids that end there."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [trie.value.shard(p, i) for p, i in zip(batch.column("path").to_pylist(), batch.column("id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.int32())], [*batch.schema.names, "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for number, id_, path, chars in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "path", "chars"))):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.finish()
                        yield _rows(shard.rows)
                    shard = Shard(number, trie.value)
                shard.add(id_, path, chars)
                if len(shard.rows) >= BATCH_ROWS:
                    yield _rows(shard.rows)
                    shard.rows = []
        if shard is not None:
            shard.finish()
            yield _rows(shard.rows)

    n = len(trie.value.splitters) + 1
    dealt = convs.select("id", "path", "chars").mapInArrow(deal, "id long, path binary, chars array<int>, shard int")
    return dealt.repartitionById(n, "shard").sortWithinPartitions("shard", "path", "id").mapInArrow(run, ROW)


def _ends(chunks: DataFrame) -> DataFrame:
    """node, ends_sha256 of skeleton nodes: chunks are hashed one after the other, none are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, ([], [])
        for batch in batches:
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if key == node:
                    digest.update(f",{ids}".encode())
                    continue
                if node is not None:
                    out[0].append(node), out[1].append(digest.hexdigest())
                node, digest = key, hashlib.sha256(ids.encode())
        if node is not None:
            out[0].append(node), out[1].append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string())], ["node", "ends_sha256"])

    return chunks.repartition("node").sortWithinPartitions("node", "shard", "part").select("node", "ids").mapInArrow(run, "node int, ends_sha256 string")


def _skeleton_totals(partial: DataFrame, trie) -> DataFrame:
    """Totals of the skeleton nodes that have members, from their partial rows.

    Partial rows are added by node first; what then meets in one task is at most one row per node
    of the broadcast trie. Numbers are in depth-first order, so a subtree is a range of them.
    """
    each = partial.groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("chars").alias("chars"))

    def totals(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node").reset_index(drop=True)
        node, parent = rows["node"].to_numpy(), rows["parent"].to_numpy()
        place = np.full(len(trie.value.parent) + 1, -1)
        place[node] = np.arange(len(node))
        inner = np.bincount(place[parent[parent >= 0]], minlength=len(node)) if len(node) else np.empty(0, int)
        children = rows["n_children"].to_numpy() + inner
        leaves = rows["n_leaves"].to_numpy() + (children == 0)
        saved = rows["saved_tokens"].to_numpy() + (rows["n_convs"].to_numpy() - 1) * rows["chars"].to_numpy()
        last = np.searchsorted(node, np.asarray(trie.value.end)[node])
        total = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[last] - c[np.arange(len(node))]
        above = rows["conv_id"].to_numpy()[place[np.maximum(parent, 0)]]
        return rows.assign(parent_conv_id=pd.array(np.where(parent >= 0, above, 0), "Int64").astype("Int64"), n_children=children, n_leaves=total(leaves), saved_tokens=total(saved))[
            ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]]

    return each.groupBy(F.lit("all")).applyInPandas(totals, "node int, parent int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")


def prefix_trie(turns: DataFrame, per_shard: int = SHARD_CONVS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn
    (null first), equal ones by role and text, repeated rows are repeated turns, null roles and
    texts are empty. Conversation c is rebuilt as the first h turns of conversation c - c % 100
    (the remainder has the sign of c) and its own turns after its first h.

    Result: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 (of the ids that end there, ascending). Rows
    without an id are one conversation, which takes nothing from others, comes last and is
    written as nothing; as the only member its conv_id is null. An empty table has no nodes.

    A task holds the digests of one conversation and the finished children of open nodes inside
    its shard; copies of a conversation of more than CUT_TURNS turns lie in one shard, which
    streams them.
    """
    spark = turns.sparkSession
    ids = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("id")).distinct()
    convs = stored(paths(rebuilt(turns), ids), "paths")
    trie = spark.sparkContext.broadcast(skeleton(convs, convs.count(), per_shard))
    rows = stored(shard_rows(convs, trie), "nodes")
    # One row per node of the trie at most, which is broadcast itself.
    totals = stored(_skeleton_totals(rows.filter("node >= 0 and n_convs is not null"), trie), "skeleton")
    ends = _ends(rows.filter("ids is not null"))
    columns = ["depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    visible = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    above = F.broadcast(totals.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")))
    local = rows.filter("node = -1").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    upper = totals.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    out = lambda df: df.select(visible("conv_id"), visible("parent_conv_id"), *columns, "ends_sha256")
    return out(local).unionByName(out(upper)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
