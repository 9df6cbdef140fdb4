"""Near-duplicate documents by MinHash with tensored tables.

A table key joins one of GROUPS left groups with one of GROUPS right groups, each of two minima,
so GROUPS**2 tables need 4 * GROUPS minima instead of 4 * GROUPS**2. Documents that meet in a
table are candidates; a link is confirmed on the full shingle sets.

Documents with equal sets are one node. In two rounds every node is compared with one hub: a
node that meets many others and that it meets in most buckets, in the second round one of another
component. That is
one comparison per node and joins almost all of a group of near copies. What is left are buckets
whose nodes are still in different components. There a node's shingles that no other such node has
bound every similarity it can reach; nodes and pairs whose bound is too low are left out, all
others across components are compared on their full sets, block by block and without rows per pair. So no link between components is missed
inside a bucket, and a group of near copies does not make all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.base import shards_for, stored
from matchbook.llm.links import components
from matchbook.llm.words import LOWER, grams, hashes, mix, rounds, spans, window_starts

#: Words of a shingle: of the whole-table query, and of a stage that drops near copies.
SHINGLE = 4
STAGE_SHINGLE = 5
GROUPS = 10
PERCENT = 80
#: Nodes of a block in the comparison of open buckets.
TILE_NODES = 1024
_MULS = [int(x) | 1 for x in np.random.default_rng(77).integers(1 << 32, 1 << 63, 4 * GROUPS)]


def shingles(data: np.ndarray, offsets: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within the row, and where each row's begin."""
    data = LOWER[data]
    starts, ends, first = spans(data, offsets)
    h = hashes(data, starts, ends)
    counts = np.diff(first)
    at, row = window_starts(first, length)
    few = np.flatnonzero((counts > 0) & (counts < length))
    value = np.concatenate([grams(h, at, length), grams(h, first[few], counts[few])])
    row = np.concatenate([row, few])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(offsets)))


def _per_row(ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``ufunc`` over every row's values; rows must not be empty."""
    return ufunc.reduceat(values, first[:-1])


def _signatures(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "d1", "d2", "keys"]
    for batch in batches:
        for begin, end, data, offsets in rounds(batch.column("text")):
            value, first = shingles(data, offsets, length)
            size = np.diff(first)
            some = np.flatnonzero(size)
            d = np.zeros((2, end - begin), np.uint64)
            keys = np.zeros((end - begin, 2 * GROUPS), np.uint64)
            if len(some):
                bounds = np.append(first[:-1][some], len(value))
                d[0, some] = _per_row(np.add, mix(value), bounds)
                d[1, some] = _per_row(np.add, mix(value ^ np.uint64(0x9E3779B97F4A7C15)), bounds)
                for k in range(2 * GROUPS):
                    pair = []
                    for mul in _MULS[2 * k : 2 * k + 2]:
                        v = value * np.uint64(mul)
                        v ^= v >> np.uint64(32)
                        pair.append(_per_row(np.minimum, v * np.uint64(0xD6E8FEB86659FD93), bounds))
                    keys[some, k] = mix(pair[0] + mix(pair[1] + np.uint64(k)))
            flat = pa.array(keys.ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(begin, end - begin), pa.array(size), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * GROUPS, dtype=np.int32)), flat)], names)


def _sets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, offsets in rounds(batch.column("text")):
            value, first = shingles(data, offsets, length)
            yield pa.RecordBatch.from_arrays([
                batch.column("node").slice(begin, end - begin),
                pa.array([value[a:b].astype("<u8").tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["node", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            linked.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        keep = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return stored(two.select("a", "b", "sa", "sb").mapInArrow(_confirm, "a long, b long"), "near-links")


def _with_popularity(members: DataFrame) -> DataFrame:
    """Add ``met``: how many bucket mates a node has over all its buckets."""
    size = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "bucket-sizes")
    met = stored(members.join(size, "key").groupBy("node").agg(F.sum("size").alias("met")), "met")
    return stored(members.join(met, "node"), "members")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets whose nodes are in different components, with their component."""
    joined = members.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return stored(_spanning(stored(joined, "placed")), "open")


def _spanning(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter(F.col("lo") < F.col("hi"))
    return rows.join(stored(per.select("key"), "apart"), "key")


def _hubs(rows: DataFrame) -> DataFrame:
    """One pair (a, b) per node: the hub that it meets in most buckets, of those in other components.

    The hub of a bucket is the node that meets most others over all buckets.
    """
    hub = stored(rows.groupBy("key").agg(F.max(F.struct("met", "node", "component")).alias("hub")), "hubs")
    other = rows.join(hub, "key").filter(F.col("hub.component") != F.col("component"))
    often = other.groupBy("node", F.col("hub.node").alias("a")).agg(F.count(F.lit(1)).alias("times"), F.max("hub.met").alias("met"))
    return often.groupBy("node").agg(F.max(F.struct("times", "met", "a")).alias("best")).select("best.a", F.col("node").alias("b"))


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(s.as_buffer(), "<i8") for s in batch.column("shingles")]
        node = np.repeat(batch.column("node").to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["node", "shingle"])


def _able(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of open buckets that can reach a node of another component there: key, node, n, component, shared.

    With ``own`` shingles that no other node here has, at most n - own are shared, so against a
    node of m shingles at most min(n - own, m) / (own + m) is reached.
    """
    here = sets.join(rows.select("node").distinct(), "node")
    each = here.mapInArrow(_each_shingle, "node long, shingle long")
    own = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).filter("times = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    known = rows.join(stored(own, "own-shingles"), "node", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0)))
    known = stored(known.select("key", "node", "n", "component", "shared"), "bounded")
    least = stored(known.groupBy("key").agg(F.min("n").alias("least")), "least-sizes")
    able = known.join(least, "key").filter(100 * F.col("shared") >= PERCENT * (F.col("n") - F.col("shared") + F.greatest("least", "shared")))
    return stored(_spanning(stored(able.drop("least"), "able")), "able")


def _tile_links(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of two blocks: those that share a bucket, lie in different components and reach the bound."""
    cand = np.zeros((len(left), len(right)), bool)
    at: dict[int, list[int]] = {}
    for j, keys in enumerate(right["keys"]):
        for k in keys:
            at.setdefault(k, []).append(j)
    for i, keys in enumerate(left["keys"]):
        for k in keys:
            if k in at:
                cand[i, at[k]] = True
    column = lambda t, c: t[c].to_numpy()
    n, m = column(left, "n")[:, None], column(right, "n")[None, :]
    most = np.minimum(column(left, "shared")[:, None], column(right, "shared")[None, :])
    cand &= (column(left, "component")[:, None] != column(right, "component")[None, :]) & (100 * most >= PERCENT * (n + m - most))
    if same:
        cand &= column(left, "node")[:, None] < column(right, "node")[None, :]
    found: tuple[list, list] = ([], [])
    sets = [[np.frombuffer(x, "<u8") for x in t["shingles"]] for t in (left, right)]
    codes = np.unique(np.concatenate(sets[1])) if len(sets[1]) else np.empty(0, "<u8")
    size = np.array([len(x) for x in sets[1]], np.int64)
    flat = np.searchsorted(codes, np.concatenate(sets[1]))
    for i in np.flatnonzero(cand.any(axis=1)):
        here = np.zeros(len(codes) + 1, np.int64)
        place = np.searchsorted(codes, sets[0][i])
        hit = place[(place < len(codes)) & (codes[np.minimum(place, len(codes) - 1)] == sets[0][i])]
        here[hit] = 1
        both = np.add.reduceat(here[flat], np.cumsum(size) - size)
        linked = np.flatnonzero(cand[i] & (100 * both >= PERCENT * (len(sets[0][i]) + size - both)))
        found[0].extend([column(left, "node")[i]] * len(linked))
        found[1].extend(column(right, "node")[linked])
    return np.array(found[0], np.int64), np.array(found[1], np.int64)


def _compare_tiles(rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, part in rows.groupby("tile", sort=False):
        same = (part["side"] == 2).any()
        left, right = (part, part) if same else (part[part["side"] == 0], part[part["side"] == 1])
        if len(left) and len(right):
            out.append(_tile_links(left, right, bool(same)))
    a, b = (np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in (0, 1))
    return pd.DataFrame({"a": a, "b": b})


def _links_across(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """All links (a, b) across the components of a bucket.

    Nodes are laid in blocks of about TILE_NODES by the least node that they meet in most buckets.
    Two blocks that share a bucket are compared in one task, which emits links only; a node's set
    is sent once per such pair of blocks.
    """
    able = _able(rows, sets)
    lead = stored(able.groupBy("key").agg(F.min("node").alias("lead")), "leads")
    often = able.join(lead, "key").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("times"))
    home = often.groupBy("node").agg(F.max(F.struct("times", -F.col("lead"), "lead")).alias("best")).select("node", "best.lead")
    home = stored(home, "homes")
    parts = stored(home.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / TILE_NODES).alias("parts")), "home-sizes")
    home = home.join(parts, "lead").select("node", F.xxhash64("lead", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    home = stored(home, "blocks")
    first = lambda c: F.first(c).alias(c)
    nodes = able.groupBy("node").agg(first("n"), first("component"), first("shared"), F.collect_set("key").alias("keys"))
    nodes = stored(nodes.join(home, "node").join(sets, "node"), "block-nodes")
    touched = stored(able.join(home, "node").select("key", "block").distinct(), "bucket-blocks")
    tiles = touched.select("key", F.col("block").alias("x")).join(touched.select("key", F.col("block").alias("y")), "key").filter("x <= y").select("x", "y").distinct()
    tiles = stored(tiles.withColumn("tile", F.xxhash64("x", "y")), "tiles")
    columns = ["node", "n", "component", "shared", "keys", "shingles"]
    sent = nodes.join(tiles, nodes["block"] == tiles["x"]).select(*columns, "tile", F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side")).unionByName(
        nodes.join(tiles.filter("x <> y"), nodes["block"] == tiles["y"]).select(*columns, "tile", F.lit(1).alias("side")))
    # Rows as sent, a block once per tile: a group holds about a tile however many blocks a bucket has.
    sizes = home.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    sides = tiles.select(F.col("x").alias("block")).unionByName(tiles.filter("x <> y").select(F.col("y").alias("block")))
    shards = shards_for(sides.join(sizes, "block").agg(F.sum("rows")).first()[0] or 0, TILE_NODES)
    return sent.withColumn("shard", F.pmod("tile", F.lit(shards))).groupBy("shard").applyInPandas(_compare_tiles, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; shingles have ``length`` words.

    Empty and null texts have no shingles and are linked with nothing. A null id takes the least
    id of the documents with the same set (null if none has one) and is never kept beside one.
    Rows that share an id are one node. Repeated rows repeat; other columns are ignored; an empty
    table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(texts.mapInArrow(lambda batches: _signatures(batches, length), "doc_id long, n long, d1 long, d2 long, keys array<long>"), "signatures")
    same = ["n", "d1", "d2"]
    groups = stored(rows.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "shingle-sets")
    nodes = groups.filter(F.col("node").isNotNull())
    left = F.posexplode(F.slice("keys", 1, GROUPS)).alias("i", "x")
    right = F.posexplode(F.slice("keys", GROUPS + 1, GROUPS)).alias("j", "y")
    table = nodes.select("node", "keys", "n", left).select("node", "n", "i", "x", right).select("node", F.col("n").cast("int").alias("n"), F.xxhash64("i", "j", "x", "y").alias("key"))
    met = table.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter(F.col("first") < F.col("last"))
    members = _with_popularity(stored(table.join(stored(met, "buckets"), "key").select("key", "node", "n"), "members"))
    wanted = members.select("node").distinct()
    held = texts.withColumnRenamed("doc_id", "node").join(wanted, "node")
    sets = stored(held.mapInArrow(lambda batches: _sets(batches, length), "node long, shingles binary").distinct(), "sets")
    links = _confirmed(_hubs(members.withColumn("component", F.col("node"))), sets)
    links = stored(links.unionByName(_confirmed(_hubs(_open(members, links)), sets)), "near-links")
    links = stored(links.unionByName(_links_across(_open(members, links), sets)), "near-links")
    found = components(links).withColumnRenamed("node", "own")
    named = stored(groups.select(*same, F.col("node").alias("rep")).join(found, F.col("rep") == F.col("own"), "left").select(
        *same, F.coalesce("component", "rep").alias("component_id")), "components")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", *same).join(named, same, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = STAGE_SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, of the document that stays in each group."""
    keep = near_duplicates(docs, id_col, text_col, length).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(keep, docs[id_col].cast("long").eqNullSafe(keep["_kept"]), "left_semi")
