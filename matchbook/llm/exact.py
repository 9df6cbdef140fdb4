"""Exact deduplication against a minimal perfect hash over the digests seen before.

History (digest, winner, count) is cut into shards by digest. Each shard gets a minimal perfect
hash of its own: levels of bit arrays, a digest belongs to the first level where no other digest
of that level shares its bit, and its slot is the number of bits set before. A slot holds the
full 32-byte digest and the winner's id, so a lookup compares all bytes and a digest that is not
in history can never pass for one that is. Members take history's winner; all others are grouped
among themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.base import shards_for, stored

SHARD_DIGESTS = 1 << 16
SPACES = r"[\x20\x09-\x0D]+"
TABLE = "shard long, sizes array<long>, bits binary, digests binary, winners array<long>, counts array<long>"


def normalised(text: Column) -> Column:
    """Null is empty; every run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each digest in the bit array of a level."""
    with np.errstate(over="ignore"):
        x = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays per level, and the slot of every digest (distinct rows of four words)."""
    left, levels, slot, used = np.arange(len(words)), [], np.empty(len(words), np.int64), 0
    while len(left):
        size = max(64, 2 * len(left))
        at = _place(words[left], len(levels), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        slot[left[alone]] = used + np.cumsum(bits)[at[alone]] - 1
        used += int(alone.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, slot


def find(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot that each digest would have; -1 where no level holds it."""
    slot, left, used = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        at = _place(words[left], k, len(bits))
        hit = bits[at]
        slot[left[hit]] = used + np.cumsum(bits)[at[hit]] - 1
        used += int(bits.sum())
        left = left[~hit]
    return slot


def _build_shard(key, rows: pd.DataFrame) -> pd.DataFrame:
    words = _words(rows["digest"])
    levels, slot = build(words)
    order = np.argsort(slot)
    return pd.DataFrame({
        "shard": [key[0]], "sizes": [[len(b) for b in levels]], "bits": [np.packbits(np.concatenate(levels)).tobytes()],
        "digests": [words[order].tobytes()], "winners": [rows["winner"].to_numpy()[order]], "counts": [rows["n"].to_numpy()[order]]})


def _look_up(key, rows: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    words = _words(rows["digest"]) if len(rows) else np.empty((0, 4), "<u8")
    winner, member = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    if len(shard) and len(rows):
        s = shard.iloc[0]
        sizes = np.asarray(s["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(s["bits"], np.uint8))[: sizes.sum()].astype(bool)
        slot = find(words, np.split(bits, np.cumsum(sizes)[:-1]))
        held = np.frombuffer(s["digests"], "<u8").reshape(-1, 4)
        member = (slot >= 0) & (held[slot] == words).all(axis=1)
        winner[member] = np.asarray(s["winners"], np.int64)[slot[member]]
    return pd.DataFrame({"digest": rows["digest"], "member": member, "winner": winner})


def history_table(history: DataFrame, looked_up: int = 0) -> tuple[DataFrame, int]:
    """The sharded hash table of ``history`` (digest, winner, n; digests distinct), stored.

    Shards hold a bounded number of the history's digests and of the ``looked_up`` ones.
    """
    n = shards_for(max(history.count(), looked_up), SHARD_DIGESTS)
    cut = history.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(n)))
    return stored(cut.groupBy("shard").applyInPandas(_build_shard, TABLE), "mph"), n


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``history`` (digest binary, winner long, n long) is what earlier batches kept. Without one,
    the documents themselves are taken in two batches: the lower half of the id range is the
    history of the upper half, so the smallest id of a group always wins.

    A null text is empty. A null id loses against every other; a group of null ids has a null
    keep_id. Of rows that share text and id, one stays. An empty table gives no rows. Other
    columns are ignored. Equal SHA-256 digests count as equal texts.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")), "digests")
    summed = lambda df: df.groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("n"))
    if history is None:
        ends = rows.agg(F.min("id"), F.max("id")).first()
        middle = ends[0] + (ends[1] - ends[0]) // 2 if ends[0] is not None else 0
        old = F.coalesce(F.col("id") <= middle, F.lit(False))
        known, fresh = stored(summed(rows.filter(old)), "history"), summed(rows.filter(~old))
    else:
        known, fresh = history.select("digest", "winner", "n"), summed(rows)
    fresh = stored(fresh, "fresh")
    hashed, n = history_table(known, fresh.count())
    cut = fresh.select("digest", F.pmod(F.xxhash64("digest"), F.lit(n)).alias("shard"))
    found = cut.groupBy("shard").cogroup(hashed.groupBy("shard")).applyInPandas(_look_up, "digest binary, member boolean, winner long")
    met = fresh.withColumnRenamed("winner", "own").join(found, "digest").select(
        "digest", F.when(F.col("member"), F.col("winner")).otherwise(F.col("own")).alias("winner"), "n", "member")
    # A member's group is history's; a digest that is not a member makes a group of its own.
    groups = known.select("digest", "winner", "n").unionByName(met.select("digest", "winner", "n")).groupBy("digest").agg(
        F.min("winner").alias("keep_id"), F.sum("n").alias("group_size"))
    # Stored, so that the join below has plain exchanges on both sides and a digest that very many
    # rows share can be split.
    groups = stored(groups, "groups")
    counted = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("times"))
    first = counted.select("digest", "id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    return first.join(groups, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, one of each text: that with the smallest id.

    Rows are matched by id and digest, so the copies of a common text are spread by their ids.
    """
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keep = exact_dedup(docs, id_col, text_col).filter("kept").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = docs.withColumn("_id", number).withColumn("_sha", F.sha2(normalised(F.col(text_col)), 256))
    return marked.join(keep, ["_id", "_sha"]).dropDuplicates(["_id", "_sha"]).select(*docs.columns)
