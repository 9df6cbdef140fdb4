"""Repeated byte strings of at least MINIMUM bytes, by interval expansion on a Burrows-Wheeler transform.

1. Sketch. Every MINIMUM-byte window of a text picks the least hash among its runs of GRAM bytes,
   its anchor; equal windows pick equal anchors. Only anchors that occur twice go on.
2. Contexts. The windows that share an anchor occurrence lie in one stretch of bytes. Stretches
   that are equal make each other's windows repeated at once. The others are compared:
3. Transform. The different stretches of an anchor are put into one text, shard by shard. Its
   transform is expanded backwards, breadth first: level k turns the intervals of strings of
   length k into those of length k + 1, and an interval end reached for the first time has a
   common prefix of exactly k bytes. Expansion stops at MINIMUM; ends not reached by then are
   neighbours that share MINIMUM bytes or more.

Anchors with very many different stretches are compared window by window in an aggregation with
map-side combining instead. Texts that occur twice are repeated as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.base import shards_for, stored
from matchbook.llm.words import _BYTE, grams, hashes, rounds, sliding_argmin, window_starts

MINIMUM, GRAM = 400, 32
#: Different stretches from which an anchor is compared by aggregation; bytes of a shard's text.
COMMON, SHARD_BYTES = 2000, 1 << 20


def suffix_array(symbols: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sorted suffixes of texts that each end in symbol 0 at ``stop``; ends are ordered by place.

    The first sort takes seven symbols; then prefixes double, for the suffixes still tied.
    """
    n, here = len(symbols), np.arange(len(symbols))
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | symbols[np.minimum(here + k, stop)].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    new[: int((symbols == 0).sum())] = True
    rank = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(new, here, 0))
    rank[order] = first
    span = 7
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        some = order[tied]
        both = rank[some] * np.int64(n) + rank[np.minimum(some + span, stop[some])]
        by = np.argsort(both, kind="stable")
        some, both = some[by], both[by]
        order[tied] = some
        head = np.ones(len(some), bool)
        head[1:] = both[1:] != both[:-1]
        new[tied] = head
        rank[some] = tied[np.maximum.accumulate(np.where(head, np.arange(len(some)), 0))]
        span *= 2


def repeated_starts(texts: list[bytes], minimum: int) -> list[np.ndarray]:
    """Per text, the starts of strings of ``minimum`` bytes that also start anywhere else."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    n = int(lengths.sum()) + len(texts)
    symbols = np.zeros(n, np.int16)
    stop = np.repeat(begin + lengths, lengths + 1)
    inside = np.arange(n) != stop
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    order = suffix_array(symbols, stop)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1  # the transform: what stands before each suffix
    open_ = (before >= 0) & (symbols[before] != 0)
    step = place[before]  # where the suffix with that symbol in front stands
    head = symbols[order]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    # Strings of one symbol; every end of a text is a symbol of its own.
    edge = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (head[1:] == 0))))
    low, high = edge, np.append(edge[1:], n)
    unset[high] = False
    for _ in range(1, minimum):
        size = high - low
        row = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]
        ok = open_[at]
        row, to = row[ok], step[at[ok]]
        if not len(to):
            break
        if len(to) > n // 16:
            owner = np.full(n, -1, np.int64)
            owner[to] = row
            to = np.flatnonzero(owner >= 0)
            row = owner[to]
        else:
            by = np.argsort(to)
            to, row = to[by], row[by]
        cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (to[1:] != to[:-1] + 1) | (head[to[1:]] != head[to[:-1]]))))
        low, high = to[cut], to[np.append(cut[1:], len(to)) - 1] + 1
        fresh = unset[high]
        low, high = low[fresh], high[fresh]
        unset[high] = False
        if not len(low):
            break
    same = np.sort(order[unset[:-1] | unset[1:]])
    of = np.searchsorted(begin, same, "right") - 1
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    return [same[a:b] - begin[i] for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their rows and anchor positions, and the hash of the gram at every position."""
    here = np.arange(max(0, len(data) - GRAM + 1))
    g = grams(_BYTE[0][data], here, GRAM)
    least = sliding_argmin(g, MINIMUM - GRAM + 1)
    starts, row = window_starts(offsets, MINIMUM)
    return starts, row, least[starts], g


def _i64(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, offsets in rounds(batch.column("text")):
            _, row, anchor, g = _anchors(data, offsets)
            at, where = np.unique(anchor, return_index=True)
            per = np.searchsorted(row[where], np.arange(end - begin + 1))
            whole = data.tobytes()
            keys = [_key(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(begin, end - begin), pa.array(np.diff(offsets)), pa.array(keys, pa.binary()),
                pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(_i64(g[at])))], ["doc_id", "n_bytes", "key", "anchors"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per occurrence of a recurring anchor: the stretch of its windows, by hash."""
    names = ["anchor", "c1", "c2", "key", "lo", "n"]
    for batch in batches:
        keys, known = batch.column("key").to_pylist(), batch.column("known").to_pylist()
        for begin, end, data, offsets in rounds(batch.column("text")):
            window, row, anchor, g = _anchors(data, offsets)
            head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))) if len(anchor) else np.empty(0, int)
            n = np.diff(np.append(head, len(anchor)))
            lo, at, of = window[head], anchor[head], row[head]
            keep = np.isin(_i64(g[at]), np.unique(np.array([x for k in known[begin:end] for x in k], np.int64)))
            lo, at, of, n = lo[keep], at[keep], of[keep], n[keep]
            stop = lo + n - 1 + MINIMUM
            tag = ((at - lo) * MINIMUM + n).astype(np.uint64)  # where the anchor stands in the stretch
            yield pa.RecordBatch.from_arrays([
                pa.array(_i64(g[at])), pa.array(_i64(hashes(data, lo, stop) ^ tag)), pa.array(_i64(hashes(data, lo, stop, 1) + tag)),
                pa.array([keys[begin + r] for r in of], pa.binary()), pa.array(lo - offsets[of]), pa.array(n)], names)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    names = ["anchor", "c1", "c2", "many", "bytes"]
    for batch in batches:
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
            text = (text or "").encode()
            some = [(w["anchor"], w["c1"], w["c2"], w["many"], text[w["lo"] : w["lo"] + w["n"] - 1 + MINIMUM]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()])], names)


def _runs(starts: np.ndarray) -> list[list[int]]:
    """[first start, end of the last window) of runs of consecutive starts."""
    cut = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1] + 1)))
    last = np.append(cut[1:], len(starts)) - 1
    return np.stack([starts[cut], starts[last] + MINIMUM], axis=1).tolist()


def _expand(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeated starts of one shard of stretches."""
    found = repeated_starts(list(rows["bytes"]), MINIMUM)
    on = [i for i, s in enumerate(found) if len(s)]
    out = rows.iloc[on][["anchor", "c1", "c2"]].copy()
    out["runs"] = [_runs(found[i]) for i in on]
    return out


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of a stretch whose anchor is common."""
    for batch in batches:
        anchor, c1, c2 = (batch.column(c).to_numpy() for c in ("anchor", "c1", "c2"))
        for i, text in enumerate(batch.column("bytes").to_pylist()):
            data = np.frombuffer(text, np.uint8)
            at = np.arange(len(data) - MINIMUM + 1)
            full = lambda v: pa.array(np.full(len(at), v, np.int64))
            yield pa.RecordBatch.from_arrays([full(anchor[i]), full(c1[i]), full(c2[i]), pa.array(at), pa.array(_i64(hashes(data, at, at + MINIMUM))), pa.array(_i64(hashes(data, at, at + MINIMUM, 1)))],
                                             ["anchor", "c1", "c2", "at", "w1", "w2"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for key, text, runs in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            data = (text or "").encode()
            edge = np.zeros(len(data) + 1, np.int64)
            for a, b in runs:
                edge[a] += 1
                edge[b] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            spans = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            for column, value in zip(out, (key, int(gone.sum()), spans.tolist(), hashlib.sha256(kept).hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.binary(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()])], ["key", "n_removed", "spans", "cut_sha"])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed [from, to) in bytes), kept_sha256.

    A null text is empty. Null ids pass through; repeated rows are copies of each other, so all of
    their bytes go if there are MINIMUM of them. Texts shorter than MINIMUM keep all bytes. An
    empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketch = stored(texts.mapInArrow(_sketch, "doc_id long, n_bytes long, key binary, anchors array<long>"), "byte-sketch")
    groups = stored(sketch.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.first("anchors").alias("anchors")), "byte-texts")
    sole = stored(groups.select("key", "least", F.explode("anchors").alias("anchor")), "byte-anchors")
    recurring = stored(sole.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "byte-recurring")
    known = sole.join(recurring, "anchor").groupBy("key").agg(F.first("least").alias("least"), F.collect_set("anchor").alias("known"))
    keyed = texts.withColumn("key", F.unhex(F.sha2("text", 256)))
    # One row per text will do; without an id all its copies come along, which changes nothing.
    held = keyed.join(known, "key").filter(F.col("least").isNull() | (F.col("least") == F.col("doc_id"))).select("key", "text", "known")
    held = stored(held, "byte-holders")
    found = stored(held.mapInArrow(_stretches, "anchor long, c1 long, c2 long, key binary, lo long, n long"), "stretches")
    same = ["anchor", "c1", "c2"]
    kinds = stored(found.groupBy(*same).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("key", "lo", "n")).alias("one")), "stretch-kinds")
    per = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("rarest")).filter("kinds > 1 and rarest = 1")
    per = stored(per.select("anchor", (F.col("kinds") > COMMON).alias("many")), "stretch-anchors")
    wanted = kinds.join(per, "anchor").select("one.key", F.struct(*same, "many", "one.lo", "one.n").alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted"))
    pieces = stored(held.select("key", "text").dropDuplicates(["key"]).join(wanted, "key").mapInArrow(_cut_out, "anchor long, c1 long, c2 long, many boolean, bytes binary"), "stretch-bytes")
    total = pieces.filter("not many").agg(F.sum(F.length("bytes"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards_for(total, SHARD_BYTES)))
    compared = pieces.filter("not many").withColumn("shard", shard).groupBy("shard").applyInPandas(_expand, "anchor long, c1 long, c2 long, runs array<array<long>>")
    single = stored(pieces.filter("many").mapInArrow(_single, "anchor long, c1 long, c2 long, at long, w1 long, w2 long"), "stretch-windows")
    twice = stored(single.groupBy("anchor", "w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "stretch-twice")
    often = single.join(twice, ["anchor", "w1", "w2"]).groupBy(*same).agg(F.collect_list(F.array("at", F.col("at") + MINIMUM)).alias("runs"))
    partly = stored(compared.unionByName(often), "stretch-runs")
    whole = kinds.filter("times > 1").select(*same, F.array(F.array(F.lit(0).cast("long"), F.col("one.n") - 1 + MINIMUM)).alias("runs"))
    marks = stored(partly.join(whole.select(*same), same, "left_anti").unionByName(whole), "stretch-marks")
    runs = found.join(marks, same).select("key", F.transform("runs", lambda r: F.transform(r, lambda x: x + F.col("lo"))).alias("runs")).groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    cut = held.select("key", "text").join(runs, "key").mapInArrow(_cut, "key binary, n_removed long, spans array<array<long>>, cut_sha string").dropDuplicates(["key"])
    result = stored(groups.select("key", "copies").join(cut, "key", "left"), "byte-results")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= MINIMUM)
    none = F.array().cast("array<array<long>>")
    return sketch.drop("anchors").join(result, "key").select(
        "doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("key")))).alias("kept_sha256"))
