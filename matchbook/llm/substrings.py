"""Repeated passages: windows of WINDOW words that also start in a document with a smaller id.

1. Sketch. Every window of a text picks the least hash among its runs of GRAM words: its anchor.
   Equal windows pick equal anchors, so a window can only recur where its anchor recurs.
   Documents with the same word sequence are one document here (the smallest id stands for all).
2. Cut. Every document that holds an anchor of two documents gives the stretches of words whose
   windows have that anchor (at most WINDOW + WINDOW - GRAM words long).
3. Confirm. Within an anchor, windows of two documents with equal hashes make a passage: the words
   of their first document. Very common anchors do this by an aggregation with map-side combining.
4. Locate. Passages are dealt to shards by their anchor, every shard compiles its own into an
   Aho-Corasick automaton over word numbers, and the stretches of all documents are streamed
   through the automaton of their shard; a shard with many stretches or passages is a grid of tasks,
   each with its share of the passages and of the stretches. What is removed are hits, that is equal words: hashes only
   propose passages and send a stretch to the one automaton that can hold one of its windows.
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
from matchbook.llm.words import grams, hashes, mix, rounds, sliding_argmin, spans, window_starts

WINDOW, GRAM = 50, 16
#: Occurrences from which the passages of an anchor are found by aggregation.
COMMON = 2000
#: Stretches, and bytes of them, that one task confirms or streams.
SHARD_ROWS, SHARD_BYTES = 1000, 4 << 20
#: Bytes of passages in one automaton (a window is a path of WINDOW nodes).
PASSAGE_BYTES = 256 << 10
#: Stands for a null id: larger than every id.
NO_ID = (1 << 63) - 1


def _i64(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their rows and anchor positions, and the hash of the gram at every position."""
    g = grams(h, np.arange(max(0, len(h) - GRAM + 1)), GRAM)
    least = sliding_argmin(g, WINDOW - GRAM + 1)
    starts, row = window_starts(first, WINDOW)
    return starts, row, least[starts], g


def _sequence(h: np.ndarray, first: np.ndarray, lane: int) -> np.ndarray:
    return _i64(grams(h, first[:-1], np.diff(first), lane))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "seq", "sha", "anchors"]
    for batch in batches:
        ids = batch.column("doc_id")
        for begin, end, data, offsets in rounds(batch.column("text")):
            starts, ends, first = spans(data, offsets)
            h = hashes(data, starts, ends)
            _, row, anchor, g = _anchors(h, first)
            at, where = np.unique(anchor, return_index=True)
            per = np.searchsorted(row[where], np.arange(end - begin + 1))
            whole = data.tobytes()
            sha = [hashlib.sha256(b" ".join(whole[a:b].split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([
                ids.slice(begin, end - begin), pa.array(np.diff(first)), pa.array(_sequence(h, first, 0)), pa.array(sha),
                pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(_i64(g[at])))], names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows on recurring anchors: anchor, common, id, seq, first starts, hashes of the windows, words.

    Equal stretches of one document (a repeated word makes thousands) are one row with all starts.
    """
    names = ["anchor", "common", "id", "seq", "lo", "windows", "text"]
    for batch in batches:
        ids = batch.column("id").to_numpy()
        known, common = batch.column("known").to_pylist(), batch.column("common").to_pylist()
        for begin, end, data, offsets in rounds(batch.column("text")):
            starts, ends, first = spans(data, offsets)
            h, h2 = hashes(data, starts, ends), hashes(data, starts, ends, 1)
            seq = _sequence(h, first, 0)
            window, row, anchor, g = _anchors(h, first)
            keep = np.isin(_i64(g), np.unique(np.array([x for k in known[begin:end] for x in k], np.int64)))[anchor]
            window, row, anchor = window[keep], row[keep], anchor[keep]
            if not len(window):
                continue
            value = grams(h2, window, WINDOW, 1).astype("<u8")
            cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1))))
            bounds = np.append(cut, len(window))
            often = np.unique(np.array([x for k in common[begin:end] for x in k], np.int64))
            key = _i64(g[anchor[cut]])
            content = np.add.reduceat(mix(value), cut) + np.diff(bounds).astype(np.uint64)
            _, one, of = np.unique(mix(content ^ mix(key.view(np.uint64))) + mix(row[cut].astype(np.uint64)), return_index=True, return_inverse=True)
            begins = (window[cut] - first[row[cut]])[np.argsort(of, kind="stable")]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of))).astype(np.int32)), pa.array(begins))
            whole = data.tobytes()
            lo, hi = starts[window[cut[one]]].tolist(), ends[window[bounds[one + 1] - 1] + WINDOW - 1].tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(key[one]), pa.array(np.isin(key[one], often)), pa.array(ids[begin + row[cut[one]]]), pa.array(seq[row[cut[one]]]), lists,
                pa.array([value[bounds[i] : bounds[i + 1]].tobytes() for i in one], pa.binary()),
                pa.array([b" ".join(whole[a:b].split()) for a, b in zip(lo, hi)], pa.binary())], names)


def _spread(windows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Row of every window of a column of window hashes, and its place in that row."""
    size = windows.str.len().to_numpy() // 8
    at = np.repeat(np.arange(len(windows)), size)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)


def _runs(on: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers in ``on`` that lie in one row."""
    if not len(on):
        return on, on
    head = np.concatenate(([True], (on[1:] != on[:-1] + 1) | (at[on[1:]] != at[on[:-1]])))
    begin = np.flatnonzero(head)
    return on[begin], on[np.append(begin[1:], len(on)) - 1]


def _confirm(rows: pd.DataFrame) -> pd.DataFrame:
    """Passages of one shard of anchors: words in their smallest document, for windows found in two documents."""
    at, inside = _spread(rows["windows"])
    value = mix(np.frombuffer(b"".join(rows["windows"]), "<u8") ^ mix(rows["anchor"].to_numpy().view(np.uint64))[at])
    doc = rows["id"].to_numpy()[at]
    order = np.lexsort((doc, value))
    head = np.flatnonzero(np.concatenate(([True], value[order][1:] != value[order][:-1])))
    last = np.append(head[1:], len(order)) - 1
    chosen = order[head[doc[order[last]] > doc[order[head]]]]
    begin, stop = _runs(np.sort(chosen), at)
    words = {r: rows["text"].iat[r].split(b" ") for r in np.unique(at[begin]).tolist()}
    text = [b" ".join(words[int(at[a])][inside[a] : inside[b] + WINDOW]) for a, b in zip(begin, stop)]
    return pd.DataFrame({"anchor": rows["anchor"].to_numpy()[at[begin]], "least": rows["id"].to_numpy()[at[begin]], "passage": text})


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of a common anchor."""
    for batch in batches:
        t = batch.to_pandas()
        if not len(t):
            continue
        at, inside = _spread(t["windows"])
        words = [text.split(b" ") for text in t["text"]]
        yield pa.RecordBatch.from_arrays([
            pa.array(t["anchor"].to_numpy()[at]), pa.array(np.frombuffer(b"".join(t["windows"]), "<i8")), pa.array(t["id"].to_numpy()[at]),
            pa.array([b" ".join(words[r][i : i + WINDOW]) for r, i in zip(at.tolist(), inside.tolist())], pa.binary())], ["anchor", "value", "id", "passage"])


class Passages:
    """An Aho-Corasick automaton over word numbers: all windows of some passages, each with its smallest document."""

    def __init__(self, passages: list[bytes], least: list[int]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.least: list[int] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for passage, doc in zip(passages, least):
            words = [self.number.setdefault(w, len(self.number) + 1) for w in passage.split(b" ")]
            for i in range(len(words) - WINDOW + 1):
                self._add(tuple(words[i : i + WINDOW]), doc)
        if self.least:
            self.automaton.make_automaton()

    def _add(self, window: tuple[int, ...], doc: int) -> None:
        known = self.automaton.get(window, None)
        if known is None:
            self.automaton.add_word(window, len(self.least))
            self.least.append(doc)
        else:
            self.least[known] = min(self.least[known], doc)

    def locate(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Word positions where a window of the passages starts, and the smallest document of each."""
        hits = list(self.automaton.iter(tuple(self.number.get(w, 0) for w in text.split(b" ")))) if self.least else []
        return np.array([end - WINDOW + 1 for end, _ in hits], np.int64), np.array([self.least[i] for _, i in hits], np.int64)


def _locate(stretches: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
    """Runs of windows (from the starts ``lo``) that also start in a smaller document, for one share of a shard."""
    out: list[tuple] = []
    if len(stretches) and len(passages):
        shard = Passages(passages["passage"].tolist(), passages["least"].tolist())
        for text, same in stretches.groupby("text", sort=False):  # equal stretches are streamed once
            at, least = shard.locate(text)
            for doc, seq, lo in zip(same["id"].tolist(), same["seq"].tolist(), same["lo"]):
                on = at[least < doc]
                begin, stop = _runs(on, np.zeros(int(on.max(initial=-1)) + 1, np.int8)) if len(on) else (on, on)
                out += [(doc, seq, int(a), int(b) + WINDOW, lo) for a, b in zip(begin, stop)]
    return pd.DataFrame(out, columns=["id", "seq", "from", "to", "lo"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the removed words out of each text."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        ids, want, runs = batch.column("id").to_pylist(), batch.column("seq").to_pylist(), batch.column("runs").to_pylist()
        for begin, end, data, offsets in rounds(batch.column("text")):
            starts, ends, first = spans(data, offsets)
            seq = _sequence(hashes(data, starts, ends), first, 0)
            whole = data.tobytes()
            for r in range(end - begin):
                if seq[r] != want[begin + r]:
                    continue  # another text under the same id
                words = whole[offsets[r] : offsets[r + 1]].split()
                edge = np.zeros(len(words) + 1, np.int64)
                for run in runs[begin + r]:
                    lo = np.array(run["lo"], np.int64)
                    np.add.at(edge, lo + run["from"], 1)
                    np.add.at(edge, lo + run["to"], -1)
                gone = np.cumsum(edge[:-1]) > 0
                change = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                for column, value in zip(out, (ids[begin + r], int(seq[r]), int(gone.sum()), hashlib.sha256(kept).hexdigest(), change.reshape(-1, 2).tolist())):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))])], ["id", "seq", "n_removed", "sha", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (removed [from, to) in words).

    A null text has no words. A null id counts as larger than every other. Rows that share an id
    never remove each other's words. Repeated rows repeat; an empty table gives no rows; other
    columns are ignored. Texts of fewer than WINDOW words keep all words.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stored(texts.mapInArrow(_sketch, "doc_id long, n_words long, seq long, sha string, anchors array<long>"), "passages")
    number = F.coalesce("doc_id", F.lit(NO_ID))
    same = ["n_words", "seq", "sha"]
    rows = sketch.withColumn("id", number)
    groups = stored(rows.groupBy(*same).agg(F.min("id").alias("least")), "sequences")
    rows = rows.join(groups, same)
    sole = rows.filter((F.col("id") == F.col("least")) & (F.col("n_words") >= WINDOW)).select("id", F.explode("anchors").alias("anchor"))
    sole = stored(sole, "anchors")
    recurring = sole.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("a") < F.col("b")).select("anchor", "n")
    recurring = stored(recurring, "recurring")
    known = sole.join(recurring, "anchor").groupBy("id").agg(
        F.collect_set("anchor").alias("known"), F.collect_set(F.when(F.col("n") > COMMON, F.col("anchor"))).alias("common"))
    held = stored(texts.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text").join(known, "id"), "holders")
    found = stored(held.mapInArrow(_windows, "anchor long, common boolean, id long, seq long, lo array<long>, windows binary, text binary"), "windows")
    shards = shards_for(found.count(), SHARD_ROWS)
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    usual = found.filter(~F.col("common")).select("anchor", "id", "windows", "text").groupBy(shard).applyInPandas(_confirm, "anchor long, least long, passage binary")
    single = found.filter("common").mapInArrow(_single, "anchor long, value long, id long, passage binary")
    often = single.groupBy("anchor", "value", "passage").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter(F.col("least") < F.col("most"))
    passages = stored(usual.unionByName(often.select("anchor", "least", "passage")), "confirmed")
    streamed = found.join(passages.select("anchor").distinct(), "anchor", "left_semi").select(shard.alias("shard"), "id", "seq", "lo", "text")
    share = F.greatest(F.count(F.lit(1)) / SHARD_ROWS, F.sum(F.length("text")) / SHARD_BYTES)
    tasks = streamed.groupBy("shard").agg(F.ceil(share).cast("long").alias("tasks"))
    passages = passages.withColumn("shard", shard)
    parts = passages.groupBy("shard").agg(F.ceil(F.sum(F.length("passage")) / PASSAGE_BYTES).cast("long").alias("parts"))
    grid = stored(tasks.join(parts, "shard"), "shards")  # one row per shard
    every, one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)), lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n))
    left = streamed.join(grid, "shard").withColumn("task", one("tasks", "id", "lo")).withColumn("part", every("parts"))
    right = passages.join(grid, "shard").withColumn("task", every("tasks")).withColumn("part", one("parts", "passage"))
    place = ["shard", "task", "part"]
    runs = left.drop("tasks", "parts").groupBy(*place).cogroup(right.select(*place, "least", "passage").groupBy(*place)).applyInPandas(
        _locate, "id long, seq long, from long, to long, lo array<long>")
    merged = runs.groupBy("id", "seq").agg(F.collect_set(F.struct("from", "to", "lo")).alias("runs"))
    cut = held.select("id", "text").join(merged, "id").mapInArrow(_cut, "id long, seq long, n_removed long, sha string, spans array<array<long>>").distinct()
    everything = F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))
    copy = (F.col("id") > F.col("least")) & (F.col("n_words") >= WINDOW)
    empty = F.sha2(F.lit(""), 256)
    return rows.drop("anchors").join(cut.withColumnRenamed("sha", "cut_sha"), ["id", "seq"], "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, empty).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(copy, everything).otherwise(F.coalesce("spans", F.array().cast("array<array<long>>"))).alias("spans"))
