"""Quality classifier: naive Bayes features in a linear support vector machine.

Features are indicators over the whole text: hashed byte trigrams, how often a word follows
itself, and the pair of text size and number of distinct trigrams, all counts in powers of two.
Each is scaled by the log ratio of its smoothed share in the two classes; on these a linear
hinge-loss model is fitted by dual coordinate descent, and its margin is turned into a probability by a logistic fit on rows
kept out of the descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchbook.llm.base import in_task, stored
from matchbook.llm.words import hashes, rounds, spans

#: Hashed features, and the most labelled rows that a fit takes (those first by a hash of the id).
FEATURES = 1 << 18
MAX_LABELLED = 6000
#: Bytes of feature lists that the fit takes to the driver.
MAX_BYTES = 128 << 20
THRESHOLD = 0.7
#: Added to the number of features before its root is taken: keeps short texts near the bias.
DAMPING = 100


@dataclass
class Model:
    weights: np.ndarray  # per feature, ratio included
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> float:
        margin = self.bias
        if len(features):
            margin += float(self.weights[features].sum(dtype=np.float64)) / np.sqrt(len(features) + DAMPING)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60))))


def features(data: np.ndarray) -> np.ndarray:
    """Distinct features of one text; trigrams are taken with a space on both sides of the text."""
    if not len(data):
        return np.empty(0, np.int64)
    padded = np.full(len(data) + 2, 32, np.uint32)
    padded[1:-1] = data
    code = padded[:-2] | (padded[1:-1] << np.uint32(8)) | (padded[2:] << np.uint32(16))
    found = np.unique((code * np.uint32(2654435761)) >> np.uint32(14)).astype(np.int64)
    starts, ends, _ = spans(data, np.array([0, len(data)]))
    word = hashes(data, starts, ends)
    # Codes from 2**24 on are no trigrams.
    more = [(1 << 24) + 32 * int(len(data)).bit_length() + int(len(found)).bit_length()]
    again = int((word[1:] == word[:-1]).sum())
    more.append((1 << 25) + again.bit_length())
    extra = (np.array(more, np.uint32) * np.uint32(2654435761)) >> np.uint32(14)
    return np.union1d(found, extra.astype(np.int64))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("label")
        for first, end, data, offsets in rounds(batch.column("text")):
            found = [features(data[a:b]).astype("<i4").tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            rows = slice(first, end)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[rows], labels[rows], pa.array(found, pa.binary())], ["doc_id", "label", "features"])


def descend(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, penalty: np.ndarray, epochs: int = 8, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared-norm hinge loss; ``penalty`` is the cost per row."""
    weights, bias = np.zeros(FEATURES), 0.0
    values = [scale[r] / np.sqrt(len(r) + DAMPING) for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (float(values[i] @ weights[rows[i]]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), penalty[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * signs[i]
                weights[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return weights, bias


def logistic(margin: np.ndarray, positive: np.ndarray, rounds_: int = 60) -> tuple[float, float]:
    """Slope and shift of the probability as a function of the margin (Newton steps, smoothed targets)."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, shift = 1.0, 0.0
    for _ in range(rounds_):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -5, 5), shift - np.clip(step[1], -5, 5)
    return float(slope), float(shift)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on feature lists and 0/1 labels. One class only: a constant score, its smoothed share."""
    labels = np.asarray(labels).astype(bool)
    n1, n = int(labels.sum()), len(labels)
    if n1 == 0 or n1 == n:
        share = (n1 + 1) / (n + 2)
        return Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.ones((2, FEATURES))
    for r, y in zip(rows, labels):
        counts[int(y), r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    held = np.arange(n) % 5 == 4
    if min(labels[held].sum(), (~labels[held]).sum(), labels[~held].sum(), (~labels[~held]).sum()) == 0:
        held = np.ones(n, bool)
        train = np.arange(n)
    else:
        train = np.flatnonzero(~held)
    signs = np.where(labels, 1.0, -1.0)
    share = labels[train].mean()
    penalty = np.where(labels[train], 0.5 / share, 0.5 / (1 - share))
    weights, bias = descend([rows[i] for i in train], signs[train], ratio, penalty)
    folded = weights * ratio
    margin = np.array([folded[rows[i]].sum() / np.sqrt(len(rows[i]) + DAMPING) + bias for i in np.flatnonzero(held)])
    slope, shift = logistic(margin, labels[held])
    return Model(folded.astype(np.float32), bias, slope, shift)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled documents whose ``doc_id`` passes ``allowed``.

    At most ``max_labelled`` labels, first by a hash of the id, and of these the first MAX_BYTES of
    feature lists, which come to the driver; null labels and null ids are left out. Of rows that
    share id and label one is taken.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & allowed)
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # at most max_labelled small rows
    one = joined.groupBy("doc_id", "label").agg(F.min(F.struct(F.sha2("text", 256).alias("sha"), "text")).alias("first")).select("doc_id", "label", "first.text")
    featured = stored(one.mapInArrow(_featurise, "doc_id long, label int, features binary"), "quality-features")
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "label").rowsBetween(Window.unboundedPreceding, 0)  # max_labelled small rows
    fits = featured.select("doc_id", "label", F.sum(F.length("features")).over(upto).alias("bytes")).filter(F.col("bytes") <= MAX_BYTES)
    found = featured.join(F.broadcast(fits.drop("bytes")), ["doc_id", "label"]).select("label", "features").toArrow()
    pairs = sorted(zip(found["features"].to_pylist(), found["label"].to_pylist()))
    rows = [np.frombuffer(f, "<i4") for f, _ in pairs]
    y = np.array([label for _, label in pairs], int)
    shuffle = np.random.default_rng(5).permutation(len(rows))
    rows = [rows[i] for i in shuffle]
    return in_task(docs.sparkSession, lambda: fit(rows, y[shuffle]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, score and predicted (1 from THRESHOLD on), and ``extra`` columns.

    Null and empty texts have no features and get the score of the bias. Every row is scored by
    itself from its whole text, so repeated rows repeat and null ids pass through.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), *extra)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text"] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(features(data[a:b])) for _, _, data, offsets in rounds(batch.column("_text")) for a, b in zip(offsets[:-1], offsets[1:])]
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(scores, pa.float64())], [*rest, "score"])

    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores at least THRESHOLD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [model.score(features(data[a:b])) >= THRESHOLD for _, _, data, offsets in rounds(batch.column(text_col)) for a, b in zip(offsets[:-1], offsets[1:])]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
