"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded; filters of several widths run over fixed-length windows, are rectified and
max-pooled; a softmax layer gives the window's distribution. A text is cut into windows from its
first to its last byte, and the mean log probability over all of them decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.base import in_task
from matchbook.llm.words import rounds

WINDOW = 192
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 16
PAD = 256
#: The most labelled documents that a fit takes (first by a hash of the id), and windows of each.
MAX_LABELLED, WINDOWS_EACH = 3000, 4
UNKNOWN = "und"


@dataclass
class Network:
    classes: list[str]
    embed: np.ndarray = field(repr=False)
    filters: np.ndarray = field(repr=False)  # (widest * EMBED, filters); narrow ones are zero at the end
    filter_bias: np.ndarray = field(repr=False)
    dense: np.ndarray = field(repr=False)
    dense_bias: np.ndarray = field(repr=False)


def _mask() -> np.ndarray:
    mask = np.zeros((max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def columns(codes: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """Embedded bytes under every filter position: (windows, positions, widest * EMBED)."""
    wide = max(WIDTHS)
    x = embed[codes].reshape(len(codes), -1)
    view = np.lib.stride_tricks.sliding_window_view(x, wide * EMBED, axis=1)[:, ::EMBED]
    return np.ascontiguousarray(view)


def forward(net: Network, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities per window, with what the backward pass needs."""
    cols = columns(codes, net.embed)
    raw = cols.reshape(-1, cols.shape[2]) @ net.filters
    raw = raw.reshape(len(codes), -1, net.filters.shape[1])
    pooled = raw.max(axis=1) + net.filter_bias
    hidden = np.maximum(pooled, 0)
    logits = hidden @ net.dense + net.dense_bias
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)), hidden, raw, cols


def windows(data: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, side by side; the last is padded."""
    n = max(1, -(-len(data) // length))
    out = np.full(n * length, PAD, np.int16)
    out[: len(data)] = data
    return out.reshape(n, length)


def fit(codes: np.ndarray, labels: np.ndarray, classes: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    """Train by Adam on windows (n, WINDOW) and class numbers."""
    rng, mask = np.random.default_rng(seed), _mask()
    k = mask.shape[1]
    params = {
        "embed": rng.normal(0, 0.5, (257, EMBED)), "filters": rng.normal(0, 0.25, mask.shape) * mask, "filter_bias": np.zeros(k),
        "dense": rng.normal(0, 0.2, (k, len(classes))), "dense_bias": np.zeros(len(classes))}
    params = {n: v.astype(np.float32) for n, v in params.items()}
    params["embed"][PAD] = 0
    first, second, t = {n: np.zeros_like(v) for n, v in params.items()}, {n: np.zeros_like(v) for n, v in params.items()}, 0
    wide, pick = max(WIDTHS), np.arange(k)
    for epoch in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            net = Network(classes, **params)
            logp, hidden, raw, cols = forward(net, codes[chosen])
            d_logits = np.exp(logp)
            d_logits[np.arange(len(chosen)), labels[chosen]] -= 1
            d_logits /= len(chosen)
            d_hidden = (d_logits @ params["dense"].T) * (hidden > 0)
            top = raw.argmax(axis=1)  # only the position that won is moved
            under = cols[np.arange(len(chosen))[:, None], top]
            d_under = d_hidden[:, :, None] * params["filters"].T[None]
            d_embed = np.zeros_like(params["embed"])
            for step in range(wide):
                byte = codes[chosen][np.arange(len(chosen))[:, None], top + step]
                np.add.at(d_embed, byte.ravel(), d_under[:, :, step * EMBED : (step + 1) * EMBED].reshape(-1, EMBED))
            d_embed[PAD] = 0
            grads = {"embed": d_embed, "filters": np.einsum("bf,bfk->kf", d_hidden, under) * mask, "filter_bias": d_hidden.sum(0), "dense": hidden.T @ d_logits, "dense_bias": d_logits.sum(0)}
            t += 1
            now = rate * (0.5 ** (epoch // 2))
            for n, g in grads.items():
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                params[n] -= (now * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return Network(classes, **params)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to WINDOWS_EACH windows per document, spread evenly over its whole length."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        out: tuple[list, list] = ([], [])
        for first, end, data, offsets in rounds(batch.column("text")):
            for row, a, b in zip(range(first, end), offsets[:-1], offsets[1:]):
                cut = windows(data[a:b])
                for i in np.unique(np.linspace(0, len(cut) - 1, WINDOWS_EACH).astype(int)):
                    out[0].append(langs[row])
                    out[1].append(cut[i].astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], ["lang", "codes"])


def train(docs: DataFrame, allowed: Column, max_labelled: int = MAX_LABELLED) -> Network | None:
    """Fit on text and non-null lang of documents that pass ``allowed``; None if there are none.

    At most ``max_labelled`` documents (first by a hash of the id) with WINDOWS_EACH windows each
    come to the driver; of rows that share id and lang, one.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.coalesce(allowed, F.lit(False)))
    ids = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang").orderBy("h", "doc_id", "lang").limit(max_labelled).select("doc_id", "lang").distinct()
    ids = F.broadcast(ids.withColumnRenamed("doc_id", "_id").withColumnRenamed("lang", "_lang"))  # at most max_labelled small rows
    chosen = rows.select("doc_id", "lang", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")))
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min(F.struct(F.sha2("text", 256).alias("sha"), "text")).alias("first")).select("lang", "first.text")
    found = chosen.select("lang", "text").mapInArrow(_sample, "lang string, codes binary").toArrow()
    pairs = sorted(zip(found["codes"].to_pylist(), found["lang"].to_pylist()))
    if not pairs:
        return None
    classes = sorted({lang for _, lang in pairs})
    number = {lang: i for i, lang in enumerate(classes)}
    codes = np.frombuffer(b"".join(c for c, _ in pairs), "<i2").reshape(-1, WINDOW)
    labels = np.array([number[lang] for _, lang in pairs])
    return in_task(docs.sparkSession, lambda: fit(codes.astype(np.int64), labels, classes))


def predict(net: Network, texts: pa.Array, batch: int = 128) -> tuple[list[str], list[float]]:
    """Language and score of whole texts; a text without a letter, or null, is UNKNOWN with score 0."""
    out_lang, out_score = [], []
    letters = [_has_letter(t) for t in texts.to_pylist()]
    for first, end, data, offsets in rounds(texts):
        codes = [windows(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        counts = np.array([len(c) for c in codes])
        flat = np.concatenate(codes)
        logp = np.concatenate([forward(net, flat[i : i + batch])[0] for i in range(0, len(flat), batch)])
        mean = np.add.reduceat(logp.astype(np.float64), np.cumsum(counts) - counts, axis=0) / counts[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for i, row in enumerate(range(first, end)):
            out_lang.append(net.classes[best[i]] if letters[row] else UNKNOWN)
            out_score.append(float(p[i, best[i]]) if letters[row] else 0.0)
    return out_lang, out_score


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score. Without a network all are UNKNOWN.

    Every row is judged by itself from its whole text; null ids pass through.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    if net is None:
        return kept.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = predict(net, b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return kept.mapInArrow(run, "doc_id long, lang_pred string, score double")
