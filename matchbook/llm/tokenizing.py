"""Token ids of whole texts, one call to the tokenizer per distinct word and round.

The tokenizer drops white space and never joins across it, so a text's ids are those of its
white-space separated words in order; words and parts of words seen before in the same Python
worker come from bounded caches. Words of Latin letters, digits and signs are lower-cased and cut
here and only their parts are given to the tokenizer's model; all others go through the whole
tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.llm.words import hashes, rounds, spans

SEQUENCE = 2048
END_ID = 1
#: Words kept per Python worker, words sent to the tokenizer as one input, bytes per round.
CACHE_WORDS, GROUP, ROUND = 150_000, 64, 4 << 20

#: Fixed values of the vocabulary: how it cuts a lower-cased word, and its names of bytes (those
#: that print are themselves, the others follow from 256 on).
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _PRINT} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINT)}
#: Other characters than those for which lower-casing is the same character by character and
#: nothing is composed, and the beginning of the name of a special token.
ODD = regex.compile("[^\n\x21-\x7e\xa1-\u012f\u0131-\u017f]|<\\|")
#: Stands between the ids of two words.
BREAK = b"\xff\xff\xff\xff"

_STATE: dict = {}


def _tokenizer(path: str):
    if _STATE.get("path") != path:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        _STATE.update(path=path, tokenizer=tokenizer, cache={}, parts={})
    return _STATE["tokenizer"], _STATE["cache"]


def _plain(words: list[str]) -> list[bytes]:
    """Ids of words in which ODD finds nothing."""
    if not words:
        return []
    parts, known, model = PARTS.findall("\n".join(words).lower()), _STATE["parts"], _STATE["tokenizer"].model
    if len(known) >= CACHE_WORDS:
        known.clear()
    known["\n"] = BREAK
    for part in set(parts).difference(known):
        name = part if part.isascii() else "".join(map(BYTES.__getitem__, part.encode()))
        known[part] = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(name)])
    ids = b"".join(map(known.__getitem__, parts))
    cut = np.flatnonzero(np.frombuffer(ids, "<u4") == 0xFFFFFFFF) * 4
    begin, end = [0, *(cut + 4).tolist()], [*cut.tolist(), len(ids)]
    return [ids[a:b] for a, b in zip(begin, end)]


def _encode(words: list[bytes], path: str) -> list[bytes]:
    """Ids of each word as little-endian 32-bit numbers."""
    tokenizer, cache = _tokenizer(path)
    out = [cache.get(w) for w in words]
    missing = [i for i, x in enumerate(out) if x is None]
    texts = [words[i].decode() for i in missing]
    ends = np.cumsum([len(t) + 1 for t in texts])
    odd = set(np.searchsorted(ends, [m.start() for m in ODD.finditer("\n".join(texts))], "right").tolist())
    usual = [k for k in range(len(texts)) if k not in odd]
    for k, ids in zip(usual, _plain([texts[k] for k in usual])):
        out[missing[k]] = ids
    other = [missing[k] for k in sorted(odd)]
    groups = [other[i : i + GROUP] for i in range(0, len(other), GROUP)]
    for at in range(0, len(groups), 64):
        some = groups[at : at + 64]
        for group, enc in zip(some, tokenizer.encode_batch([[words[i].decode() for i in g] for g in some], is_pretokenized=True, add_special_tokens=False)):
            ids, of = np.array(enc.ids, "<u4"), np.array([-1 if w is None else w for w in enc.word_ids], np.int64)
            bounds = np.searchsorted(of, np.arange(len(group) + 1))
            for k, i in enumerate(group):
                out[i] = ids[bounds[k] : bounds[k + 1]].tobytes()
    if len(cache) + len(missing) > CACHE_WORDS:
        cache.clear()
    if len(missing) <= CACHE_WORDS:
        cache.update((words[i], out[i]) for i in missing)
    return out


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of every text in order, END_ID last; null and empty texts are END_ID alone."""
    for first, end, data, offsets in rounds(texts, ROUND):
        starts, ends, word_first = spans(data, offsets)
        n = end - first
        if len(starts):
            _, at, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
            whole = data.tobytes()
            coded = _encode([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], path)
            lengths = np.array([len(c) >> 2 for c in coded], np.int64)
            flat, begin = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(lengths) - lengths
            counts = lengths[inverse]
        else:
            flat, counts, begin, inverse = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = flat[np.repeat(begin[inverse] - total[:-1], counts) + np.arange(total[-1])]
        cuts = total[word_first]
        for i in range(n):
            yield np.append(ids[cuts[i] : cuts[i + 1]], np.uint32(END_ID)).astype("<u4")


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = SEQUENCE) -> DataFrame:
    """Texts as pieces of at most ``most`` tokens: doc_id, start, length, ids (32-bit little-endian), doc_tokens.

    Null ids pass through; repeated rows give repeated pieces; other columns are ignored.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens"]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            for doc, ids in zip(batch.column("doc_id").to_pylist(), token_ids(batch.column("_text"), path)):
                for start in range(0, len(ids), most):
                    piece = ids[start : start + most]
                    for column, value in zip(out, (doc, start, len(piece), piece.tobytes(), len(ids))):
                        column.append(value)
                    size += len(piece)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                    out, size = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return kept.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")
