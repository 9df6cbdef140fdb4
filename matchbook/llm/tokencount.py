"""Token counts of whole texts with a shortcut for whole tokens.

A byte-level vocabulary cuts a text into pre-tokens and merges inside each alone. Before any text
is read, every string of the vocabulary is put through the library by itself: the strings that
are one pre-token and come out as one token are *proven*. In the texts a pre-token that is a
proven string counts one without any merging; only the rest is merged, once per worker and
different pre-token while it stays in a bounded cache.

Pre-tokens are cut here where all characters of a text are of a class that every version of the
character tables agrees on; other texts are cut by the library. A vocabulary of another kind
(normalizer, other pre-tokenizer) has no shortcut and goes through the library as a whole.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm.texts import cuts
from matchbook.llm.tokenizing import BYTES

LIMIT = 512
#: Pre-tokens that a worker remembers besides the proven ones, and the longest of them.
CACHE, CACHE_CHARS = 400_000, 64
#: Strings of the vocabulary that one task proves.
PROVE_ROWS = 1 << 14

#: Fixed value: the first character beyond which the classes of letters and numbers may differ
#: between versions of the character tables.
BEYOND_CHAR = 0x558
BEYOND = re.compile(f"[^\0-{chr(BEYOND_CHAR - 1)}]")


def _class(kind: str) -> str:
    """The characters below BEYOND_CHAR of a general category, for use inside brackets."""
    return "".join(re.escape(chr(c)) for c in range(BEYOND_CHAR) if unicodedata.category(chr(c)).startswith(kind))


def _pattern() -> re.Pattern:
    """How byte-level pre-tokenizers cut: contractions, letters, numbers, other signs, white space."""
    letter, number, space = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    # The order of the alternatives and the contractions.
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


PATTERN = _pattern()


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The library's tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def has_shortcut(path: str) -> bool:
    """Whether the file cuts texts by PATTERN and changes nothing before."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cut = spec.get("pre_tokenizer") or {}
    plain = all(not t["single_word"] and not t["lstrip"] and not t["rstrip"] and not t["normalized"] for t in spec["added_tokens"])
    return (spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and plain and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and not spec["model"].get("dropout"))


def _merged(path: str, pre_token: str) -> int:
    """Tokens of one pre-token by the library's merges."""
    return len(tokenizer(path).model.tokenize("".join(map(BYTES.__getitem__, pre_token.encode()))))


def proven_strings(spark: SparkSession, path: str) -> frozenset[str]:
    """Strings of the vocabulary that are one pre-token and one token when they stand alone.

    The result is no larger than the vocabulary, whatever the texts are.
    """
    size = tokenizer(path).get_vocab_size(with_added_tokens=False)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            strings = [model.decode([i], skip_special_tokens=False) for i in batch.column(0).to_pylist()]
            # Parts of characters decode to a replacement mark, which is then not that token.
            held = [s for i, s in zip(batch.column(0).to_pylist(), strings)
                    if len(cut := model.pre_tokenizer.pre_tokenize_str(s)) == 1 and [t.id for t in model.model.tokenize(cut[0][0])] == [i]]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["s"])

    ids = spark.range(0, size, 1, max(1, -(-size // PROVE_ROWS)))
    return frozenset(r.s for r in ids.mapInArrow(prove, "s string").collect())


class Costs(dict):
    """Tokens per pre-token; what is not known yet is merged and remembered within bounds."""

    def __init__(self, path: str, proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.path, self.room = path, len(proven) + CACHE
        self.proven = proven

    def __missing__(self, pre_token: str) -> int:
        n = _merged(self.path, pre_token)
        if len(pre_token) <= CACHE_CHARS:
            if len(self) >= self.room:
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
            self[pre_token] = n
        return n


def count_tokens(text: str, costs: Costs, special: re.Pattern | None) -> int:
    """Tokens of one text; strings of added tokens are one token each, as the library has it by default."""
    total, cost = 0, costs.__getitem__
    for i, segment in enumerate(special.split(text) if special else [text]):
        total += i > 0
        own = BEYOND.search(segment) is None
        for part in cuts(segment):
            if own:
                total += sum(map(cost, PATTERN.findall(part)))
            else:
                total += sum(cost(part[a:b]) for _, (a, b) in tokenizer(costs.path).pre_tokenizer.pre_tokenize_str(part))
    return total


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a tokenizer file of the tokenizers library, at the same place on every machine. A
    null text is empty and has no tokens; null ids pass through; repeated rows give repeated rows;
    an empty table gives no rows; other columns are ignored. Very long texts are counted piece by
    piece, cut where a pre-token ends in any case.
    """
    spark = docs.sparkSession
    short = has_shortcut(path)
    proven = spark.sparkContext.broadcast(proven_strings(spark, path) if short else frozenset())
    added = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    special = re.compile("|".join(re.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = Costs(path, proven.value)
        for batch in batches:
            texts = pc.fill_null(batch.column("_text"), "")
            if short:
                counts = [count_tokens(t.as_py(), costs, special) for t in texts]
            else:
                counts = [len(tokenizer(path).encode(t.as_py(), add_special_tokens=False).ids) for t in texts]
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
