"""Spelling variants of words by an index of variable-length grams.

Words are written between two marks that are no letters. A gram begins at every place of a word
and grows until it is rare (at most ``threshold`` occurrences over all words) or LONGEST
characters long. The dictionary that decides this holds the frequent grams only; the threshold is
the least power of two from LEAST_THRESHOLD on that leaves at most DICTIONARY of them.

Whether a gram grows depends on its own characters alone, so one edit spoils only grams that cover
it. The most grams that any single edit of a word can spoil is the word's bound: among its
``bound + 1`` rarest gram occurrences at least one survives every edit. Two near words therefore
meet in a list of a gram that both take from their rare ends, and at a place that agrees from the
left or from the right. Lists are merged in a join on gram, place and lengths whose condition
checks the edit distance, so only near pairs leave it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchbook.llm.base import stored
from matchbook.llm.texts import cuts

SHORTEST, LONGEST = 2, 5
#: Frequent grams at most (a driver and every worker hold them), and the least threshold.
DICTIONARY, LEAST_THRESHOLD = 1 << 18, 32
#: Fixed values of the contract.
MIN_LENGTH, MIN_COUNT, SPOILT, RATIO = 6, 5, 199, 5
RUNS = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Different words that a task counts before it passes them on.
HELD_WORDS = 1 << 18
BEFORE, AFTER = "^", "$"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: distinct words of at least MIN_LENGTH letters and ``min_count`` occurrences.

    Words are the maximal runs of letters, A-Z lower-cased, some of them with a letter taken out
    as the contract says (runs shorter than MIN_LENGTH only get shorter and are left out). A null
    text has no words and a null id is written as the empty text.
    """
    kept = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for id_, text in zip(batch.column("id"), batch.column("text")):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{id_.as_py()}:".encode())
                for part in cuts(text.as_py()):
                    for word, n in Counter(RUNS.findall(part.encode().translate(LOWER).decode())).items():
                        h = zlib.crc32(word.encode(), seed)
                        if h % SPOILT == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        held[word] += n
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        yield out()

    return kept.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(
        (F.char_length("word") >= MIN_LENGTH) & (F.col("n") >= min_count))


def frequent_grams(words: DataFrame) -> DataFrame:
    """gram, f: at most DICTIONARY grams of the words, those with more occurrences than the threshold."""
    marked = words.select(F.concat(F.lit(BEFORE), "word", F.lit(AFTER)).alias("w"))
    starts = marked.select("w", F.explode(F.sequence(F.lit(1), F.char_length("w") - SHORTEST + 1)).alias("at"))
    # The longest gram of each place is counted before it is cut to each length.
    longest = starts.groupBy(F.substring("w", F.col("at"), F.lit(LONGEST)).alias("s")).agg(F.count(F.lit(1)).alias("f"))
    grams = longest.select("f", F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.char_length("s")), lambda q: F.substring(F.col("s"), F.lit(1), q))).alias("gram"))
    often = stored(grams.groupBy("gram").agg(F.sum("f").alias("f")).filter(F.col("f") > LEAST_THRESHOLD), "frequent")
    power = F.floor(F.log2((F.col("f") - 1) / LEAST_THRESHOLD)).cast("int")  # f is above threshold * 2 ** power
    above, held = 0, 0
    for row in often.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():
        if held + row["count"] > DICTIONARY:
            above = row["power"] + 1
            break
        held += row["count"]
    return often.filter(power >= above)


def decompose(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """Place and text of the variable-length grams of a word between its marks."""
    marked, out = f"{BEFORE}{word}{AFTER}", []
    for at in range(len(marked) - SHORTEST + 1):
        end = at + SHORTEST
        while end < len(marked) and end - at < LONGEST and marked[at:end] in frequent:
            end += 1
        out.append((at, marked[at:end]))
    return out


def affected(grams: list[tuple[int, str]], length: int) -> int:
    """The most grams that one edit can spoil in a word of ``length`` characters.

    Replacing or deleting the character at a place spoils the grams that cover it; inserting
    before a place spoils those that begin before it and end at it or later, which are no more.
    """
    covering = [0] * (length + 3)
    for at, gram in grams:
        covering[at] += 1
        covering[at + len(gram)] -= 1
    most = now = 0
    for place, change in enumerate(covering):
        now += change
        if 1 <= place <= length:
            most = max(most, now)
    # An insertion before the closing mark spoils what covers that mark from the left.
    closing = sum(at <= length and at + len(gram) > length + 1 for at, gram in grams)
    return max(most, closing)


def rare_end(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """Gram occurrences of which at least one survives any single edit.

    Grams are taken from the rarest on (rare ones by their text) with all their occurrences,
    until the occurrences before a gram outnumber the word's bound.
    """
    grams = decompose(word, frequent)
    bound = affected(grams, len(word))
    order = sorted((frequent.get(g, 0), g, at) for at, g in grams)
    out: list[tuple[int, str]] = []
    before, last = 0, None
    for k, (f, g, at) in enumerate(order):
        if (f, g) != last:
            before, last = k, (f, g)
        if before > bound:
            break
        out.append((at, g))
    return out


def gram_lists(words: DataFrame, frequent: DataFrame) -> DataFrame:
    """word, n, length, gram, at: the list entries of every word."""
    held = words.sparkSession.sparkContext.broadcast({r.gram: r.f for r in frequent.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for at, gram in rare_end(word, table):
                    for column, value in zip(out, (word, n, len(word), gram, at)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["word", "n", "length", "gram", "at"])

    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
    return words.select("word", "n").mapInArrow(run, "word string, n long, length int, gram string, at int")


def _keys(pairs: list[tuple[int, Column, Column]]) -> Column:
    """One key per kind of meeting: kind, length of the shorter word, gram, place. Equal hashes of others are checked away."""
    return F.explode(F.array(*[F.xxhash64(F.lit(kind), length, F.col("gram"), place) for kind, length, place in pairs]))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: all pairs of words (word, n) at an edit distance of exactly one, each in both directions once.

    Words are distinct and have at least LONGEST characters: then the first and the last gram of
    a word never cover the same place, and some gram survives every edit.
    """
    lists = stored(gram_lists(words, frequent_grams(words)), "grams")
    left, right = F.col("at"), F.col("length") - F.col("at") - F.char_length("gram")
    same, own, shorter = (0, F.col("length"), left), F.col("length"), F.col("length") - 1
    a = lists.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("length").alias("length_a"), _keys([same, (1, own, left), (2, own, right)]).alias("key"))
    b = lists.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("length").alias("length_b"), _keys([same, (1, shorter, left), (2, shorter, right)]).alias("key"))
    ordered = (F.col("length_a") < F.col("length_b")) | ((F.col("length_a") == F.col("length_b")) & (F.col("a") < F.col("b")))
    met = a.hint("merge").join(b, (a["key"] == b["key"]) & ordered & (F.levenshtein("a", "b", 1) == 1))
    both = met.select(F.explode(F.array(
        F.struct("a", "n_a", "b", "n_b"), F.struct(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))).alias("p")).select("p.*")
    return both.dropDuplicates(["a", "b"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root for a table of word and form in which following forms never comes back.

    Pointers are doubled until none can be followed further, so a chain of length n takes about
    log2(n) rounds; a form is RATIO times as frequent as its word, which keeps chains short.
    """
    to = stored(forms.select("word", F.col("form").alias("to")), "forms")
    while True:
        further = to.select(F.col("word").alias("to"), F.col("to").alias("next"))
        step = stored(to.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
        if not step.filter("moved").limit(1).count():
            return step.select("word", F.col("to").alias("root"))
        to = step.select("word", "to")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents (see :func:`word_counts`).

    Near words differ by one inserted, deleted or replaced character. The form of a word is its
    near word with the largest count (ties: first in code-point order) if that is at least
    ``ratio`` times the word's own; the root is where the forms lead. An empty table, or one
    without words, gives no rows; repeated rows count again; other columns are ignored.
    """
    words = stored(word_counts(docs, id_col, text_col, min_count), "words")
    best = F.min(F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("near")))
    pairs = near_pairs(words)
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")).withColumnRenamed("a", "word")
    joined = words.join(per, "word", "left")
    form_n = F.when(-F.col("best.minus") >= ratio * F.col("n"), -F.col("best.minus"))
    found = stored(joined.select(
        "word", F.when(form_n.isNotNull(), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n")), "variants")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
