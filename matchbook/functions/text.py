"""Identifier, key and report-text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lexical rules of a valid observation id.
MAX_ID_CHARS = 128
FORBIDDEN_ID_CHARS = r"[\p{Cc}\p{Cf}\p{Cs}/\\]"


def frame_of(key: Column) -> Column:
    return F.substring_index(key, "#", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")


def safe_filename(key: Column) -> Column:
    return F.regexp_replace(key, r"[^\p{L}\p{N}_.\-]", "_")


def slug(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9]+", "_")


def valid_id(value: Column) -> Column:
    n = F.length(value)
    return F.coalesce(
        (n >= 1)
        & (n <= MAX_ID_CHARS)
        & (value == F.regexp_replace(value, r"^\s+|\s+$", ""))
        & ~value.isin(".", "..")
        & ~value.rlike(FORBIDDEN_ID_CHARS),
        F.lit(False),
    )


def digits_only(value: Column) -> Column:
    """Numeric id of a text id: its digits, or a stable hash when it has none."""
    d = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(d) > 0, d.cast("long")).otherwise(
        F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")
    )


def seeded_order(seed: int, *parts: Column) -> Column:
    """A reproducible pseudo-random long, the same in every engine: md5 prefix as integer."""
    s = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")
