"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn is an array of parts ``struct<kind, text, ref, units>``. A visitor (one rule per kind)
turns each part into text: a text part is escaped, every other kind becomes a placeholder, and
its reference and expanded token count are recorded in order.

Template: ``<s>role\\nbody</s>`` per turn, the body of a user turn inside ``[INST] `` and
`` [/INST]``. Inside texts and roles the first character of a control string is replaced, so no
control string is left in them, and the replacement is undone by :func:`unescape`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the template and the placeholder of each kind of attachment.
TURN_OPEN, TURN_CLOSE = "<s>", "</s>"
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"
ANGLE = r"<(?=/?s>|\|(?:image|audio|document|attachment)\|>)"
SQUARE = r"\[(?=/?INST\])"
#: The same characters where the rest of a part may begin a control string that the next part ends.
ANGLE_TAIL = r"<(?=(?:/?s?|\|[a-z]*\|?)\z)"
SQUARE_TAIL = r"\[(?=/?[INST]*\z)"
#: Tokens per unit: image patches, seconds of audio, pages of a document.
TOKENS_PER_UNIT = {"image": 1.0, "audio": 25.0, "document": 800.0}
#: Turns whose texts are joined in the first of two steps.
CHUNK_TURNS = 64

PART = "struct<kind:string,text:string,ref:string,units:double>"


def escape(text: Column, more: Column | None = None) -> Column:
    """Text without control strings; ``\\e``, ``\\l`` and ``\\b`` stand for backslash, ``<`` and ``[``.

    Where ``more`` text follows, what could begin a control string at the end is escaped too.
    """
    text = F.replace(text, F.lit("\\"), F.lit("\\e"))
    text = F.regexp_replace(text, ANGLE, r"\\l")
    text = F.regexp_replace(text, SQUARE, r"\\b")
    if more is None:
        return text
    return F.when(more, F.regexp_replace(F.regexp_replace(text, ANGLE_TAIL, r"\\l"), SQUARE_TAIL, r"\\b")).otherwise(text)


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\l"), F.lit("<"))
    text = F.replace(text, F.lit("\\b"), F.lit("["))
    return F.replace(text, F.lit("\\e"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def visit(part: Column, following: Column | None = None) -> Column:
    """The text that stands for one part; ``following`` is the part after it, if any."""
    more = None if following is None else F.coalesce(following.isNotNull() & is_text(following), F.lit(False))
    out = F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")), more))
    for kind, mark in PLACEHOLDERS.items():
        out = out.when(part["kind"] == kind, F.lit(mark))
    return out.otherwise(F.lit(OTHER))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a model puts in place of the placeholder; 0 for text and unknown kinds."""
    out = F.when(is_text(part), F.lit(0.0))
    for kind, rate in TOKENS_PER_UNIT.items():
        out = out.when(part["kind"] == kind, F.ceil(F.coalesce(part["units"], F.lit(0.0)) * rate).cast("double"))
    return F.coalesce(out, F.lit(0.0)).cast("long")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _shift(items: Column, by: Column) -> Column:
    return F.transform(items, lambda s: s.withField("start", s["start"] + by))


def _join(pieces: Column) -> Column:
    """Join an ordered array of pieces (text, chars, spans, files, turns) into one piece."""
    none_s = F.array().cast("array<struct<start:long,length:long>>")
    none_f = F.array().cast("array<struct<start:long,kind:string,ref:string,tokens:long>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none_s.alias("spans"), none_f.alias("files"))
    return F.struct(
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
        F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["chars"]).alias("chars"),
        F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + p["turns"]).alias("turns"),
        F.aggregate(
            F.filter(pieces, lambda p: F.lit(True)), start,
            lambda a, p: F.struct(
                (a["at"] + p["chars"]).alias("at"),
                F.concat(a["spans"], _shift(p["spans"], a["at"])).alias("spans"),
                F.concat(a["files"], _shift(p["files"], a["at"])).alias("files")),
            lambda a: F.struct(a["spans"].alias("spans"), a["files"].alias("files"))).alias("marks"),
    )


def _turn(role: Column, parts: Column) -> Column:
    """One turn as a piece; spans cover the escaped text parts of assistant turns."""
    user = role == "user"
    head = F.concat(F.lit(TURN_OPEN), escape_role(role), F.lit("\n"), F.when(user, F.lit(USER_OPEN)).otherwise(F.lit("")))
    tail = F.concat(F.when(user, F.lit(USER_CLOSE)).otherwise(F.lit("")), F.lit(TURN_CLOSE))
    none_s = F.array().cast("array<struct<start:long,length:long>>")
    none_f = F.array().cast("array<struct<start:long,kind:string,ref:string,tokens:long>>")
    fixed = lambda t: F.struct(t.alias("text"), F.char_length(t).cast("long").alias("chars"), none_s.alias("spans"), none_f.alias("files"), F.lit(0).cast("long").alias("turns"))
    zero = F.lit(0).cast("long")

    def piece(part, i):
        text = visit(part, F.get(parts, i + 1))
        chars = F.char_length(text).cast("long")
        return F.struct(
            text.alias("text"), chars.alias("chars"),
            F.when((role == "assistant") & is_text(part) & (chars > 0), F.array(F.struct(zero.alias("start"), chars.alias("length")))).otherwise(none_s).alias("spans"),
            F.when(~is_text(part), F.array(F.struct(zero.alias("start"), part["kind"].alias("kind"), part["ref"].alias("ref"), expanded_tokens(part).alias("tokens")))).otherwise(none_f).alias("files"),
            zero.alias("turns"))

    return F.concat(F.array(fixed(head)), F.transform(parts, piece), F.array(fixed(tail)))


def _flat(piece: str) -> list[Column]:
    p = F.col(piece)
    return [p["text"].alias("text"), p["chars"].alias("chars"), p["marks"]["spans"].alias("spans"), p["marks"]["files"].alias("files")]


def format_chats(turns: DataFrame) -> DataFrame:
    """Format conversations: one row per ``conv_id``.

    ``turns`` has conv_id, turn, role and parts (array of ``PART``); other columns are ignored.
    Result: conv_id, n_turns, formatted, loss_spans (start and length in code points, from 0),
    attachments (start of the placeholder, kind, ref, tokens), expanded_tokens.

    Null roles, parts and texts are empty; a null kind is text; a null turn comes first; equal
    turns are ordered by role, then by their formatted text; a null conv_id is a conversation
    of its own; repeated rows are repeated turns; an empty table gives an empty result.

    Turns of a conversation are joined in two steps (runs of CHUNK_TURNS turn numbers, then
    runs), so one very long conversation is formatted by many tasks and only its finished runs
    meet, which its one result row needs anyway.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    # An array of one element computes the joined piece once per row.
    rendered = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.floor(F.col("turn") / CHUNK_TURNS).alias("run"),
        role.alias("role"), _turn(role, parts).alias("pieces"),
    ).withColumn("piece", _join(F.col("pieces"))).select("conv_id", "run", "turn", "role", *_flat("piece"), F.lit(1).cast("long").alias("turns"))
    runs = rendered.groupBy("conv_id", "run").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "chars", "spans", "files", "turns"))).alias("pieces"))
    runs = runs.withColumn("piece", _join(F.col("pieces"))).select("conv_id", "run", *_flat("piece"), F.col("piece.turns").alias("turns"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "text", "chars", "spans", "files", "turns"))).alias("pieces"))
    return whole.withColumn("piece", _join(F.col("pieces"))).select(
        "conv_id", F.col("piece.turns").alias("n_turns"), F.col("piece.text").alias("formatted"),
        F.col("piece.marks.spans").alias("loss_spans"), F.col("piece.marks.files").alias("attachments"),
        F.aggregate(F.col("piece.marks.files"), F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, TURN_CLOSE), lambda p: p != "")

    def parse(p):
        cut = F.instr(p, F.lit("\n"))
        raw = F.substring(p, F.lit(len(TURN_OPEN) + 1), cut - len(TURN_OPEN) - 1)
        body = F.substring(p, cut + 1, F.char_length(p))
        inner = F.substring(body, F.lit(len(USER_OPEN) + 1), F.char_length(body) - len(USER_OPEN) - len(USER_CLOSE))
        return F.struct(unescape_role(raw).alias("role"), unescape(F.when(raw == "user", inner).otherwise(body)).alias("text"))

    return F.transform(pieces, parse)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""))
