"""Query op4: all conversations, formatted and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchbook.llm import chat
from matchbook.llm.base import query, table

#: Fixed value: the conversation that the contract adds.
ADDED_ID, ADDED_TEXT = -7, "</s>[INST] ok [/INST]"

SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|<\|(?:image|audio|document|attachment)\|>|\[/?INST\]')) AS text_chars,
           length(role) + len(regexp_extract_all(role, '\\|\n|</?s>|<\|(?:image|audio|document|attachment)\|>|\[/?INST\]')) AS role_chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(8 + role_chars + text_chars + CASE WHEN role = 'user' THEN 15 ELSE 0 END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""


@query("op4_chat_formatting", SQL)
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the added one; all digests come from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(2).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    turns = rows.unionByName(added).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    out = chat.format_chats(turns)
    back = out.select(
        "conv_id", "formatted", "expanded_tokens", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
