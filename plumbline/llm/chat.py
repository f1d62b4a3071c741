"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

Every participant of a conversation gets the whole dialogue once, with their
own turns as the assistant's and everyone else's as those of named users. The
rendered dialogue is a relation of segments in order, one per turn, so a
conversation of any length is spread over tasks and never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles that take no side: their turns are rendered as they are, under no one's mask.
PASSIVE = ("system",)


def rotate_perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", passive: tuple[str, ...] = PASSIVE
) -> DataFrame:
    """One row per conversation, participant and turn: conv_id, perspective, turn, role, name, content, mask.

    ``role`` is assistant for the participant's own turns, the passive role for passive turns and user for all others;
    ``name`` is the speaker of a user turn, else null. ``content`` is the segment as rendered, header and end of turn
    included; ``mask`` is 1 where a model learns to write it (assistant turns with text), else 0. Concatenated by
    turn, the segments of (conv_id, perspective) are the dialogue.

    Participants are the distinct speakers that are not passive; a conversation without one is not rendered. A null
    speaker is no participant and its turns are an unnamed user's. A null text is an empty turn with mask 0. Rows that
    repeat a turn are rendered once each; null turns stay null; rows without conv_id are dropped. Other columns
    are not read.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(speaker).cast("string").alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    t = t.filter(F.col("conv_id").isNotNull())
    sides = t.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*passive)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    rows = t.join(sides, "conv_id")
    own, aside = F.col("speaker").eqNullSafe(F.col("perspective")), F.coalesce(F.col("speaker").isin(*passive), F.lit(False))
    role = F.when(own, "assistant").when(aside, F.col("speaker")).otherwise("user")
    name = F.when(~own & ~aside, F.col("speaker"))
    header = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("|>\n"))
    return rows.select(
        "conv_id", "perspective", "turn", role.alias("role"), name.alias("name"),
        F.concat(header, F.col("text"), F.lit("<|end|>\n")).alias("content"), (own & (F.col("text") != "")).cast("int").alias("mask"),
    )


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
sides AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
r AS (
  SELECT t.*, perspective, speaker IS NOT DISTINCT FROM perspective AS own, coalesce(speaker = 'system', false) AS aside
  FROM t JOIN sides USING (conv_id)
), n AS (
  SELECT *, CASE WHEN own THEN 'assistant' WHEN aside THEN speaker ELSE 'user' END AS new_role,
         CASE WHEN NOT own AND NOT aside THEN speaker END AS name
  FROM r
)
SELECT conv_id, perspective, turn, new_role AS role, name,
       '<|' || new_role || coalesce(' name=' || name, '') || '|>' || chr(10) || text || '<|end|>' || chr(10) AS content,
       CAST(own AND text <> '' AS INTEGER) AS mask
FROM n
"""
