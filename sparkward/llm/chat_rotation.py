"""Perspective rotation of dialogues between several parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Speakers that set the scene and take no part.
NARRATORS = ("system",)
START, END = "<|im_start|>", "<|im_end|>"
#: Signs that end a line or are not shown.
CONTROLS = "".join(map(chr, [*range(1, 32), 0x7F, 0x85, 0x2028, 0x2029]))
#: Name of a speaker that is null or empty.
UNNAMED = "unknown"


def neutral(text: Column) -> Column:
    """The text with the template's own markers broken up, so that it can't open or close a message."""
    return F.replace(F.replace(text, F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))


def plain_name(name: Column) -> Column:
    """A speaker's name for a header: line breaks and other control characters are spaces, so that a name can't end its header."""
    return neutral(F.translate(name, CONTROLS, " " * len(CONTROLS)))


def rotate_perspectives(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """Every dialogue, once for each participant, with that speaker as the assistant.

    turns has conv_id, turn, role (the speaker) and text. The result has a row for each turn and
    perspective: conv_id, perspective (the speaker who is the assistant), turn, speaker, as_role
    (assistant, user or system), rendered (the message in chat markup, others as users by name),
    and mask_from and mask_to, the characters of rendered that count for the loss: the assistant's
    text with its end marker, nothing (0, 0) for everyone else. Concatenated in order of turn, then
    speaker, then rendered, the rendered texts of a perspective are its dialogue. Control characters in
    the names of headers become spaces.

    A dialogue with narrators only has no perspective and no rows. A null or empty speaker is named
    'unknown', a null text is empty, and null conv_ids are one dialogue. Turns that repeat or tie
    keep one row each. Other columns are ignored; an empty table gives no rows.

    The join is by conv_id with the distinct speakers of a dialogue, so a dialogue of any length
    is split over tasks, and no dialogue is collected.
    """
    said = turns.select(
        "conv_id", "turn", F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(UNNAMED)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text")
    )
    parties = said.filter(~F.col("speaker").isin(*narrators)).select("conv_id", "speaker").distinct().select(
        F.col("conv_id").alias("party_conv"), F.col("speaker").alias("perspective")
    )
    both = said.join(parties, F.col("conv_id").eqNullSafe(F.col("party_conv")))
    own, narrator = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*narrators)
    as_role = F.when(own, "assistant").when(narrator, "system").otherwise("user")
    header = F.concat(
        F.lit(START), as_role, F.when(own | narrator, "").otherwise(F.concat(F.lit(" name="), plain_name(F.col("speaker")))), F.lit("\n")
    )
    body = F.concat(neutral("text"), F.lit(END))
    return both.select(
        "conv_id", "perspective", "turn", "speaker", as_role.alias("as_role"), F.concat(header, body, F.lit("\n")).alias("rendered"),
        F.when(own, F.length(header)).otherwise(0).cast("long").alias("mask_from"), F.when(own, F.length(header) + F.length(body)).otherwise(0).cast("long").alias("mask_to"),
    )


CONTROL_SQL = " || ".join(f"chr({ord(c)})" for c in CONTROLS)
SQL = f"""
WITH said AS (SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
parties AS (SELECT DISTINCT conv_id AS party_conv, speaker AS perspective FROM said WHERE speaker <> 'system'),
roles AS (SELECT conv_id, perspective, turn, speaker, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
  ELSE 'user' END AS as_role,
  replace(replace(text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' AS body,
  replace(replace(translate(speaker, {CONTROL_SQL}, repeat(' ', {len(CONTROLS)})), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS name
  FROM said JOIN parties ON conv_id IS NOT DISTINCT FROM party_conv),
parts AS (SELECT *, '<|im_start|>' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS header FROM roles)
SELECT conv_id, perspective, turn, speaker, as_role, header || body || chr(10) AS rendered,
  CASE WHEN as_role = 'assistant' THEN length(header) ELSE 0 END AS mask_from,
  CASE WHEN as_role = 'assistant' THEN length(header) + length(body) ELSE 0 END AS mask_to
FROM parts
"""
