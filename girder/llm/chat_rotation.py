"""Chat formatting by rotating the perspective. DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that participant as assistant and
the others as named users. A row is a part of PART turn numbers of one perspective, so a conversation of
any length is never one string or one group; the parts in order are the dialogue. ``mask`` holds the
spans (start:end in code points of the part's text, separated by spaces) that are to be learned: the
assistant's words with their end mark.

Messages of the system role open no perspective and stay system messages. A null role is a participant
without a name, null text is empty, a null turn comes first, in part -1. A null conversation id is a
conversation. Turns of equal number are ordered by role, then text; repeated rows are rendered each.
``<|`` inside a text becomes ``<\\|``, so that no text can forge a mark. Empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 256


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_role: str = "system") -> DataFrame:
    """conv_id, perspective, part, n_turns, n_learned, text, mask."""
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"),
        F.replace(F.coalesce(text_col, F.lit("")), F.lit("<|"), F.lit("<\\|")).alias("body"),
    )
    part = F.coalesce(F.floor(F.col("turn") / PART).cast("long"), F.lit(-1).cast("long"))
    parts = rows.groupBy("conv", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body"))).alias("said"))
    people = rows.where(F.col("role") != system_role).select(F.col("conv").alias("who_conv"), F.col("role").alias("perspective")).distinct()
    both = parts.join(people, F.col("conv").eqNullSafe(F.col("who_conv")))

    def head(role):
        clean = F.regexp_replace(role, r"[|>\n]", "_")
        return F.when(role == system_role, F.lit("<|system|>\n")).when(role == F.col("perspective"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user "), clean, F.lit("|>\n")))

    end = F.lit("<|end|>\n")
    marked = F.transform("said", lambda m: F.struct(head(m["role"]).alias("head"), F.concat(m["body"], end).alias("body"), (m["role"] == F.col("perspective")).alias("own")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, m):
        start = acc["at"] + F.length(m["head"])
        stop = start + F.length(m["body"])
        span = F.concat_ws(":", start.cast("string"), stop.cast("string"))
        return F.struct(stop.cast("long").alias("at"), F.when(m["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return both.withColumn("marked", marked).select(
        F.col("conv").alias(conv_col),
        "perspective",
        "part",
        F.size("marked").cast("long").alias("n_turns"),
        F.size(F.filter("marked", lambda m: m["own"])).cast("long").alias("n_learned"),
        F.array_join(F.transform("marked", lambda m: F.concat(m["head"], m["body"])), "").alias("text"),
        F.array_join(F.aggregate("marked", zero, step, lambda acc: acc["spans"]), " ").alias("mask"),
    )


ORACLE = r"""
WITH m AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '<\|') AS body,
    coalesce(CAST(floor(turn / 256) AS BIGINT), -1) AS part
  FROM conversations
), w AS (
  SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'
), s AS (
  SELECT m.conv_id, w.perspective, m.part, m.turn, m.role, m.body, m.role = w.perspective AS own,
    CASE WHEN m.role = 'system' THEN '<|system|>' WHEN m.role = w.perspective THEN '<|assistant|>'
         ELSE '<|user ' || regexp_replace(m.role, '[|>\n]', '_', 'g') || '|>' END || chr(10) AS head,
    m.body || '<|end|>' || chr(10) AS tail
  FROM m JOIN w ON m.conv_id IS NOT DISTINCT FROM w.conv_id
), o AS (
  SELECT *, row_number() OVER p AS k, sum(length(head) + length(tail)) OVER p AS stop
  FROM s WINDOW p AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, part, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_learned,
  string_agg(head || tail, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(stop - length(tail) AS VARCHAR) || ':' || CAST(stop AS VARCHAR) END, ' ' ORDER BY k), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
