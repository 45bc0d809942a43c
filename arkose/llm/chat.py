"""Preference pairs as training text: a shared prompt and two masked completions.

The longest common prefix of turns of the chosen and the rejected conversation is
rendered once as the prompt; what is left of each is a completion. Its mask lists the
stretches that are learned: what assistants say, and the mark that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = ("<|", "|>\n"), "<|end|>\n"
LEARNED = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def _role(turn: Column) -> Column:
    return F.coalesce(turn["role"], F.lit("unknown"))


def _said(turn: Column) -> Column:
    """A turn's text; marks inside it are broken so that they cannot end the turn."""
    return F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), F.replace(_role(turn), F.lit("<|"), F.lit("< |")), F.lit(HEAD[1]))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _said(t), F.lit(END))), "")


def mask(turns: Column) -> Column:
    """Code-point stretches (start, end) of the rendered turns that are learned."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, t):
        start = state["at"] + F.length(_head(t))
        end = start + F.length(_said(t)) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(_role(t) == LEARNED, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def preferences(df: DataFrame, id_col: str = "conv_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Per pair: id, n_prompt (turns), prompt, chosen, rejected, chosen_mask,
    rejected_mask.

    A null conversation counts as one without turns, a null role as "unknown", a null
    text as empty. Equal conversations have empty completions; where one is a prefix of
    the other, only its completion is empty. Repeated rows and null ids stay; an empty
    table gives no row; other columns are ignored.
    """
    none = F.array().cast(TURNS)
    pair = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(chosen_col).cast(TURNS), none).alias("c"), F.coalesce(F.col(rejected_col).cast(TURNS), none).alias("r"))
    pair = pair.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(F.col(x), F.col("n") + 1, F.size(x))
    return pair.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_prompt"),
        rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"),
        rendered(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"),
        mask(rest("r")).alias("rejected_mask"),
    )


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table (conv_id, turn, role, text), in order of turn (null
    first), role and text; a repeated row counts once; rows without conv_id belong to none."""
    rows = df.select("conv_id", "turn", "role", "text").where("conv_id is not null").distinct()
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def last_answers(df: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of a conversations table: chosen is the conversation
    up to its last assistant turn; in rejected, that turn says again what the assistant
    said before (nothing, if it had not spoken). Others without an assistant give no pair."""
    c = conversations(df)
    roles = F.transform("turns", lambda t: F.coalesce(t["role"], F.lit("")) == LEARNED)
    c = c.withColumn("last", (F.size("turns") - F.array_position(F.reverse(roles), F.lit(True)) + 1).cast("int")).where(F.exists("turns", lambda t: t["role"] == LEARNED))
    before = F.filter(F.slice("turns", F.lit(1), F.col("last") - 1), lambda t: t["role"] == LEARNED)
    said = F.when(F.size(before) > 0, F.try_element_at(before, F.lit(-1))["text"]).otherwise("")
    again = F.array(F.struct(F.lit(LEARNED).alias("role"), said.alias("text")))
    return c.select("conv_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), again).alias("rejected"))


def mask_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


ORACLE = """
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL
), l AS (SELECT conv_id, max(turn) AS last FROM d WHERE role = 'assistant' GROUP BY conv_id
), b AS (SELECT d.conv_id, coalesce(arg_max(text, turn), '') AS before FROM d JOIN l USING (conv_id) WHERE role = 'assistant' AND turn < last GROUP BY d.conv_id
), p AS (
  SELECT l.conv_id, count(*) FILTER (turn < last) AS n, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn) FILTER (turn < last) AS prompt,
    max(text) FILTER (turn = last) AS answer FROM d JOIN l USING (conv_id) GROUP BY l.conv_id
), x AS (SELECT p.*, coalesce(before, '') AS other, answer = coalesce(before, '') AS equal FROM p LEFT JOIN b USING (conv_id)
), y AS (
  SELECT conv_id, n, coalesce(prompt, '') AS prompt, equal, '<|assistant|>' || chr(10) || answer || '<|end|>' || chr(10) AS c, '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) AS r FROM x
)
SELECT conv_id, (n + equal::INT)::INT AS n_prompt, prompt || CASE WHEN equal THEN c ELSE '' END AS prompt,
  CASE WHEN equal THEN '' ELSE c END AS chosen, CASE WHEN equal THEN '' ELSE r END AS rejected,
  CASE WHEN equal THEN '' ELSE '14:' || len(c) END AS chosen_mask, CASE WHEN equal THEN '' ELSE '14:' || len(r) END AS rejected_mask
FROM y
"""
