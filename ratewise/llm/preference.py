"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common prefix of turns (same role and text) is rendered once as the
prompt; what follows on either side is rendered as that side's completion.  A
completion's mask is a run-length list of (characters, trained): headers and
turns of other roles are not trained, an assistant's text and end mark are.

Defined cases: NULL roles and texts are empty; equal turn numbers of a
conversation are ordered by role, then text, and repeated rows stay; equal
conversations have all turns in the prompt and empty completions; a pair that
one side lacks is left out; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.llm.common import col, materialise, partitions
from ratewise.operators.windows import order_key, with_range

ASSISTANT = "assistant"
_END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(_END))), "")


def _mask(turns: Column) -> Column:
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.length(_head(t)).alias("characters"), F.lit(False).alias("trained")),
        F.struct((F.length(t["text"]) + len(_END)).alias("characters"),
                 (t["role"] == ASSISTANT).alias("trained")))))


def _turns(turn: str = "turn") -> Column:
    """A group's turns in order, NULL roles and texts as empty ones."""
    return F.sort_array(F.collect_list(F.struct(
        F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))


def format_sides(pairs: DataFrame) -> DataFrame:
    """One row per row (pair_id, c, r) of ``pairs``: the chosen and the rejected turns in order."""
    same = F.transform(F.arrays_zip("c", "r"), lambda z: (z["c"]["role"] == z["r"]["role"])
                       & (z["c"]["text"] == z["r"]["text"]))
    # the pair's first turn that differs; beyond the shorter side the comparison is NULL
    first = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    n = F.when(first == 0, F.size("c")).otherwise(first - 1).cast("int")
    both = pairs.select("pair_id", "c", "r").withColumn("n", n)
    tail = lambda side: F.slice(side, F.col("n") + 1, F.size(side) - F.col("n"))
    return both.select(
        "pair_id", F.col("n").alias("prompt_turns"),
        (F.size("c") - F.col("n")).alias("chosen_turns"), (F.size("r") - F.col("n")).alias("rejected_turns"),
        _render(F.slice("c", 1, F.col("n"))).alias("prompt"),
        _render(tail("c")).alias("chosen"), _mask(tail("c")).alias("chosen_mask"),
        _render(tail("r")).alias("rejected"), _mask(tail("r")).alias("rejected_mask"))


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair from the turns (pair_id, turn, role, text) of both sides."""
    c, r = (side.groupBy("pair_id").agg(_turns().alias(name)) for side, name in ((chosen, "c"), (rejected, "r")))
    return format_sides(c.join(r, "pair_id"))


def _successors(replies: DataFrame) -> DataFrame:
    """(pair_id, other): the reply of the next conversation that has one, by id; the last is followed by the first.

    Ids are dealt into ranges; inside a range the next row is at hand, and the last of a
    range takes the first of the next one: one small row per range.
    """
    ranges = partitions(replies.sparkSession)
    dealt = with_range(replies, order_key(replies, ["pair_id"]), ranges, "part")
    inside = Window.partitionBy("part").orderBy("pair_id")
    edges = dealt.groupBy("part").agg(F.min_by("own", "pair_id").alias("own"))
    over = Window.orderBy("part")  # at most one row per range
    edges = edges.select("part", F.coalesce(F.lead("own").over(over), F.first("own").over(over)).alias("edge"))
    return dealt.withColumn("inner", F.lead("own").over(inside)).join(edges, "part") \
        .select("pair_id", F.coalesce("inner", "edge").alias("other"))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """(pair_id, c, r) from plain conversations (conv_id, turn, role, text), one row for each of them.

    Chosen is the whole conversation.  Rejected is the conversation up to its last
    assistant turn, with that turn's text replaced by the last assistant turn's of the
    conversation that follows by conv_id among those that have one; the last is
    followed by the first.  A conversation without an assistant turn is on both sides
    as it is: all prompt, nothing to train.  NULL turn numbers come first; rows
    without a conv_id are left out.
    """
    turns = conversations.select(*[col(c) for c in ("conv_id", "turn", "role", "text")]).where("conv_id is not null")
    whole = materialise(turns.groupBy(F.col("conv_id").alias("pair_id")).agg(_turns().alias("c")), "preference-turns")
    # the place of the last assistant turn, 0 without one
    last = F.aggregate(F.sequence(F.lit(1), F.size("c")), F.lit(0), lambda at, k: F.when(
        F.get("c", k - 1)["role"] == ASSISTANT, k).otherwise(at))
    whole = whole.withColumn("last", last)
    replies = whole.where("last > 0").select("pair_id", F.get("c", F.col("last") - 1)["text"].alias("own"))
    swapped = F.transform(F.slice("c", 1, "last"), lambda t, k: F.when(
        k == F.col("last") - 1, t.withField("text", F.col("other"))).otherwise(t))
    return whole.join(_successors(replies), "pair_id", "left") \
        .select("pair_id", "c", F.when(F.col("last") > 0, swapped).otherwise(F.col("c")).alias("r"))


def mask_text(mask: str) -> Column:
    """A mask as text: lengths in order, '+' behind trained ones and '-' behind others."""
    return F.array_join(F.transform(mask, lambda m: F.concat(
        m["characters"].cast("string"), F.when(m["trained"], "+").otherwise("-"))), " ")


#: DuckDB SQL for ``op3``: turns numbered, the next reply by lead(), texts by ordered aggregates.
ORACLE = """
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT conv_id, count(*) AS n, max(k) FILTER (role = 'assistant') AS stop FROM numbered GROUP BY conv_id),
replies AS (SELECT conv_id, stop, body AS own FROM ends JOIN numbered USING (conv_id) WHERE k = stop),
swaps AS (
  SELECT conv_id, own, coalesce(lead(own) OVER w, first_value(own) OVER w) AS other FROM replies WINDOW w AS (ORDER BY conv_id)),
cuts AS (
  SELECT conv_id, CASE WHEN stop IS NULL THEN n ELSE stop - (own <> other)::INT END AS shared, own <> other AS swapped, other
  FROM ends LEFT JOIN swaps USING (conv_id)),
written AS (
  SELECT conv_id, k, k <= shared AS common, concat('<|', role, '|>', chr(10), body, '<|end|>', chr(10)) AS txt,
    concat(length(role) + 5, '- ', length(body) + 8, CASE role WHEN 'assistant' THEN '+' ELSE '-' END) AS mask
  FROM numbered JOIN cuts USING (conv_id)),
sides AS (
  SELECT conv_id, string_agg(txt, '' ORDER BY k) FILTER (common) AS prompt, string_agg(txt, '' ORDER BY k) FILTER (NOT common) AS chosen,
    string_agg(mask, ' ' ORDER BY k) FILTER (NOT common) AS chosen_mask
  FROM written GROUP BY conv_id)
SELECT conv_id, shared::INTEGER AS prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
  coalesce(chosen_mask, '') AS chosen_mask,
  CASE WHEN swapped THEN concat('<|assistant|>', chr(10), other, '<|end|>', chr(10)) ELSE '' END AS rejected,
  CASE WHEN swapped THEN concat('14- ', length(other) + 8, '+') ELSE '' END AS rejected_mask
FROM cuts JOIN sides USING (conv_id)
"""
