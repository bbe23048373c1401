"""Preference formatting: pairs of a chosen and a rejected conversation as prompt and masked completions.

The longest common prefix of turns (equal role and text) is rendered once as the prompt. What follows in either
conversation is a completion, with a mask in run lengths: for each turn its number of characters (its role line
included) and 1 if the model is to learn it (assistant) or 0. One row holds one pair, which is the training record.

Turns are ordered by turn, role and text, null turns first; repeated turns stay. Null roles and texts are rendered as
empty and equal each other. Equal conversations give empty completions. All other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit("\n"))


def _mask(turns: Column) -> Column:
    runs = F.transform(turns, lambda t: F.concat(
        F.length(render(t)), F.lit(":"), F.when(t["role"] == "assistant", "1").otherwise("0")))
    return F.array_join(runs, " ")


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask and rejected_mask of each pair.

    pairs: pair_id, and the turns of chosen and rejected as arrays of (turn, role, text); a null array is empty.
    """
    empty = "cast(array() as array<struct<turn: bigint, role: string, text: string>>)"
    sides = pairs.select("pair_id", *(F.coalesce(F.col(c), F.expr(empty)).alias(c) for c in ("chosen", "rejected")))
    chosen, rejected = F.col("chosen"), F.col("rejected")
    both = F.least(F.size(chosen), F.size(rejected))
    same = F.transform(F.slice(chosen, 1, both), lambda t, i: (
        F.coalesce(t["role"], F.lit("")) == F.coalesce(rejected[i]["role"], F.lit("")))
        & (F.coalesce(t["text"], F.lit("")) == F.coalesce(rejected[i]["text"], F.lit(""))))
    differs = F.array_position(same, F.lit(False))
    common = F.when(differs > 0, differs - 1).otherwise(both).cast("int")
    shared = sides.withColumn("n_prompt_turns", common)
    rest = {c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(c), F.lit(1))) for c in ("chosen", "rejected")}
    return shared.select(
        "pair_id", "n_prompt_turns", _text(F.slice(chosen, F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _text(rest["chosen"]).alias("chosen"), _text(rest["rejected"]).alias("rejected"),
        _mask(rest["chosen"]).alias("chosen_mask"), _mask(rest["rejected"]).alias("rejected_mask"))


def parroting_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs for preference_pairs: each conversation up to its last assistant turn, against the same conversation in
    which that turn only repeats what was said before it. Conversations without an assistant turn give none, and turns
    without a conv_id belong to no conversation: they are left out before anything is shuffled."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = conversations.filter("conv_id is not null").groupBy(F.col("conv_id").alias("pair_id")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"))
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    ended = turns.withColumn("last", last).filter("last is not null")
    answer = F.element_at("turns", F.col("last"))
    before = F.when(F.col("last") > 1, F.element_at("turns", F.greatest(F.col("last") - 1, F.lit(1)))["text"]).otherwise("")
    parrot = F.struct(answer["turn"].alias("turn"), answer["role"].alias("role"), before.alias("text"))
    return ended.select(
        "pair_id", F.slice("turns", F.lit(1), F.col("last")).alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), F.col("last") - 1), F.array(parrot)).alias("rejected"))
