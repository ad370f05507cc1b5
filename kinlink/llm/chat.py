"""Multi-party perspective rotation of dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """One more backslash inside every `<` backslashes `|`, so that no text can hold a marker."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def speaker_of(role: Column) -> Column:
    """The role without outer blanks; null or blank is the empty name, which no role has."""
    return F.coalesce(F.trim(role), F.lit(""))


def named(who: Column) -> Column:
    """The name of a speaker in a header: backslashes doubled, line ends as `\\n`, so that different names stay different and end at the line."""
    return escape(F.replace(F.replace(who, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def head(label: Column) -> Column:
    return F.concat(F.lit(OPEN), label, F.lit("\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """One row per conversation and participant: the whole dialogue with that speaker as the assistant.

    Columns: conv_id, perspective, n_turns, n_target_turns, rendered, masks (array of [start, stop) character ranges of rendered that the
    loss covers: the assistant's words and their end marker). Every distinct speaker but `system` is a participant; the others stand as
    `user name=...`, system turns as `system`. Turns are ordered by turn, then role, then text; repeated rows stay; a null turn number comes
    first; a null text is empty; a null or blank role is the speaker of the empty name; a null conv_id is a conversation like any other. A
    conversation of system turns only, or an empty table, gives no rows. Other columns are ignored. A rendered dialogue is one
    value and so has at most 2 GB.

    A turn's place is a running sum over the conversation with every speaker as a user, and a participant's own turns move it by
    the difference of the two headers each: one shuffle and one sort by conversation serve all perspectives, in time linear in the output.
    """
    label = lambda who: F.when(who == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), named(who)))
    said = conversations.select("conv_id", "turn", speaker_of(F.col("role")).alias("who"), F.coalesce("text", F.lit("")).alias("text"))
    said = said.select("*", head(label(F.col("who"))).alias("head"), F.concat(escape(F.col("text")), F.lit(CLOSE)).alias("body"))
    order = [F.col("turn").asc_nulls_first(), "who", "text"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("head") + F.length("body") + 1).over(before), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("conv_id", "who").orderBy(*order)) - 1
    placed = said.select("conv_id", F.struct("turn", "who", "text", "head", "body", at.alias("at"), nth.alias("nth")).alias("said"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    people = F.array_except(F.array_distinct(F.transform("said", lambda s: s.who)), F.array(F.lit("system")))
    views = whole.select("conv_id", "said", F.explode(people).alias("perspective"))

    own = head(F.lit("assistant"))
    shift = F.length(own) - F.length(head(label(F.col("perspective"))))
    start = lambda s: s["at"] + s.nth * shift + F.length(own)
    mine = F.filter("said", lambda s: s.who == F.col("perspective"))
    masks = F.transform(mine, lambda s: F.struct(start(s).cast("int").alias("start"), (start(s) + F.length(s.body)).cast("int").alias("stop")))
    turns = F.transform("said", lambda s: F.concat(F.when(s.who == F.col("perspective"), own).otherwise(s["head"]), s.body, F.lit("\n")))
    return views.select("conv_id", "perspective", F.size("said").alias("n_turns"), F.size(mine).alias("n_target_turns"), F.array_join(turns, "").alias("rendered"), masks.alias("masks"))
