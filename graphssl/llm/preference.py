"""Preference formatting of chat pairs.

``preference_rows`` takes a chosen and a rejected conversation per row, finds
their longest common prefix of turns (equal role and text), renders it once as
the prompt, and renders what follows in each as a completion.  A completion's mask
holds the spans that are trained on: text and end mark of its assistant turns,
as code point offsets ``begin-end`` joined by ``;``.  DataFrame functions only.

``swapped_replies`` makes such pairs from a table of conversations: the rejected
one has the last assistant reply of the next conversation (ascending conv_id;
after the last the first) in place of its own.

Defined results: turns sort by (turn, role, text), nulls first; null roles and
texts are empty; turns with a null conv_id belong to no conversation and are left
out; equal conversations share everything and have empty completions; if one
ends where the other goes on, its completion is empty; a conversation without an
assistant turn gets the other's reply appended as the rejected turn; a
conversation without a reply lends an empty one; a single conversation is paired
with itself; an empty table gives an empty table; other columns never matter.  A
conversation is one row, as long as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphssl.llm.common import partitions, ranges_with_next

#: The chat template around a turn, and the role that is trained.
OPEN, AFTER_ROLE, CLOSE, END = "<|turn|>", "\n", "<|end|>", "\n"
TRAINED = "assistant"

_TURNS = "array<struct<role:string,text:string>>"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(AFTER_ROLE))


def _piece(turn: Column) -> Column:
    return F.concat(_header(turn), turn["text"], F.lit(CLOSE + END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _piece), "")


def mask(turns: Column) -> Column:
    """Spans of the rendered turns that are trained on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(z: Column, x: Column) -> Column:
        begin = z["at"] + F.length(_header(x))
        end = begin + F.length(x["text"]) + len(CLOSE)
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(x["role"] == TRAINED, F.concat(z["spans"], F.array(span))).otherwise(z["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, add)["spans"], ";")


def shared_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    k = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, F.lit(1), k), F.slice(b, F.lit(1), k), lambda x, y: x == y)
    differ = F.array_position(equal, False)
    return F.when(differ == 0, k).otherwise(differ - 1).cast("int")


def preference_rows(pairs: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected)``, turns as ``array<struct<role,text>>``, to
    ``pair_id, n_shared, prompt, chosen, chosen_mask, rejected, rejected_mask``."""
    clean = pairs.select("pair_id", *[
        F.transform(F.coalesce(F.col(c), F.array().cast(_TURNS)), lambda x: F.struct(
            F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text"))).alias(c)
        for c in ("chosen", "rejected")])
    n = clean.withColumn("n_shared", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = {c: F.slice(F.col(c), F.col("n_shared") + 1, F.size(c)) for c in ("chosen", "rejected")}
    return n.select("pair_id", F.col("n_shared").cast("long").alias("n_shared"),
                    rendered(F.slice(F.col("chosen"), F.lit(1), F.col("n_shared"))).alias("prompt"),
                    rendered(rest["chosen"]).alias("chosen"), mask(rest["chosen"]).alias("chosen_mask"),
                    rendered(rest["rejected"]).alias("rejected"), mask(rest["rejected"]).alias("rejected_mask"))


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` from ``(conv_id, turn, role, text)`` rows."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    per = (turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
           .agg(F.sort_array(F.collect_list(row)).alias("turns")))
    return per.withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs of every conversation with itself under the next one's last reply."""
    own = conversations(turns)
    last = F.array_max(F.transform("turns", lambda x, i: F.when(x["role"] == TRAINED, i)))
    own = own.withColumn("last", last).withColumn(
        "reply", F.when(F.col("last").isNotNull(), F.get("turns", F.col("last"))["text"]).otherwise(F.lit("")))
    in_order = Window.partitionBy("_range").orderBy("_guest", "conv_id")
    dealt = (ranges_with_next(own, "conv_id", partitions(turns.sparkSession))
             .withColumn("other", F.lead("reply").over(in_order)).filter("_guest = 0"))
    new = F.struct(F.lit(TRAINED).alias("role"), F.col("other").alias("text"))
    swapped = F.when(F.col("last").isNull(), F.concat("turns", F.array(new))).otherwise(
        F.transform("turns", lambda x, i: F.when(i == F.col("last"), new).otherwise(x)))
    return dealt.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), swapped.alias("rejected"))
