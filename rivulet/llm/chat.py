"""Preference formatting: paired completions of a chosen and a rejected conversation behind their common prompt.

For each pair the longest common prefix of turns (same role and text) is rendered once as the prompt; the turns after
it are each side's completion. Of a completion, assistant turns are trained on and all else is masked: ``*_spans``
lists the half-open character ranges that count, ``*_trained`` their total.

Only DataFrame expressions are used. Turns are aligned by a sort within each conversation and one aggregation by pair
and position, so a conversation's turns meet in a task only to be joined into their own text.

Defined results: turns are ordered by turn (nulls first), role and text; exact repeats of a row count once; a null role
is "unknown" and a null text is empty; turns without a conversation id are left out; a conversation without its partner
gives a pair with that side absent (``complete`` false, an empty prompt); an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The markers around a rendered turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def aligned_turns(turns: DataFrame) -> DataFrame:
    """Turns with pair_id, side and idx: conversation 2k is the chosen side of pair k, 2k + 1 the rejected one."""
    conv = F.col("conv_id").cast("long")
    rows = turns.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = F.lag(F.struct("turn", "role", "text")).over(order).eqNullSafe(F.struct("turn", "role", "text"))
    rows = rows.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), F.pmod("conv_id", F.lit(2)).cast("int").alias("side"), "turn", "role", "text").withColumn("again", same)
    return rows.filter(~F.col("again")).withColumn("idx", F.row_number().over(order) - 1).drop("again")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """A row for each pair: prompt, completions, the spans that are trained on, and the turns of each part."""
    rows = aligned_turns(turns)
    side = lambda k, c: F.max(F.when(F.col("side") == k, c))
    turn = F.struct("role", "text")
    cells = rows.groupBy("pair_id", "idx").agg(side(0, turn).alias("chosen"), side(1, turn).alias("rejected"))
    # The first position at which the sides differ; a side that has ended differs from one that has not.
    pair = cells.groupBy("pair_id").agg(
        F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("idx"))).alias("differs"),
        F.count(F.lit(1)).alias("longest"),
        F.count("chosen").alias("chosen_turns"),
        F.count("rejected").alias("rejected_turns"),
        F.array_sort(F.collect_list(F.struct("idx", "chosen", "rejected"))).alias("cells"),
    ).withColumn("common", F.coalesce("differs", "longest"))

    def part(name: str, keep) -> Column:
        cells = F.filter("cells", lambda c: keep(c["idx"]) & c[name].isNotNull())
        return F.transform(cells, lambda c: F.struct(c[name]["role"].alias("role"), rendered(c[name]["role"], c[name]["text"]).alias("text"), F.char_length(c[name]["text"]).alias("n")))

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda c: c["text"]), "")

    def spans(parts: Column) -> Column:
        """Ranges of assistant turns' text and closing marker: what follows their opening line."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, c: Column) -> Column:
            begin = acc["at"] + F.char_length(c["role"]) + len(OPEN) + len(MIDDLE)
            end = acc["at"] + F.char_length(c["text"])
            mine = F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))  # without the last line break
            return F.struct(end.alias("at"), F.when(c["role"] == "assistant", F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(parts, start, step, lambda acc: acc["spans"])

    common = F.col("common")
    parts = pair.select(
        "pair_id", "common", "chosen_turns", "rejected_turns",
        part("chosen", lambda i: i < common).alias("prompt_parts"),
        part("chosen", lambda i: i >= common).alias("chosen_parts"),
        part("rejected", lambda i: i >= common).alias("rejected_parts"),
    )
    return parts.select(
        "pair_id",
        ((F.col("chosen_turns") > 0) & (F.col("rejected_turns") > 0)).alias("complete"),
        F.col("common").cast("long").alias("common_turns"),
        F.col("chosen_turns").cast("long").alias("chosen_turns"),
        F.col("rejected_turns").cast("long").alias("rejected_turns"),
        joined(F.col("prompt_parts")).alias("prompt"),
        joined(F.col("chosen_parts")).alias("chosen"),
        joined(F.col("rejected_parts")).alias("rejected"),
        spans(F.col("chosen_parts")).alias("chosen_spans"),
        spans(F.col("rejected_parts")).alias("rejected_spans"),
    )


def flat_pairs(pairs: DataFrame) -> DataFrame:
    """Spans as text ("start-end,start-end") and the characters that they cover."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return pairs.select(
        "pair_id", "complete", "common_turns", "chosen_turns", "rejected_turns", "prompt", "chosen", "rejected",
        text("chosen_spans").alias("chosen_spans"), text("rejected_spans").alias("rejected_spans"),
        total("chosen_spans").alias("chosen_trained"), total("rejected_spans").alias("rejected_trained"),
    )
