"""Preference formatting, in DataFrame operations only.

Chosen and rejected conversations of a pair are compared turn by turn: the longest common turn prefix
is rendered once, as the prompt, and what follows becomes two completions, each with a
mask of the character spans to learn: the assistant's own words and the end mark behind them.
The comparison is an aggregation over turns; only the rendering brings a conversation's turns together, in the row
that has to hold it anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vispark.llm.common import whole_text

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Whose turns a completion learns.
LEARNED = "assistant"


def numbered(turns: DataFrame) -> DataFrame:
    """pair_id, turn, role, text -> pair_id, pos from 0, role, text; ties and nulls of turn have a fixed order.

    A conversation is ordered by one task, as one row has to hold it in the end; that goes for the rows without a pair_id, too,
    which are one conversation.
    """
    role = F.coalesce(turns["role"].cast("string"), F.lit(""))
    rows = turns.select(turns["pair_id"].alias("pair_id"), turns["turn"].alias("turn"), role.alias("role"), whole_text(turns).alias("text"))
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    return rows.select("pair_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def rendered(turns: Column) -> Column:
    """Text of an array of turns."""
    one = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def learned_spans(turns: Column) -> Column:
    """start:end of each learned stretch in the rendered text, in code points, comma-joined."""
    head = lambda t: F.length(t["role"]) + len(OPEN) + len(MIDDLE)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + head(t)
        end = start + F.length(t["text"]) + len(CLOSE) - 1
        span = F.array(F.concat_ws(":", start.cast("string"), end.cast("string")))
        spans = F.when(t["role"] == LEARNED, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step, lambda acc: acc["spans"]), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair_id of either table: the prompt, both completions and both masks.

    Both tables have pair_id, turn, role, text.  Turns are equal when role and text are (null counts as
    empty).  A pair that only one table has gets an empty other side; equal conversations give two empty
    completions.  Repeated turns keep a fixed order; a null pair_id is a pair of its own; other columns
    are ignored; empty tables give no rows.
    """
    sides = [numbered(t).withColumn("side", F.lit(i)) for i, t in enumerate((chosen, rejected))]
    turns = sides[0].unionByName(sides[1])
    at = turns.groupBy("pair_id", "pos").agg(
        F.max(F.when(F.col("side") == 0, F.struct("role", "text"))).alias("c"),
        F.max(F.when(F.col("side") == 1, F.struct("role", "text"))).alias("r"),
    )
    differ = ~(F.col("c").eqNullSafe(F.col("r")))
    one = lambda c: F.struct("pos", F.col(f"{c}.role").alias("role"), F.col(f"{c}.text").alias("text"))
    pairs = at.groupBy("pair_id").agg(
        F.min(F.when(differ, F.col("pos"))).alias("first"),
        F.count("c").alias("n_chosen"),
        F.count("r").alias("n_rejected"),
        F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), one("c")))).alias("cs"),
        F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), one("r")))).alias("rs"),
    )
    pairs = pairs.withColumn("prefix", F.coalesce("first", F.col("n_chosen")).cast("int"))
    tail = lambda c: F.filter(c, lambda t: t["pos"] >= F.col("prefix"))
    pairs = pairs.select(
        "pair_id",
        F.col("prefix").cast("long").alias("prompt_turns"),
        F.filter("cs", lambda t: t["pos"] < F.col("prefix")).alias("ps"),
        tail("cs").alias("cs"),
        tail("rs").alias("rs"),
    )
    return pairs.select(
        "pair_id",
        "prompt_turns",
        rendered(F.col("ps")).alias("prompt"),
        rendered(F.col("cs")).alias("chosen"),
        rendered(F.col("rs")).alias("rejected"),
        learned_spans(F.col("cs")).alias("chosen_mask"),
        learned_spans(F.col("rs")).alias("rejected_mask"),
    )


def with_neighbours_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations: rejected ends in another's answer.

    Chosen is each conversation as it is.  Rejected has the same turns, but the text of its last assistant turn is
    that of the conversation whose conv_id is one higher; where there is none, that turn is left out.
    """
    c = conversations
    text = whole_text(c)
    turns = c.select(
        c["conv_id"].alias("pair_id"),
        c["turn"].alias("turn"),
        F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
    )
    last = turns.where(F.col("role") == LEARNED).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.text").alias("other"))
    swap = last.where("pair_id is not null").join(other, "pair_id", "left")
    swap = swap.select("pair_id", F.col("last.turn").alias("turn"), F.col("last.text").alias("text"), "other")
    swap = swap.withColumn("role", F.lit(LEARNED)).withColumn("swapped", F.lit(True))
    rejected = turns.join(swap, ["pair_id", "turn", "role", "text"], "left")
    rejected = rejected.where("swapped is null or other is not null")
    return turns, rejected.select("pair_id", "turn", "role", F.coalesce("other", "text").alias("text"))
