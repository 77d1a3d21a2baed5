"""Preference formatting of paired conversations, in DataFrame functions only.

The turns that chosen and rejected conversation share from the start become one prompt; the rest of each becomes a
completion with a mask in runs, which trains on assistant turns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
END = "<|end|>\n"


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("\n" + END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def mask(turns: Column) -> Column:
    """Runs ``flag*characters``, comma-joined, in the order of the rendered text: 1 trains, 0 doesn't."""

    def run(turn: Column) -> Column:
        trained = F.coalesce(turn["role"] == TRAINED_ROLE, F.lit(False)).cast("int").cast("string")
        sizes = [F.char_length(x).cast("string") for x in (header(turn), body(turn))]
        return F.concat(F.lit("0*"), sizes[0], F.lit(","), trained, F.lit("*"), sizes[1])

    return F.array_join(F.transform(turns, run), ",")


def preferences(turns: DataFrame) -> DataFrame:
    """(pair_id, n_prefix, n_chosen, n_rejected, prompt, chosen, rejected, chosen_mask, rejected_mask), one row per pair.

    ``turns`` has pair_id, chosen (boolean), turn, role and text; other columns are ignored. A side's turns go by
    turn, role, text, nulls first, so ties and repeated rows have a fixed order. Turns are equal if role and text are,
    null being equal to null; a null role or text renders as empty. A side without turns has an empty completion and
    shares no prompt. Rows without pair_id or side are left out. An empty table gives no row. A group is one pair of
    conversations, which is what one output row holds.
    """
    turn = F.struct("turn", "role", "text")
    sides = (
        turns.where("pair_id is not null and chosen is not null")
        .groupBy("pair_id")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("chosen"), turn))).alias("a"),
            F.sort_array(F.collect_list(F.when(~F.col("chosen"), turn))).alias("b"),
        )
    )
    return formatted(sides)


def formatted(sides: DataFrame) -> DataFrame:
    """The columns of :func:`preferences` from (pair_id, a, b), the sorted turns of chosen and rejected."""
    same = F.zip_with(
        "a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])
    )
    first_apart = F.array_position(same, F.lit(False))
    cut = sides.withColumn("n_prefix", F.when(first_apart > 0, first_apart - 1).otherwise(F.size(same)).cast("int"))
    rest = {s: F.slice(s, F.col("n_prefix") + 1, F.greatest(F.size(s), F.lit(1))) for s in ("a", "b")}
    return cut.select(
        "pair_id",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        F.size("a").cast("long").alias("n_chosen"),
        F.size("b").cast("long").alias("n_rejected"),
        render(F.slice("a", 1, F.col("n_prefix"))).alias("prompt"),
        render(rest["a"]).alias("chosen"),
        render(rest["b"]).alias("rejected"),
        mask(rest["a"]).alias("chosen_mask"),
        mask(rest["b"]).alias("rejected_mask"),
    )


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Turns for :func:`preferences` from a table without preferences: conversation 2k is chosen over 2k + 1."""
    conv = F.col("conv_id")
    return conversations.select(
        F.floor(conv / 2).cast("long").alias("pair_id"), (F.pmod(conv, F.lit(2)) == 0).alias("chosen"), "turn", "role", "text"
    )


def answered_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, a, b) for :func:`formatted` from a table without preferences: a conversation as it is is chosen over the
    same one that ends with the last turn of the conversation whose id comes next by one, or without a last turn if there
    is none. So the sides share all turns but the last.

    Turns go by turn, role, text, nulls first; turns equal to the last count as the last. Rows without an id are left out;
    an empty table gives no row. Conversations are shuffled once; beside that only last turns are.
    """
    known = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.struct("turn", "role", "text").alias("t"))
    whole = known.groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias("a")).withColumn("last", F.element_at("a", -1))
    ends = known.groupBy("pair_id").agg(F.max("t").alias("end")).select((F.col("pair_id") - 1).alias("pair_id"), "end")
    answer = F.struct(F.col("last.turn").alias("turn"), F.col("end.role").alias("role"), F.col("end.text").alias("text"))
    before = F.filter("a", lambda t: t < F.col("last"))
    other = F.when(F.col("end").isNull(), before).otherwise(F.sort_array(F.concat(before, F.array(answer))))
    return whole.join(ends, "pair_id", "left").select("pair_id", "a", other.alias("b"))
