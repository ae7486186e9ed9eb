"""Preference formatting of chat data.

A pair is two conversations, chosen and rejected, as rows (pair_id, turn, role, text). Their longest common turn
prefix is found by joining the turns and taking the smallest place at which they differ; it is rendered once as the
prompt, and what follows becomes two masked completions. The result has one row per rendered turn, so that a
conversation of any length stays spread: ``part`` (prompt, chosen, rejected, or unpaired), ``place``, ``rendered``, and the part
of it to learn from, ``learn_from`` to ``learn_to`` (0-based characters, end exclusive). Only assistant turns of
completions are learned from, with their end mark but without their header.

Turns are ordered by ``turn`` (nulls last), and where a turn is repeated by role and text, so equal rows are turns of
their own. Null roles and texts count as empty. If one side is a prefix of the other, its completion is empty (no
rows); equal conversations give only a prompt. A null pair_id is a pair like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HEAD, TAIL = ("<|", "|>\n"), "<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """Normalised turns with ``copy``, the number of a row among those of the same turn."""
    turns = conversations.select(
        "pair_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return turns.withColumn("copy", F.row_number().over(Window.partitionBy("pair_id", "turn").orderBy("role", "text")))


def _place() -> Column:
    return F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.col("copy").alias("copy"))


def divergence(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, first): the first place at which normalised turns differ, one row per pair that differs."""
    a = chosen.select("pair_id", "turn", "copy", F.struct("role", "text").alias("a"))
    b = rejected.select(F.col("pair_id").alias("_p"), F.col("turn").alias("_t"), F.col("copy").alias("_c"), F.struct("role", "text").alias("b"))
    same = F.col("pair_id").eqNullSafe(F.col("_p")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("copy") == F.col("_c"))
    differ = a.join(b, same, "full_outer").where("a IS NULL OR b IS NULL OR a <> b")
    turn = F.when(F.col("a").isNull(), F.col("_t")).otherwise(F.col("turn"))
    pair = F.when(F.col("a").isNull(), F.col("_p")).otherwise(F.col("pair_id"))
    places = differ.select(pair.alias("pair_id"), turn.alias("turn"), F.coalesce("copy", "_c").alias("copy"))
    return places.groupBy("pair_id").agg(F.min(_place()).alias("first"))


def formatted(chosen: DataFrame, rejected: DataFrame, unpaired: DataFrame | None = None) -> DataFrame:
    """Rendered turns of all pairs; see the module. ``unpaired`` turns belong to neither side: they are rendered and
    kept as a part of their own, and never learned from."""
    chosen, rejected = _turns(chosen), _turns(rejected)
    first = divergence(chosen, rejected).select(F.col("pair_id").alias("_p"), "first")
    head = F.concat(F.lit(HEAD[0]), F.col("role"), F.lit(HEAD[1]))
    before = F.col("first").isNull() | (_place() < F.col("first"))

    def side(turns: DataFrame, name: str) -> DataFrame:
        return turns.join(first, F.col("pair_id").eqNullSafe(F.col("_p")), "left").withColumn(
            "part", F.when(before, F.lit("prompt")).otherwise(F.lit(name))
        )

    rows = side(chosen, "chosen").unionByName(side(rejected, "rejected").where("part = 'rejected'"))
    if unpaired is not None:
        rows = rows.unionByName(_turns(unpaired).withColumn("part", F.lit("unpaired")), allowMissingColumns=True)
    learns = F.col("part").isin("chosen", "rejected") & (F.col("role") == "assistant")
    return rows.withColumn("rendered", F.concat(head, F.col("text"), F.lit(TAIL))).select(
        "pair_id", "part", "turn", "copy", "role", "rendered",
        F.when(learns, F.length(head)).otherwise(0).cast("long").alias("learn_from"),
        F.when(learns, F.length("rendered")).otherwise(0).cast("long").alias("learn_to"),
    )


def shortened_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chosen and rejected sides, and unpaired turns, from plain conversations (conv_id, turn, role, text).

    Chosen is the conversation up to its last assistant turn; rejected is the same with that turn's text cut to half
    its characters, an answer that breaks off. Conversations without a numbered assistant turn are whole on both sides.
    In all others what follows the last assistant turn, and turns without a number, are unpaired.
    """
    ends = (
        conversations.where("role = 'assistant'").groupBy(F.col("conv_id").alias("_c")).agg(F.max("turn").alias("last_turn"))
    )
    every = conversations.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    paired = F.col("last_turn").isNull() | F.coalesce(F.col("turn") <= F.col("last_turn"), F.lit(False))
    rows, rest = every.where(paired), every.where(~paired).select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    chosen = rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    cut = (F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant")
    half = F.expr("substring(text, 1, cast(length(text) div 2 AS int))")
    rejected = rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(cut, half).otherwise(F.col("text")).alias("text"))
    return chosen, rejected, rest
