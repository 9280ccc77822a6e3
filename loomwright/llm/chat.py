"""Preference pairs of conversations, formatted for training.

A pair has two conversations, ``chosen`` and ``rejected``. Their longest common prefix of turns is the prompt and is rendered once;
the turns after it are the two completions. Only what an assistant says in a completion is trained on.

The result stays in long form, one row per pair, part and turn, so that a conversation of any length is never gathered: ``part``
(``prompt``, ``chosen``, ``rejected``), ``turn`` and ``nth`` (tells rows of one turn number apart), ``rendered`` and ``mask`` (1: trained
on). The rows of a part joined in the order of ``turn`` and ``nth`` give its text.

Defined cases: a null role reads ``user``, a null text is empty; rows without conversation or turn number stand last as one group
(null equals null); rows of one turn number stand by role and text, and all of them are kept; a pair that differs in its first turn has no prompt, equal
conversations have no completions; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def _numbered(turns: DataFrame) -> DataFrame:
    """The turns with ``nth``, which tells rows of the same turn number apart."""
    body = turns.select(
        "pair", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return body.withColumn("nth", F.row_number().over(Window.partitionBy("pair", "turn").orderBy("role", "text")))


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair, part, turn, nth, role, rendered, mask`` of two frames ``pair, turn, role, text``.

    The end of the prompt is the first (turn, nth) at which the sides differ: one full join of the turns, then a minimum with
    map-side combine. A pair of many turns spreads over the join's partitions by turn.
    """
    keys = ("pair", "turn", "nth")
    side = lambda f, p: f.select(
        *(F.col(c).alias(f"{p}_{c}") for c in keys), F.struct("role", "text").alias(p)
    )
    a, b = side(_numbered(chosen), "a"), side(_numbered(rejected), "b")
    here = F.lit(True)
    for c in keys:
        here = here & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    both = a.join(b, here, "full").select(*(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in keys), "a", "b")
    at = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.col("nth").alias("nth"))
    differs = ~(F.col("a.role").eqNullSafe(F.col("b.role")) & F.col("a.text").eqNullSafe(F.col("b.text")))
    ends = both.where(differs).groupBy("pair").agg(F.min(at).alias("end")).withColumnRenamed("pair", "p")
    placed = both.join(ends, F.col("pair").eqNullSafe(F.col("p")), "left")
    placed = placed.withColumn("common", F.col("end").isNull() | (at < F.col("end")))
    parts = F.when(F.col("common"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("a").alias("row")))).otherwise(
        F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("a").alias("row")),
            F.struct(F.lit("rejected").alias("part"), F.col("b").alias("row")),
        )
    )
    rows = placed.select("pair", "turn", "nth", F.explode(parts).alias("x")).where("x.row is not null")
    role = F.col("x.row.role")
    return rows.select(
        "pair",
        F.col("x.part").alias("part"),
        "turn",
        "nth",
        role.alias("role"),
        render(role, F.col("x.row.text")).alias("rendered"),
        ((F.col("x.part") != "prompt") & (role == ASSISTANT)).cast("int").alias("mask"),
    )


def with_other_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs out of plain conversations (``conv_id, turn, role, text``), for corpora without judgements.

    Chosen is the conversation itself. Rejected is the same up to its last assistant turn, which is taken from the neighbour
    (``conv_id`` xor 1) that answers something else; without an assistant turn there, the rejected side ends before it.
    """
    turns = conversations.select(F.col("conv_id").alias("pair"), "turn", "role", "text")
    last = (
        turns.where(F.col("role") == ASSISTANT)
        .groupBy("pair")
        .agg(F.max("turn").alias("last"), F.max_by("text", F.struct("turn", "text")).alias("reply"))
    )
    ends = last.select(F.col("pair").alias("p"), "last")
    before = turns.join(ends, F.col("pair").eqNullSafe(F.col("p")), "left").where("last is null or turn < last")
    other = last.select((F.col("pair").bitwiseXOR(F.lit(1))).alias("o"), "reply")
    reply = ends.join(other, F.col("p") == F.col("o")).select(
        F.col("p").alias("pair"), F.col("last").alias("turn"), F.lit(ASSISTANT).alias("role"), F.col("reply").alias("text")
    )
    return turns, before.select("pair", "turn", "role", "text").unionByName(reply)
