"""Mixing sources to target shares of words.

Every row gets a seeded random key; within its source rows stand in the order of that key, cut into slices of the key's range.
Words are summed per (source, slice), prefix sums of these few numbers say in which slice a source's budget ends, and only that
slice is sorted row by row. All rows before the cut are taken, whole epochs are repeated first, and the row at the cut gives as
many words as are left, so that every source meets its budget exactly.

Defined cases: a null text has no words; a null source is one source, last in order; a source without words gives none; no rows
give no rows; rows with equal keys (one id) stand by text; columns of the input with the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import BLANK, keep, shuffle_key, slice_bits, slice_of, source_key, word_count

SEED = 20
# Rows that a slice should hold; one slice of each source is sorted with its texts.
CUT_ROWS = 2_048
# Sources in order weigh 1, 2, 3, 1, 2, 3 ...; none gives more than three times its words. Fixed by the contract.
WEIGHTS = 3
MOST = 3


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (``__source``, ``source_size``) with ``target``: all words shared by weight, at most ``MOST`` times a
    source's own, what is above shared again by weight among the others.

    Sources are filled in the order in which they reach their limit, so one pass of running sums gives what the repeated
    sharing ends with. One row per source passes one task.
    """
    cap = F.col("source_size") * MOST
    ranked = sources.withColumn("__weight", (F.row_number().over(Window.orderBy("__source")) - 1) % WEIGHTS + 1)
    by_limit = Window.orderBy(cap / F.col("__weight"), "__source")
    full = F.coalesce(F.sum(cap).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("__weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - full) / weight
    # The level at which the first source stays below its limit is the one that holds.
    fits = F.when(level <= cap / F.col("__weight"), level)
    filled = ranked.withColumn("__fits", fits).withColumn("__nth", F.row_number().over(by_limit))
    level = F.min_by("__fits", F.when(F.col("__fits").isNotNull(), F.col("__nth"))).over(whole)
    return filled.withColumn("target", F.least(cap.cast("double"), level * F.col("__weight"))).drop("__fits", "__nth", "__weight")


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` (``doc_id, text, source`` and any others) with ``size, source_size, target, taken``: the words of the row, of its
    source, the source's target, and how many words of the row the mix takes, repeats counted.

    Rows do not move, except those of the slices in which the budgets end.
    """
    bits = slice_bits(docs.count(), CUT_ROWS)
    size = word_count(F.col("text"))
    rows = (
        docs.drop("size", "source_size", "target", "taken")
        .withColumn("__source", source_key(F.col("source")))
        .withColumn("__key", shuffle_key(seed, F.col("doc_id")))
        .withColumn("__slice", slice_of(F.col("__key"), bits))
    )
    slices = keep(rows.groupBy("__source", "__slice").agg(F.sum(size).alias("__words")))
    planned = targets(slices.groupBy("__source").agg(F.sum("__words").alias("source_size")))
    budget = F.round("target").cast("long")
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("__budget") / F.col("source_size"))).otherwise(0)
    planned = planned.withColumn("__budget", budget).withColumn("__epochs", repeats.cast("long"))
    planned = planned.withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("source_size"))
    upto = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    summed = slices.withColumn("__upto", F.sum("__words").over(upto)).join(planned, "__source")
    # The first slice that reaches the rest holds the cut.
    cuts = summed.where("__upto >= __rest").groupBy("__source", "source_size", "target", "__epochs", "__rest").agg(
        F.min("__slice").alias("__cut"), F.min_by(F.col("__upto") - F.col("__words"), "__slice").alias("__before")
    )
    cuts = keep(cuts.coalesce(1))
    placed = rows.join(cuts, "__source")
    whole = F.col("__epochs") * F.col("size")
    part = F.when(F.col("__slice") < F.col("__cut"), F.col("size")).otherwise(F.lit(0))
    apart = placed.where("__slice <> __cut").withColumn("size", size).withColumn("taken", whole + part)
    inside = Window.partitionBy("__source").orderBy("__key", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__rest") - F.col("__before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    at_cut = placed.where("__slice = __cut").withColumn("size", size)
    at_cut = at_cut.withColumn("taken", whole + F.greatest(F.lit(0), F.least("size", left)))
    hidden = ["__source", "__key", "__slice", "__epochs", "__rest", "__cut", "__before"]
    return apart.unionByName(at_cut).drop(*hidden)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, with the blanks before each word as they are."""
    words = F.split(text, rf"(?<=[^{BLANK}])(?=[{BLANK}])", -1)
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus itself with the columns of ``docs``: each row as often as it is taken, the last time with the first
    words only where a budget ends inside it. A row of which no word is taken is left out."""
    names = docs.columns
    counted = mix(docs.select("doc_id", "text", "source", F.struct(*names).alias("__row")), seed).where("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    nth = counted.select("*", F.explode(F.sequence(F.lit(1), times)).alias("__nth"))
    part = F.col("taken") - (F.col("__nth") - 1) * F.col("size")
    cut = F.when(part >= F.col("size"), F.col("text")).otherwise(first_words(F.col("text"), part))
    rows = nth.select("__row.*", cut.alias("__text"))
    return rows.select(*(F.col("__text").alias(c) if c == "text" else F.col(c) for c in names))
