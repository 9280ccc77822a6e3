"""Exact duplicates, with frequent texts split off.

A Misra-Gries summary (``freqItems``: one bounded map per task, merged) names the digests that may be frequent. Their exact
counts and smallest ids are found by a map-side aggregate, those really frequent are broadcast (at most ``HEAVY`` rows) and
settle their rows where they are read. All other digests hold fewer than ``1 / HEAVY`` of the rows and are shuffled by digest.

Defined cases: a null text counts as empty; empty texts are copies of each other; a null id is larger than any id; of rows
with the same id and text one stays; no rows give no rows; further columns are kept by ``deduplicate`` and ignored by ``copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import BLANK, keep, text_or_empty

# Counters of the summary: a digest with more than 1/HEAVY of all rows is certain to be in it.
HEAVY = 256


def normalised(text: Column | str) -> Column:
    """The text with every run of blanks replaced by one space."""
    return F.regexp_replace(text_or_empty(text), rf"[{BLANK}]+", " ")


def digest(text: Column | str) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def frequent(digests: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``(text_sha256, keep_id, group_size)`` of the digests with more than ``1 / heavy`` of the rows; at most ``heavy`` rows."""
    found = digests.stat.freqItems(["text_sha256"], 1 / heavy).select(F.explode(F.col("text_sha256_freqItems")).alias("text_sha256"))
    rows = digests.count()
    exact = digests.join(F.broadcast(found), "text_sha256").groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return keep(exact.where(F.col("group_size") * heavy > rows).coalesce(1))


def _settled(digests: DataFrame, winners: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, n, keep_id, group_size`` per id and digest: rows with one id and one text differ in nothing, so
    they travel as one row with a count."""
    alike = ["text_sha256", "doc_id"]
    n = F.count(F.lit(1)).alias("n")
    hot = digests.join(F.broadcast(winners), "text_sha256").groupBy(*alike, "keep_id", "group_size").agg(n)
    group = Window.partitionBy("text_sha256")
    cold = (
        digests.join(F.broadcast(winners), "text_sha256", "left_anti")
        .repartition("text_sha256")
        .groupBy(*alike)
        .agg(n)
        .withColumn("keep_id", F.min("doc_id").over(group))
        .withColumn("group_size", F.sum("n").over(group))
    )
    return hot.unionByName(cold)


def copies(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``; ``docs`` has ``doc_id`` and ``text``."""
    digests = keep(docs.select("doc_id", digest("text").alias("text_sha256")))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    rows = _settled(digests, frequent(digests, heavy)).withColumn("nth", nth)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay. Of rows with the same id and text the one stays whose columns,
    written as JSON, are smallest. Rows of frequent texts are dropped where they are read, before whole rows are shuffled."""
    digests = keep(docs.select("doc_id", digest("text").alias("text_sha256")))
    winners = frequent(digests, heavy)
    staying = _settled(digests, winners).where("doc_id <=> keep_id").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"), F.col("n").alias("__n")
    )
    names = docs.columns
    hot = winners.select(F.col("text_sha256").alias("__digest"), F.col("keep_id").alias("__keep"), F.lit(True).alias("__hot"))
    left = (
        docs.withColumn("__digest", digest("text"))
        .join(F.broadcast(hot), "__digest", "left")
        .where("__hot is null or doc_id <=> __keep")
        .withColumn("__id", F.col("doc_id"))
    )
    found = left.join(
        staying, left["__id"].eqNullSafe(staying["__id"]) & (left["__digest"] == staying["__digest"])
    ).select(*(left[c] for c in names), staying["__digest"], "__n")
    row = F.struct(*names)
    repeated = found.where("__n > 1").groupBy("doc_id", "__digest").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return found.where("__n = 1").select(*names).unionByName(repeated.select("row.*"))
