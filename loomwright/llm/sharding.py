"""Cutting a corpus into shards that all have the mixture of the whole.

Rows of each source stand in a seeded random order; a row's fractional rank is its place in its source divided by the rows of
the source. All rows are sorted by fractional rank, which deals the sources out evenly, and cut into runs whose lengths differ by
at most one (law ``rows``). Both ranks are distributed prefix sums (``rows_before``): no source and no run goes through one task.

Defined cases: a null text has no bytes; a null source is one source, last in order; of rows with one id the shorter and then
the one with the smaller checksum comes first; no rows give no rows; fewer rows than shards leave the last shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import keep, rows_before, shuffle_key, slice_bits, slice_of, source_key, text_or_empty

SEED = 10
SHARDS = 24
# Added to the bytes of every text, as a record's header. Fixed by the contract.
HEADER = 8


def shards(docs: DataFrame, n: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, source, law, shard, slot, grown_shard``; ``slot`` counts from 0 in each
    shard."""
    text = text_or_empty("text")
    rows = keep(
        docs.select(
            "doc_id",
            "source",
            (F.octet_length(text) + HEADER).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            source_key(F.col("source")).alias("__source"),
            shuffle_key(seed, F.col("doc_id")).alias("__key"),
        )
    )
    total = rows.count()
    bits = slice_bits(total)
    order = [F.col(c) for c in ("__key", "doc_id", "size", "text_crc32")]
    ranked = rows_before(
        rows.withColumn("__slice", slice_of(F.col("__key"), bits)), ["__source"], "__slice", order, "__rank"
    )
    of_source = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__of"))
    ranked = keep(ranked).join(keep(of_source.coalesce(1)), "__source")
    # (rank + 1/2) / rows lies between 0 and 1.
    ranked = ranked.withColumn("__share", (F.col("__rank") * 2 + 1) / (F.col("__of") * 2))
    ranked = ranked.withColumn("__slice", F.floor(F.col("__share") * 2**bits)).withColumn("__all", F.lit(0))
    placed = rows_before(ranked, ["__all"], "__slice", [F.col("__share"), *order], "__at")
    shard = F.expr(f"__at * {n} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {n - 1}) div {n}")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        "source",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("__at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
