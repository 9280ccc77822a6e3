"""Row numbers and running sums over a global or per-group order, without a single-partition window.

A plain ``row_number() over (order by …)`` pulls all rows into one task, and ``partition by g`` does the same for a hot
``g``. Here the rows are range-partitioned by the whole order, so a hot group spreads over many partitions, and only one
summary row per (partition, group) goes through an ordinary window.

The order columns must identify a row; ties would make the numbers arbitrary. Pass narrow frames (keys and weights only)
and join the result back on the key: the range sampler reads its input twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import cut_lineage

# monotonically_increasing_id() keeps the partition in the upper bits and the position inside it in the lower 33.
_POSITION_BITS = 33
# Summary rows that are broadcast.
BROADCAST_ROWS = 100_000


def ordered_index(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    name: str = "idx",
    weight: str | None = None,
    offset: str = "offset",
) -> DataFrame:
    """Add ``name``, the 0-based position of each row in its ``group`` by ``order``; with ``weight`` also ``offset``, the sum
    of ``weight`` over the rows before it."""
    group = list(group)
    keys = group + list(order)
    placed = cut_lineage(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_part", F.shiftright("_row", _POSITION_BITS))
    summaries = [F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first")]
    if weight is not None:
        summaries.append(F.sum(F.col(weight).cast("bigint")).alias("_weight"))
        running = Window.partitionBy("_part", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_before", F.coalesce(F.sum(F.col(weight).cast("bigint")).over(running), F.lit(0)))

    # One row per (partition, group): at most partitions + groups rows, and per group at most one per partition.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part", *group).agg(*summaries)
    bases = parts.select(
        F.col("_part").alias("_bpart"),
        *[F.col(g).alias(f"_b_{g}") for g in group],
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        *([F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_weight_before")] if weight is not None else []),
    )
    # One row per partition, and few more unless there are many groups: then the rows stay where they are, otherwise both are shuffled.
    bases = cut_lineage(bases)
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    same = F.col("_part") == F.col("_bpart")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_b_{g}"))
    index = (F.col("_row") - F.col("_first") + F.col("_rows_before")).alias(name)
    columns: list[Column | str] = [*df.columns, index]
    if weight is not None:
        columns.append((F.col("_before") + F.col("_weight_before")).alias(offset))
    return placed.join(bases, same).select(*columns)


def overlapping_chunks(
    df: DataFrame, order: Sequence[str], group: Sequence[str], lookback: int, chunk_rows: int = 100_000
) -> tuple[DataFrame, list[str]]:
    """Cut every group into runs of ``chunk_rows`` rows (at least twice the look-back), each led by the ``lookback`` rows before it.

    Windows that look back at most ``lookback`` rows may then partition by the returned columns (group and ``_chunk``),
    whose size is bounded however large the group is. Rows with ``_lead`` true are context: drop them afterwards.
    """
    chunk_rows = max(chunk_rows, 2 * lookback)
    placed = ordered_index(df, order, group, name="_pos")
    home = F.expr(f"_pos div {chunk_rows}")
    is_tail = F.col("_pos") % chunk_rows >= chunk_rows - lookback
    copies = placed.withColumn(
        "_chunk", F.explode(F.when(is_tail, F.array(home, home + 1)).otherwise(F.array(home)))
    ).withColumn("_lead", F.col("_chunk") != home)
    return copies, [*group, "_chunk"]
