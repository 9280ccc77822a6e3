"""Profiling: distinct cell values, their numbered content documents, sample values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import MAX_VALUE_LENGTH, is_short_value, strip
from loomwright.operators.ordering import ordered_index

COLUMN_KEY = ["db_id", "table_name", "column_name"]
ID_SEPARATOR = "-**-"


def distinct_values(cells: DataFrame) -> DataFrame:
    """The distinct non-null values of every column, from :func:`loomwright.sources.tables.scan_cells`.

    Duplicates are dropped map-side first, so a hot value or column sends one row per task.
    """
    return cells.where(F.col("value").isNotNull()).select(*COLUMN_KEY, "value").distinct()


def value_counts(cells: DataFrame) -> DataFrame:
    """Non-null cells per column."""
    return cells.where(F.col("value").isNotNull()).groupBy(*COLUMN_KEY).agg(F.count(F.lit(1)).alias("non_null"))


def number_values(values: DataFrame) -> DataFrame:
    """Add ``c_id``: the position of a value among its column's distinct values, by value.

    Numbers are given before any length filter, so ids of kept values may have gaps.
    """
    return ordered_index(values, ["value"], COLUMN_KEY, name="c_id")


def short_values(values: DataFrame, limit: int = MAX_VALUE_LENGTH) -> DataFrame:
    """Strip the values and keep those of 1 to ``limit`` characters."""
    return values.withColumn("value", strip("value")).where(is_short_value("value", limit))


def content_documents(values: DataFrame, limit: int = MAX_VALUE_LENGTH) -> DataFrame:
    """Documents ``(id, contents)`` to index, with their key columns: numbered, stripped, short values."""
    kept = short_values(number_values(values), limit)
    doc_id = F.lower(F.concat_ws(ID_SEPARATOR, "table_name", "column_name", F.col("c_id").cast("string")))
    return kept.select(*COLUMN_KEY, "c_id", doc_id.alias("id"), F.col("value").alias("contents"))


def sample_values(smallest: DataFrame, limit: int = MAX_VALUE_LENGTH) -> DataFrame:
    """The samples of every column: its first distinct values (:func:`loomwright.sources.tables.scan_smallest_values`), then
    stripped and length-filtered, so that fewer may remain."""
    return short_values(smallest, limit)
