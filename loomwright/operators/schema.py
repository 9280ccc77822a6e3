"""Database schemas: comments, foreign keys, nesting, and cutting to the most relevant tables and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.prompt import label_text

EDGE = ["src_table", "src_column", "ref_table", "ref_column"]


def comment_enrich(columns: DataFrame, table_comments: DataFrame, column_comments: DataFrame) -> DataFrame:
    """Add ``table_comment`` and ``column_comment`` to catalog rows; empty text where none is recorded.

    Inputs: ``table_comments(db_id, table_name, table_comment)`` and
    ``column_comments(db_id, table_name, column_name, column_comment)``. A column comment counts only if its table is
    recorded too.
    """
    tables = table_comments.select("db_id", "table_name", "table_comment")
    known = column_comments.join(tables.select("db_id", "table_name"), ["db_id", "table_name"], "left_semi")
    return (
        columns.join(tables, ["db_id", "table_name"], "left")
        .join(
            known.select("db_id", "table_name", "column_name", "column_comment"),
            ["db_id", "table_name", "column_name"],
            "left",
        )
        .fillna("", ["table_comment", "column_comment"])
    )


def foreign_key_edges(declared: DataFrame) -> DataFrame:
    """Declared keys with source column, target table and target column all present, lower-cased."""
    return declared.dropna(subset=["src_column", "ref_table", "ref_column"]).select(
        "db_id", *[F.lower(c).alias(c) for c in EDGE]
    )


def schema_columns(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """Catalog rows with ``contents``, the ordered sample values of each column (an empty array if there are none)."""
    per_column = samples.groupBy(
        "db_id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")
    ).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda v: v["value"]).alias("contents"))
    return columns.join(per_column, ["db_id", "table_name", "column_name"], "left").withColumn(
        "contents", F.coalesce("contents", F.array().cast("array<string>"))
    )


def schema_tables(columns: DataFrame, keys: Sequence[str] = ("db_id",)) -> DataFrame:
    """Nest the columns of each table, in order."""
    column = F.struct(
        "column_ord",
        F.col("column_name").alias("name"),
        F.col("column_type").alias("type"),
        F.col("column_comment").alias("comment"),
        "contents",
        "pk",
    )
    return columns.groupBy(*keys, "table_name", "table_ord", "table_comment").agg(
        F.array_sort(F.collect_list(column)).alias("columns")
    )


def schema_build(columns: DataFrame, edges: DataFrame, keys: Sequence[str] = ("db_id",)) -> DataFrame:
    """One nested schema per ``keys``: ``schema_items`` (ordered tables with ordered columns) and ``foreign_keys``.

    Groups are as large as a database's catalog, never as its data.
    """
    keys = list(keys)
    items = schema_tables(columns, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("table_ord", "table_name", "table_comment", "columns"))).alias("schema_items")
    )
    links = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*EDGE))).alias("foreign_keys"))
    empty = F.array().cast("array<struct<src_table:string,src_column:string,ref_table:string,ref_column:string>>")
    return items.join(links, keys, "left").withColumn("foreign_keys", F.coalesce("foreign_keys", empty))


def schema_topk(
    columns: DataFrame,
    question: str = "question_id",
    table_score: str = "table_score",
    column_score: str = "column_score",
    table_num: int = 6,
    column_num: int = 10,
) -> DataFrame:
    """Keep the best ``table_num`` tables per question and the best ``column_num`` columns of each.

    One input row per (question, table, column) with both scores; ties go to the earlier table or column. The scores are an
    input: relevance from a classifier when evaluating, or :func:`training_score` when training.
    """
    by_table = Window.partitionBy(question).orderBy(F.desc(table_score), "table_ord")
    by_column = Window.partitionBy(question, "table_name").orderBy(F.desc(column_score), "column_ord")
    return (
        columns.withColumn("table_rank", F.dense_rank().over(by_table))
        .where(F.col("table_rank") <= table_num)
        .withColumn("column_rank", F.row_number().over(by_column))
        .where(F.col("column_rank") <= column_num)
    )


def training_score(label, *keys, seed: int = 0):
    """Score for training mode: items the gold query uses come first, the rest follow in a seeded random order."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.concat(F.when(label != 0, F.lit("1")).otherwise("0"), draw)


def edges_within(edges: DataFrame, selected: DataFrame, on: Sequence[str] = ("db_id",), by_column: bool = False) -> DataFrame:
    """Edges whose both ends are among the ``selected`` tables (with ``by_column``: columns), matched on ``on`` too."""
    on = list(on)
    out = edges
    for side in ("src", "ref"):
        names = [F.col("table_name").alias(f"{side}_table")]
        if by_column:
            names.append(F.col("column_name").alias(f"{side}_column"))
        ends = selected.select(*on, *names).distinct()
        out = out.join(ends, ends.columns, "left_semi")
    return out


def classifier_examples(records: DataFrame) -> DataFrame:
    """Classifier inputs per question: table texts and labels, column texts per table, all column labels in one list.

    Input: ``text``, ``schema_items``, ``table_labels``, ``column_labels``.
    """
    return records.select(
        *[c for c in records.columns if c not in ("schema_items", "table_labels", "column_labels")],
        F.transform("schema_items", lambda t: label_text(t["table_name"], t["table_comment"])).alias("table_names"),
        F.col("table_labels"),
        F.transform(
            "schema_items", lambda t: F.transform(t["columns"], lambda c: label_text(c["name"], c["comment"]))
        ).alias("column_infos"),
        F.flatten("column_labels").alias("column_labels"),
    )
