"""Examples for fine-tuning, from nested records: the schema and its matched values cut, rendered as a prompt, made into features.

A record has ``schema_items`` (ordered tables with ordered ``columns``), ``foreign_keys`` and ``entries`` (ordered ``(key, values)`` with key
``table.column``). All steps up to the prompt are projections inside the record; no table of (question, column) is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.logits import let
from loomwright.functions.prompt import content_sequence, prompt_prefix, schema_sequence
from loomwright.operators import corpus, features
from loomwright.operators.schema import training_score


def best_places(scores: Column, num: int) -> Column:
    """Places (from 0, ascending) of the ``num`` highest scores; of equal scores the earlier ones."""
    ranked = F.sort_array(F.transform(scores, lambda s, i: F.struct(s.alias("score"), (-i).alias("before"))), asc=False)
    return F.array_sort(F.transform(F.slice(ranked, 1, num), lambda r: -r["before"]))


def label_scores(records: DataFrame, question: str = "question_id", seed: int = 0) -> DataFrame:
    """Add ``table_scores`` and ``column_scores`` for training from ``table_labels`` and ``column_labels`` (arrays beside the tables and their
    columns): what the gold query uses comes first, the rest in a seeded random order. A missing label counts as 0."""
    q = F.col(question)

    def of_table(table: Column, labels: Column) -> Column:
        return F.zip_with(
            table["columns"], F.coalesce(labels, F.array().cast("array<int>")),
            lambda c, label: training_score(label, q, table["table_name"], c["name"], seed=seed),
        )

    return records.withColumn(
        "table_scores",
        F.zip_with("schema_items", "table_labels", lambda t, label: training_score(label, q, t["table_name"], seed=seed)),
    ).withColumn("column_scores", F.zip_with("schema_items", "column_labels", of_table))


def cut_records(records: DataFrame, table_num: int = 6, column_num: int = 10, by_column: bool = False) -> DataFrame:
    """Cut every record to its best ``table_num`` tables and their best ``column_num`` columns by ``table_scores`` and ``column_scores``.

    What stays keeps its order. Foreign keys stay when both their tables (with ``by_column``: both their columns) do, matched values when
    their column does. Scores are dropped. A record without tables stays as it is, without keys and values.
    """

    # What a lambda's body refers to is bound by let: Spark may put the expression of a column there, and compute it for each element.
    def item(table: Column, scores: Column) -> Column:
        columns = F.transform(best_places(scores, column_num), lambda j: F.get(table["columns"], j))
        return table.withField("columns", columns)

    def items(record: Column) -> Column:
        tables, scores = record["tables"], record["scores"]
        return F.transform(best_places(F.col("table_scores"), table_num), lambda i: let(F.get(tables, i), lambda t: item(t, F.get(scores, i))))

    def ends(edge: Column) -> list[Column]:
        if by_column:
            return [F.concat_ws(".", edge[f"{side}_table"], edge[f"{side}_column"]) for side in ("src", "ref")]
        return [edge["src_table"], edge["ref_table"]]

    def names(table: Column) -> Column:
        return F.transform(table["columns"], lambda c: F.concat_ws(".", table["table_name"], c["name"]))

    record = F.struct(F.col("schema_items").alias("tables"), F.col("column_scores").alias("scores"))
    cut = records.withColumn("schema_items", let(record, items))
    cut = cut.withColumn("_columns", F.flatten(F.transform("schema_items", names))).withColumn(
        "_ends", F.col("_columns") if by_column else F.transform("schema_items", lambda t: t["table_name"])
    )

    def has_ends(names: Column, edge: Column) -> Column:
        src, ref = ends(edge)
        return F.array_contains(names, src) & F.array_contains(names, ref)

    cut = cut.withColumn("foreign_keys", let(F.col("_ends"), lambda names: F.filter("foreign_keys", lambda edge: has_ends(names, edge))))
    cut = cut.withColumn("entries", let(F.col("_columns"), lambda names: F.filter("entries", lambda e: F.array_contains(names, e["key"]))))
    return cut.drop("_columns", "_ends", "table_scores", "column_scores")


def prompts(records: DataFrame, text: str = "text") -> DataFrame:
    """Add ``prefix``, the prompt of each record, and drop the nested columns it is made of."""
    schema = schema_sequence(F.col("schema_items"), F.col("foreign_keys"))
    made = records.withColumn("prefix", prompt_prefix(schema, content_sequence(F.col("entries")), F.col(text)))
    return made.drop("schema_items", "foreign_keys", "entries")


# Characters of prompts and targets in one partition, where they are tokenised.
TASK_CHARS = 8_000_000


def sft_features(
    prompted: DataFrame, vocab: DataFrame, key: str, max_tokens: int, bos: int, pad: int, target: str = "sql", keep: Sequence[str] = ()
) -> DataFrame:
    """``key``, ``input_ids``, ``attention_mask`` and ``labels`` of ``prefix`` and ``target``, one row per ``key``; with ``keep`` (columns of
    ``prompted``) one row per row of it. Rows are partitioned by ``key`` once, as plain text, and both texts tokenised there; a null ``key`` is dropped.
    ``prompted`` is read twice, first for the size of its texts."""
    rows = prompted.where(F.col(key).isNotNull()).select(key, "prefix", target, *[F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)])
    size = F.coalesce(F.length("prefix"), F.lit(0)) + F.coalesce(F.length(target), F.lit(0))
    parts = (rows.agg(F.sum(size)).first()[0] or 0) // TASK_CHARS + 1
    columns = [c for c in rows.columns if c != key]
    together = rows.repartition(parts, key).groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    to_ids = corpus.ids_of_texts(vocab)

    def ids(column: str) -> Column:
        return to_ids(F.filter(F.transform("_rows", lambda r: r[column]), lambda t: t.isNotNull()))

    def unmarked(ids: str) -> Column:
        return F.slice(ids, F.lit(1), F.size(ids) - 1)

    tokens = together.select(key, "_rows", ids("prefix").alias("_p"), ids(target).alias("_t"))
    kept = F.transform("_rows", lambda r: F.struct(*[r[f"_kept_{i}"].alias(c) for i, c in enumerate(keep)])).alias("_rows")
    both = tokens.select(key, *([kept] if keep else []), unmarked("_p").alias("prefix_ids"), unmarked("_t").alias("target_ids"))
    made = features.features_train(both, max_tokens, bos, corpus.EOS, pad)
    return made.select(*[c for c in made.columns if c != "_rows"], F.inline("_rows")) if keep else made
