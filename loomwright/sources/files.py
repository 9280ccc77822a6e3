"""Reading and writing the record files: examples, corpora, predictions, documents, token blocks, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.arrays import zip_shortest
from loomwright.functions.text import strip
from loomwright.operators.corpus import MAX_TOKEN_ID
from loomwright.operators.ordering import ordered_index

SCHEMA_RECORD = (
    "struct<schema_items:array<struct<table_name:string,table_comment:string,column_names:array<string>,"
    "column_types:array<string>,column_comments:array<string>,column_contents:array<array<string>>,"
    "pk_indicators:array<int>>>,foreign_keys:array<array<string>>>"
)
EXAMPLE_SCHEMA = f"text string, sql string, schema {SCHEMA_RECORD}, matched_contents map<string,array<string>>"
CLASSIFIER_SCHEMA = f"text string, schema {SCHEMA_RECORD}, table_labels array<int>, column_labels array<array<int>>"
GOLD_SCHEMA = "question string, sql string"
CORPUS_SCHEMAS = {
    "pure_sql": "sql string",
    "text2code": "text string, code string",
    "text2text": "input_text string, output_text string",
}


def read_examples(spark: SparkSession, path: str, schema: str = EXAMPLE_SCHEMA, lines: bool = False) -> DataFrame:
    """A JSON array of records per file; with ``lines`` one record per line, which splits over tasks and should be preferred
    for large files."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def nested_schema(record) -> list:
    """``schema_items`` and ``foreign_keys`` of an example's ``schema`` record in the nested form that rendering takes: the
    parallel lists zipped (the shortest wins), the key lists as structs."""

    def item(table, i):
        columns = zip_shortest(
            name=table["column_names"],
            type=table["column_types"],
            comment=table["column_comments"],
            contents=table["column_contents"],
            pk=table["pk_indicators"],
        )
        return F.struct(
            i.alias("table_ord"),
            table["table_name"].alias("table_name"),
            table["table_comment"].alias("table_comment"),
            columns.alias("columns"),
        )

    def edge(parts):
        names = ("src_table", "src_column", "ref_table", "ref_column")
        return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])

    return [
        F.transform(record["schema_items"], item).alias("schema_items"),
        F.transform(record["foreign_keys"], edge).alias("foreign_keys"),
    ]


def content_entries(matched):
    """The ``matched_contents`` map as ordered entries (a JSON object keeps its order when read)."""
    return F.transform(F.map_entries(matched), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("values")))


def read_corpus(spark: SparkSession, path: str, corpus: str) -> DataFrame:
    """One of the three JSONL corpora."""
    return spark.read.schema(CORPUS_SCHEMAS[corpus]).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, pred_sql)``: one stripped query per line, numbered from 0 in the order of file name and line."""
    lines = spark.read.text(path).select(
        strip("value").alias("pred_sql"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return ordered_index(lines, ["_file", "_block", "_line"], name="line_no").select("line_no", "pred_sql")


def write_documents(documents: DataFrame, path: str) -> None:
    """Content documents ``id, contents`` as JSON lines with everything beyond ASCII escaped."""
    written = documents.select("id", "contents")
    written.write.mode("overwrite").option("writeNonAsciiCharacterAsCodePoint", True).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, contents string").json(path)


def write_blocks(blocks: DataFrame, path: str, ranged: bool = False) -> None:
    """Packed blocks, each file a range of them in order; ``ranged`` says that their partitions are such ranges already. Fails when an id
    does not fit the two bytes in which token ids are kept."""
    fits = F.forall("input_ids", lambda i: (i >= 0) & (i <= MAX_TOKEN_ID))
    checked = blocks.where(F.assert_true(fits, F.lit("token id beyond two bytes")).isNull())
    rows = checked.select("block_id", "input_ids")
    rows = rows if ranged else rows.repartitionByRange("block_id")
    rows.sortWithinPartitions("block_id").write.mode("overwrite").parquet(path)


def read_blocks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Blocks with mask and labels; a range of block numbers only reads the files and row groups that hold it."""
    df = spark.read.schema("block_id bigint, input_ids array<int>").parquet(path)
    if first is not None:
        df = df.where(F.col("block_id") >= first)
    if last is not None:
        df = df.where(F.col("block_id") <= last)
    return df.select(
        "block_id",
        "input_ids",
        F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"),
        F.col("input_ids").alias("labels"),
    )


METRICS_SCHEMA = "run_id string, gpu int, tag string, step bigint, value double"


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append to the metrics log, one folder per tag."""
    metrics.select("run_id", "gpu", "tag", "step", "value").write.mode("append").partitionBy("tag").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).parquet(path)
