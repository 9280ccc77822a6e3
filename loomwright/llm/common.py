"""What several operators of this package share: text rules, written intermediate tables, hash keys, linked groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.session import shared_folder

# Blanks between words, as the contracts of the operators name them. Fixed value.
BLANK = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\f\r"

# Rows that one slice of a hash order should hold: small enough to sort in a task, large enough to keep the table of slices small.
SLICE_ROWS = 16_384
# Rows with whole texts that go to a Python worker at a time, where several stages share the executors' memory.
BATCH_ROWS = 1_000

_written: dict[str, list[str]] = {}


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a new folder in the shared checkpoint folder, and go on from the written copy.

    Cuts the lineage in a way that survives lost executors, and keeps only the columns later steps read in their scans.
    ``remove_kept`` deletes the folders once the results that stand on them are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_kept(spark: SparkSession) -> None:
    """Delete the tables that ``keep`` wrote in this application. Call it when results that stand on them have been written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def text_blocks(texts: Sequence, chars: int = 1_000_000, size_of: Callable = lambda t: len(t or "")) -> Iterator[slice]:
    """Slices of ``texts`` of about ``chars`` characters, for work in a task whose memory follows the block."""
    start = size = 0
    for at, t in enumerate(texts, 1):
        size += size_of(t)
        if size >= chars or at == len(texts):
            yield slice(start, at)
            start, size = at, 0


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` whose tasks give back the memory of their batches as they end: workers wait for other stages beside the heap."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Spark send at most ``rows`` rows of whole texts at a time to a Python worker, from now on in this session; a smaller
    setting stays. A batch is held by the task, by the worker and by the stream between them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(before, rows) if before > 0 else rows))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no blanks, as a long; 0 for null. Every word, with the blanks before it, is
    replaced by one letter, so that no array of words is built."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{BLANK}]*+[^{BLANK}]++", "x")
    return F.length(F.rtrim(marks, F.lit(BLANKS))).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def source_key(source: Column) -> Column:
    """A text that is never null and sorts as the sources do by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def shuffle_key(seed: int, doc_id: Column) -> Column:
    """The place of a row in a seeded random order: 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def slice_bits(rows: int, slice_rows: int = SLICE_ROWS) -> int:
    """Into how many slices, as a power of two, a random order of ``rows`` rows is cut."""
    return min(30, max(0, (max(rows, 1) - 1).bit_length() - slice_rows.bit_length() + 1))


def slice_of(key: Column, bits: int) -> Column:
    """The slice of a ``shuffle_key``: its first ``bits`` bits. Slices in order hold the keys in order."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - bits)


def rows_before(rows: DataFrame, groups: list[str], slice_col: str, order: list[Column], out: str) -> DataFrame:
    """``rows`` with ``out``: how many rows of the same group come earlier by (slice, order).

    Distributed prefix sums: rows are counted per (group, slice), the small table of counts is summed up along the slices, and
    rows are numbered inside their slice only. No group goes through one task. ``groups`` and the slice must not be null.
    """
    keys = [*groups, slice_col]
    ahead = Window.partitionBy(*groups).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.join(bases, keys).withColumn(out, F.col("__base") + inside).drop("__base")


def linked_groups(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, group)``: the smallest node that each node of ``links`` can reach.

    Alternating large and small stars: each round hangs the neighbours of a node under the smallest of them. A hub's neighbours
    meet only in a minimum with map-side combine and in a join with one row for the hub, so none is gathered in a task. The
    rounds grow with the logarithm of the longest chain; each is written to the shared folder.
    """
    edges = keep(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large.where("u <> v"))
        # Here each edge goes from a node to a smaller one; hang those below a node, and the node itself, under the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = keep(small)
        if are_stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("group"))


def are_stars(edges: DataFrame) -> bool:
    """Whether every edge ``u -> v`` is the only one of its ``u`` and ends in a node that has none: then each connected group hangs
    under one node, which is its smallest as every edge goes to a smaller node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    of_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return of_node.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()
