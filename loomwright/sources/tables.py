"""Reading tables of one or many databases, and their catalog."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.text import python_number

# Tables that belong to the storage itself and are never profiled.
SYSTEM_TABLES = ("sqlite_sequence",)

CATALOG_SCHEMA = (
    "db_id string, table_name string, table_ord int, column_name string, column_ord int, column_type string, pk int"
)


CELL_SCHEMA = "db_id string, table_name string, column_name string, value string"


def scan_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a database kept as ``<folder>/<table>.parquet``."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def scan_database(spark: SparkSession, folder: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    return {t: scan_table(spark, folder, t) for t in tables if t not in SYSTEM_TABLES}


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make the tables available to ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


_TEXT = (T.StringType,)
_WHOLE = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
_FRACTIONAL = (T.DoubleType, T.FloatType)


def _long_cells(df: DataFrame, names: Mapping[str, str], text_only: bool) -> DataFrame:
    """Non-null cells ``(column_name, value)`` of the columns that have a text form, in one scan. ``names`` says what to put
    for each column."""
    kinds = _TEXT if text_only else _TEXT + _WHOLE + _FRACTIONAL
    fields = [f for f in df.schema.fields if isinstance(f.dataType, kinds)]
    if not fields:
        return df.sparkSession.createDataFrame([], "column_name string, value string")
    texts = [
        F.col(f.name).cast("double" if isinstance(f.dataType, _FRACTIONAL) else f.dataType).cast("string").alias(names[f.name])
        for f in fields
    ]
    long = df.select(*texts).unpivot([], [names[f.name] for f in fields], "column_name", "value")
    # Only fractions can be written differently; the check is made once per cell, not once per column.
    fractions = [names[f.name] for f in fields if isinstance(f.dataType, _FRACTIONAL)]
    value = F.col("value")
    if fractions:
        value = F.when(F.col("column_name").isin(fractions), python_number(value)).otherwise(value)
    return long.where(F.col("value").isNotNull()).select("column_name", value.alias("value"))


def cells(df: DataFrame, table: str, db_id: str, text_only: bool = False) -> DataFrame:
    """All non-null cells of a table in long form ``(db_id, table_name, column_name, value)``, in one scan.

    Values are texts as Python's ``str`` gives them. Columns without such a form (dates, arrays) are left out; with
    ``text_only`` numbers are too, and then are not read.
    """
    long = _long_cells(df, {c: c for c in df.columns}, text_only)
    return long.select(F.lit(db_id).alias("db_id"), F.lit(table).alias("table_name"), "column_name", "value")


def scan_distinct_values(databases: Mapping[str, Mapping[str, DataFrame]], text_only: bool = False) -> DataFrame:
    """The distinct non-null values of every column of every database, as one job with one shuffle.

    Columns travel under a short number and get their names back afterwards (a list as long as the catalog), so that no names
    are shuffled with each value. Duplicates are dropped map-side first: a hot value or column sends one row per task.
    """
    columns: list[tuple[str, str, str]] = []
    frames = []
    for db_id, tables in databases.items():
        for table, df in tables.items():
            if table in SYSTEM_TABLES:
                continue
            numbers = {c: str(len(columns) + i) for i, c in enumerate(df.columns)}
            columns += [(db_id, table, c) for c in df.columns]
            frames.append(_long_cells(df, numbers, text_only))
    key = ("db_id", "table_name", "column_name")
    names = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(key, c)]) for c in columns])
    return (
        union_all(frames)
        .distinct()
        .select(F.get(names, F.col("column_name").cast("int")).alias("_name"), "value")
        .select("_name.*", "value")
    )


def _rarely_rewritten(number: Column) -> Column:
    """``python_number`` of a double, for use in many places of one plan: its rules stand in a lambda, so that they are neither repeated
    wherever the value is used nor compiled for each column. Only texts with an exponent and the special values go there."""
    text = number.cast("double").cast("string")
    return F.when(text.rlike("[EIN]"), F.get(F.transform(F.array(text), python_number), F.lit(0))).otherwise(text)


def scan_smallest_values(databases: Mapping[str, Mapping[str, DataFrame]], n: int = 2) -> DataFrame:
    """``(db_id, table_name, column_name, ord, value)``: the ``n`` smallest distinct values of every column, by their text.

    One job over all tables finds the smallest value of each column, the next one the smallest above it, and so on. Per table that is an
    aggregate without groups: each table is scanned once a job, and a task sends one row. What comes back is one value per column
    of the catalog; the next job compares with it as a literal.
    """
    scans = []
    for db_id, tables in databases.items():
        for table, df in tables.items():
            fields = [f for f in df.schema.fields if isinstance(f.dataType, _TEXT + _WHOLE + _FRACTIONAL)]
            if table in SYSTEM_TABLES or not fields:
                continue
            texts = [
                (_rarely_rewritten(F.col(f.name)) if isinstance(f.dataType, _FRACTIONAL) else F.col(f.name).cast("string")).alias(f.name)
                for f in fields
            ]
            scans.append((db_id, table, df.select(*texts), [f.name for f in fields]))
    spark = next(df.sparkSession for tables in databases.values() for df in tables.values())
    found, before = [], {}
    for k in range(1, n + 1):
        jobs = []
        for i, (db_id, table, wide, names) in enumerate(scans):
            left = [c for c in names if k == 1 or (db_id, table, c) in before]
            above = [F.col(c) if k == 1 else F.when(F.col(c) > F.lit(before[db_id, table, c]), F.col(c)) for c in left]
            if left:
                least = F.array(*[F.struct(F.lit(c).alias("column"), F.min(a).alias("value")) for c, a in zip(left, above)])
                jobs.append(wide.agg(least.alias("least")).select(F.lit(i).alias("scan"), "least"))
        rows = union_all(jobs).collect() if jobs else []
        before = {(*scans[r.scan][:2], x.column): x.value for r in rows for x in r.least if x.value is not None}
        found += [(*key, k, value) for key, value in before.items()]
    return spark.createDataFrame(found, "db_id string, table_name string, column_name string, ord int, value string")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def scan_cells(databases: Mapping[str, Mapping[str, DataFrame]], text_only: bool = False) -> DataFrame:
    """The cells of every table of every database, as one job."""
    return union_all(
        cells(df, table, db_id, text_only)
        for db_id, tables in databases.items()
        for table, df in tables.items()
        if table not in SYSTEM_TABLES
    )


def catalog_columns(
    spark: SparkSession,
    databases: Mapping[str, Mapping[str, DataFrame]],
    primary_keys: Mapping[tuple[str, str], Sequence[str]] | None = None,
) -> DataFrame:
    """One row per column: lower-cased names and type, position, and 1-based place in the primary key (0: not in it).

    Parquet has no keys, so they come from ``primary_keys[(db_id, table)]``.
    """
    primary_keys = primary_keys or {}
    rows = []
    for db_id, tables in databases.items():
        names = [t for t in tables if t not in SYSTEM_TABLES]
        for table_ord, table in enumerate(names):
            key = [c.lower() for c in primary_keys.get((db_id, table), ())]
            for column_ord, field in enumerate(tables[table].schema.fields):
                name = field.name.lower()
                pk = key.index(name) + 1 if name in key else 0
                kind = field.dataType.simpleString().lower()
                rows.append((db_id, table.lower(), table_ord, name, column_ord, kind, pk))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def non_null_counts(databases: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """Non-null cells of every column, ``(db_id, table_name, column_name, non_null)``: one aggregate per table."""
    parts = []
    for db_id, tables in databases.items():
        for table, df in tables.items():
            if table in SYSTEM_TABLES:
                continue
            counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
            pairs = [F.struct(F.lit(c.lower()).alias("column_name"), F.col(c).alias("non_null")) for c in df.columns]
            parts.append(
                counts.select(
                    F.lit(db_id).alias("db_id"), F.lit(table.lower()).alias("table_name"), F.inline(F.array(*pairs))
                )
            )
    return union_all(parts)
