"""Execution accuracy: are the results of a predicted query the same set of rows as those of the gold query?

Results of all items are kept in long form ``(item_id, side, row_no, row_key)`` with side ``pred`` or ``gold``, so one job
compares them all. Duplicates, row order and column names do not matter; column order and count do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import Path
from threading import Event, Timer

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.session import shared_folder

# The time limit of one query, and the rows shown of each result that differs.
TIME_LIMIT_SECONDS = 60
SHOWN_ROWS = 20

RESULT_SCHEMA = "item_id bigint, side string, row_no bigint, row_key string"


_LIMB = 2.0**43


def _whole_digits(d: Column) -> Column:
    """The digits of a whole double below 1e38, exactly: its value in three parts of 43 bits, each of which is an exact double."""
    high = F.floor(d / _LIMB**2).cast("double")
    rest = d - high * _LIMB**2
    middle = F.floor(rest / _LIMB).cast("double")
    parts = [p.cast("bigint").cast("decimal(38,0)") for p in (high, middle, rest - middle * _LIMB)]
    weights = [F.lit(str(int(_LIMB) ** k)).cast("decimal(38,0)") for k in (2, 1)]
    total = (parts[0] * weights[0]).cast("decimal(38,0)") + (parts[1] * weights[1]).cast("decimal(38,0)") + parts[2]
    return total.cast("string")


def _number_text(c: Column, kind: T.DataType) -> Column:
    """One text per number, whatever its type: sign, digits without zeros at the ends, and the power of ten of the last digit.

    Nothing is rounded: whole numbers and decimals keep all their digits, a double that is whole has those of its exact value, and
    one with a fraction the shortest digits that read back as it. NaN and infinities are words.
    """
    text = c.cast("string")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        d = c.cast("double")
        text = d.cast("string")
        whole = (d % 1.0 == 0) & (F.abs(d) < 1e38)
        sign = F.when(d < 0, "-").otherwise("")
        text = F.when(whole, F.concat(sign, _whole_digits(F.abs(d)))).otherwise(text)
    form = r"^(-?)(\d+)(?:\.(\d+))?(?:E([+-]?\d+))?$"
    sign, before, after, power = (F.regexp_extract(text, form, i) for i in range(1, 5))
    digits = F.ltrim(F.concat(before, after), F.lit("0"))
    short = F.rtrim(digits, F.lit("0"))
    place = F.when(power == "", 0).otherwise(F.regexp_replace(power, r"\+", "").try_cast("int"))
    place = place - F.length(after) + F.length(digits) - F.length(short)
    plain = F.when(short == "", F.lit("0")).otherwise(F.concat(sign, short, F.lit("e"), place.cast("string")))
    return F.when(text.rlike(form), plain).otherwise(text)


def row_key(schema: T.StructType) -> Column:
    """One text per row that is equal exactly when the rows are: NULL equals NULL, 1 equals 1.0, but text is no number.

    Every value is led by a class mark and its length, so neighbouring values cannot run into each other.
    """

    def cell(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            text, mark = _number_text(c.cast("int"), T.IntegerType()), "n"
        elif isinstance(field.dataType, T.NumericType):
            text, mark = _number_text(c, field.dataType), "n"
        else:
            text, mark = c.cast("string"), "t"
        return F.coalesce(F.concat(F.lit(mark), F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(F.lit(f"{len(schema.fields)}|"), *[cell(f) for f in schema.fields])


def result_rows(df: DataFrame, side: str, item_id: Column, row_no: Column, values: Sequence[str] | None = None) -> DataFrame:
    """Result rows in long form. ``values`` names the result's columns where ``df`` also holds item and row numbers."""
    fields = df.schema.fields if values is None else [df.schema[name] for name in values]
    return df.select(
        item_id.cast("bigint").alias("item_id"),
        F.lit(side).alias("side"),
        row_no.cast("bigint").alias("row_no"),
        row_key(T.StructType(list(fields))).alias("row_key"),
    )


def pair_by_position(*numbered: DataFrame, idx: str = "idx") -> DataFrame:
    """Join frames on their line number; as long as the shortest."""
    return reduce(lambda a, b: a.join(b, idx), numbered)


def run_queries(
    spark: SparkSession, items: Iterable[Mapping], time_limit: float = TIME_LIMIT_SECONDS, parallel: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Run ``pred_sql`` and ``gold_sql`` of every item on the registered views.

    Returns ``(item_id, status, question, pred_sql, gold_sql)`` and the result rows of all items, which the executors write to one
    folder of the shared scratch space. Only submitting happens on the driver. The jobs of a query carry a tag and are cancelled
    after ``time_limit`` seconds.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    sc = spark.sparkContext

    def run(item: Mapping, side: str) -> str:
        tag = f"{Path(folder).name}-{item['item_id']}-{side}"
        expired = Event()

        def stop() -> None:
            expired.set()
            sc.cancelJobsWithTag(tag)

        sc.addJobTag(tag)
        timer = Timer(time_limit, stop)
        timer.start()
        try:
            df = spark.sql(item[f"{side}_sql"])
            rows = result_rows(df, side, F.lit(item["item_id"]), F.monotonically_increasing_id())
            # A folder of its own: what a cancelled query leaves there is never read.
            rows.write.parquet(f"{folder}/item={item['item_id']}/side={side}")
            return "ok"
        except (PySparkException, Py4JJavaError):
            return "timeout" if expired.is_set() else "error"
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def both(item: Mapping) -> tuple[int, str, list[str]]:
        if run(item, "gold") != "ok":
            return item["item_id"], "gold_error", []
        status = run(item, "pred")
        sides = ["gold", "pred"] if status == "ok" else ["gold"]
        return item["item_id"], status, [f"{folder}/item={item['item_id']}/side={s}" for s in sides]

    items = list(items)
    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(both, items))
    told = [(i, s, x.get("question"), x["pred_sql"], x["gold_sql"]) for (i, s, _), x in zip(done, items)]
    status = spark.createDataFrame(told, "item_id bigint, status string, question string, pred_sql string, gold_sql string")
    paths = [p for _, _, ps in done for p in ps]
    rows = spark.read.schema(RESULT_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], RESULT_SCHEMA)
    return status, rows


def result_set_equality(items: DataFrame, results: DataFrame) -> DataFrame:
    """``(item_id, status, correct)`` per item of ``items(item_id, status)``.

    Starts from the items, so two empty results are equal. Failed or timed-out predictions score 0; where the gold query
    failed the score is NULL, which leaves the item out of means.
    """
    # Two levels: distinct rows first, so that a huge result is spread over all tasks and combined map-side.
    keys = results.groupBy("item_id", "row_key").agg(
        F.max((F.col("side") == "pred").cast("int")).alias("_p"), F.max((F.col("side") == "gold").cast("int")).alias("_g")
    )
    differing = keys.groupBy("item_id").agg(F.sum((F.col("_p") != F.col("_g")).cast("bigint")).alias("_one_sided"))
    same = (F.coalesce("_one_sided", F.lit(0)) == 0).cast("int")
    correct = F.when(F.col("status") == "ok", same).when(F.col("status") == "gold_error", F.lit(None)).otherwise(0)
    return items.join(differing, "item_id", "left").withColumn("correct", correct.cast("int")).drop("_one_sided")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results are equal as sets, for a single pair."""
    left, right = a.select(row_key(a.schema).alias("k")), b.select(row_key(b.schema).alias("k"))
    return left.join(right, "k", "left_anti").isEmpty() and right.join(left, "k", "left_anti").isEmpty()


def execution_accuracy(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Mean score and item counts; with ``by`` (for instance a hardness column) also per group, the whole being NULL."""
    measures = [
        F.avg("correct").alias("accuracy"),
        F.count(F.lit(1)).alias("n_items"),
        F.count("correct").alias("n_scored"),
        F.sum((F.col("status") == "error").cast("bigint")).alias("n_errors"),
        F.sum((F.col("status") == "timeout").cast("bigint")).alias("n_timeouts"),
        F.sum((F.col("status") == "gold_error").cast("bigint")).alias("n_gold_errors"),
    ]
    return scored.rollup(by).agg(*measures) if by else scored.agg(*measures)


def mismatch_report(scored: DataFrame, results: DataFrame, rows: int = SHOWN_ROWS) -> DataFrame:
    """Every item that scored 0, with all that ``scored`` tells of it (status, question, queries), and the first ``rows`` result rows
    of both sides. An item without rows has one row with a NULL ``side``."""
    failed = scored.where(F.col("correct") == 0)
    first = Window.partitionBy("item_id", "side").orderBy("row_no")
    shown = (
        results.join(failed.select("item_id"), "item_id", "left_semi")
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= rows)
    )
    return failed.join(shown, "item_id", "left")


def sweep_leaderboard(grid: DataFrame, results: DataFrame, keys: tuple[str, ...] = ("alpha", "ckpt")) -> DataFrame:
    """Mean result per distinct parameter combination of ``grid``, and which one is best.

    ``results`` holds the keys and ``value``. Combinations without results stay, with NULL.
    """
    means = results.groupBy(*keys).agg(F.avg("value").alias("score"), F.count(F.lit(1)).alias("n_results"))
    return grid.select(*keys).distinct().join(means, list(keys), "left").fillna(0, ["n_results"])


def best_run(board: DataFrame, keys: tuple[str, ...] = ("alpha", "ckpt")) -> DataFrame:
    """The combination with the highest score; among equals the lowest keys."""
    rank = F.struct("score", *[(-F.col(k)).alias(f"_{k}") for k in keys])
    return board.where("score is not null").agg(
        *[F.max_by(k, rank).alias(k) for k in keys], F.max("score").alias("score")
    )
