"""Queries: execution accuracy and sweeps.

An item is a customer; its gold query lists priority, status and discounted price of the customer's orders, its predicted query
leaves out small orders and so is wrong for those who have any.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import evaluate
from loomwright.operators.corpus import row_index
from loomwright.plans import inputs
from loomwright.plans.profiling import scratch_path
from loomwright.plans.registry import query
from loomwright.session import cut_lineage
from loomwright.sources import files
from loomwright.sources.tables import register_views, scan_table

SMALL = 20_000
_STATUS = "CASE WHEN c_acctbal < -900 THEN 'gold_error' WHEN c_acctbal < -500 THEN 'timeout' WHEN c_acctbal < 0 THEN 'error' ELSE 'ok' END"
_RESULTS_SQL = f"""(
    SELECT o_custkey AS item_id, 'gold' AS side, o_orderkey AS row_no, o_orderpriority, o_orderstatus FROM orders
    UNION ALL SELECT o_custkey, 'pred', o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_totalprice >= {SMALL})"""
_SCORED_SQL = f"""(SELECT c_custkey AS item_id, hardness, status, CASE WHEN status = 'ok' THEN CAST(coalesce(differing, 0) = 0 AS INT)
        WHEN status <> 'gold_error' THEN 0 END AS correct
    FROM (SELECT c_custkey, c_mktsegment AS hardness, {_STATUS} AS status FROM customer) c LEFT JOIN (
        SELECT item_id, count(*) FILTER (WHERE sides = 1) AS differing FROM (
            SELECT item_id, o_orderpriority, o_orderstatus, count(DISTINCT side) AS sides FROM {_RESULTS_SQL} GROUP BY ALL) GROUP BY item_id) d
    ON d.item_id = c.c_custkey)"""


def items(spark, sf):
    return scan_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("hardness"), F.expr(_STATUS).alias("status")
    )


def results(spark, sf):
    orders = scan_table(spark, sf, "orders")
    columns = ["o_orderpriority", "o_orderstatus"]

    def side(df, name):
        return evaluate.result_rows(df, name, F.col("o_custkey"), F.col("o_orderkey"), columns)

    return side(orders, "gold").unionByName(side(orders.where(F.col("o_totalprice") >= SMALL), "pred"))


def scored(spark, sf):
    return evaluate.result_set_equality(items(spark, sf), results(spark, sf))


@query("result_set_equality", f"SELECT * FROM {_SCORED_SQL}")
def result_set_equality(spark, sf):
    return scored(spark, sf)


@query(
    "execution_accuracy",
    f"""SELECT hardness, round(avg(correct), 6) AS accuracy, count(*) AS n_items, count(correct) AS n_scored,
        count(*) FILTER (WHERE status = 'error') AS n_errors, count(*) FILTER (WHERE status = 'timeout') AS n_timeouts,
        count(*) FILTER (WHERE status = 'gold_error') AS n_gold_errors
    FROM {_SCORED_SQL} GROUP BY GROUPING SETS ((hardness), ())""",
)
def execution_accuracy(spark, sf):
    made = evaluate.execution_accuracy(scored(spark, sf), by="hardness")
    return made.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "mismatch_report",
    f"""SELECT f.item_id, f.status, side, rank, row_no, o_orderpriority AS priority FROM
        (SELECT * FROM {_SCORED_SQL} WHERE correct = 0) f LEFT JOIN (
        SELECT r.*, CAST(row_number() OVER (PARTITION BY item_id, side ORDER BY row_no) AS INT) AS rank FROM {_RESULTS_SQL} r) r
        ON r.item_id = f.item_id AND rank <= 20""",
)
def mismatch_report(spark, sf):
    rows = cut_lineage(results(spark, sf))
    report = evaluate.mismatch_report(evaluate.result_set_equality(items(spark, sf), rows), rows)
    # the first cell of the key, between its length and the next cell's mark
    priority = F.when(F.col("row_key").isNotNull(), F.regexp_extract("row_key", r"^2\|t\d+:(.*)t\d+:.$", 1))
    return report.select("item_id", "status", "side", "rank", "row_no", priority.alias("priority"))


# Items whose queries are run: question, gold query, predicted query. The last prediction names a column that is not there.
_RUN = (
    ("How many orders?", "SELECT count(*) FROM orders", "SELECT count(o_orderkey) FROM orders"),
    ("Worth of the orders by status?", "SELECT o_orderstatus, sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders GROUP BY o_orderstatus",
     "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(30,4)) FROM orders GROUP BY 1 ORDER BY 1 DESC"),
    ("Names of the nations of region 1?", "SELECT n_name FROM nation WHERE n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    ("Keys of the customers?", "SELECT c_custkey FROM customer", "SELECT CAST(c_custkey AS DOUBLE) + 0.0 FROM customer"),
    ("Parts without a brand?", "SELECT p_name FROM part WHERE p_brand IS NULL", "SELECT p_name FROM part WHERE p_size < 0"),
    ("Names of the regions?", "SELECT r_name FROM region", "SELECT r_label FROM region"),
)


def _same_sql(i: int, gold: str, pred: str) -> str:
    right = "r_label" not in pred
    same = f"NOT EXISTS ({gold} EXCEPT {pred}) AND NOT EXISTS ({pred} EXCEPT {gold})".replace(" ORDER BY 1 DESC", "")
    score = f"CAST({same} AS INT)" if right else "CAST(0 AS INT)"
    return f"SELECT CAST({i} AS BIGINT) AS item_id, '{'ok' if right else 'error'}' AS status, {score} AS correct"


@query("run_queries", " UNION ALL ".join(_same_sql(i, g, p) for i, (_, g, p) in enumerate(_RUN)))
def run_queries(spark, sf):
    """Runs both queries of every item on the tables and compares their results."""
    register_views(inputs.databases(spark, sf, "star")["star"])
    asked = [{"item_id": i, "question": q, "gold_sql": g, "pred_sql": p} for i, (q, g, p) in enumerate(_RUN)]
    made = evaluate.result_set_equality(*evaluate.run_queries(spark, asked))
    return made.select("item_id", "status", "correct")


@query(
    "pair_by_position",
    """SELECT q.i AS idx, q.text AS question, a.text AS pred FROM
        (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations WHERE role = 'user') q JOIN
        (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i FROM conversations WHERE role = 'assistant') a USING (i)""",
)
def pair_by_position(spark, sf):
    turns = scan_table(spark, sf, "conversations")

    def numbered(role, name):
        return row_index(
            turns.where(F.col("role") == role).select("conv_id", "turn", F.col("text").alias(name)), ["conv_id", "turn"]
        ).select("idx", name)

    return evaluate.pair_by_position(numbered("user", "question"), numbered("assistant", "pred"))


@query(
    "read_predictions",
    r"""SELECT row_number() OVER (ORDER BY item_id) - 1 AS line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS pred_sql FROM (
        SELECT item_id, replace(text, chr(10), ' ') AS line FROM benchmark)""",
)
def read_predictions(spark, sf):
    """Writes one line per benchmark text, in order, and reads the lines back."""
    path = scratch_path(spark, "predictions")
    lines = scan_table(spark, sf, "benchmark").select("item_id", F.translate("text", "\n", " ").alias("line"))
    lines.repartitionByRange("item_id").sortWithinPartitions("item_id").select("line").write.text(path)
    return files.read_predictions(spark, path)


_SWEEP_SQL = """(SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS alpha, user_id % 2 AS ckpt, value FROM events)"""


def _sweep(spark, sf):
    return scan_table(spark, sf, "events").select(
        (F.get_json_object("props", "$.k").cast("bigint") % 5).alias("alpha"), (F.col("user_id") % 2).alias("ckpt"), "value"
    )


_BOARD_SQL = f"(SELECT alpha, ckpt, avg(value) AS score, count(*) AS n_results FROM {_SWEEP_SQL} GROUP BY alpha, ckpt)"


def _board(spark, sf):
    runs = _sweep(spark, sf)
    return evaluate.sweep_leaderboard(runs.select("alpha", "ckpt"), runs)


@query("sweep_leaderboard", f"SELECT alpha, ckpt, round(score, 6) AS score, n_results FROM {_BOARD_SQL}")
def sweep_leaderboard(spark, sf):
    return _board(spark, sf).withColumn("score", F.round("score", 6))


@query("sweep_best", f"SELECT alpha, ckpt, round(score, 6) AS score FROM {_BOARD_SQL} ORDER BY score DESC LIMIT 1")
def sweep_best(spark, sf):
    return evaluate.best_run(_board(spark, sf)).withColumn("score", F.round("score", 6))
