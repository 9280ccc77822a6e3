"""Queries: matching questions with cell values, exactly, nearly, and by BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions.text import DATABASE_TERMS, STOPWORDS
from loomwright.operators import bm25, linking
from loomwright.plans import inputs
from loomwright.plans.profiling import scratch_path
from loomwright.plans.registry import query
from loomwright.sources.tables import scan_table


@query("value_link")
def value_link(spark, sf):
    """The two best values of every text column of the question's database, for every question."""
    made = linking.value_link(inputs.questions(spark, sf), inputs.text_values(spark, sf))
    return made.select("question_id", *linking.COLUMN, "rank", "value", "match_str", "source_str", "score")


def _words(*lists) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for words in lists for w in words)


# The first place of the value in the question must be bounded on both sides by a separator or an end of the text.
_EXACT_SQL = f"""WITH v AS MATERIALIZED (SELECT db_id, table_name, column_name, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value
        FROM ({inputs.values_sql(kinds='t')})),
    q AS MATERIALIZED (SELECT DISTINCT db_id, question FROM {inputs.QUESTIONS_SQL}),
    p AS MATERIALIZED (SELECT db_id, question, value, lower(question) AS lq, lower(value) AS lv, strpos(lower(question), lower(value)) AS i
        FROM q JOIN (SELECT DISTINCT db_id, value FROM v) USING (db_id)
        WHERE value <> '' AND length(value) <= length(question) AND strpos(lower(question), lower(value)) > 0)
    SELECT question_id, db_id, table_name, column_name, value FROM p
    JOIN v USING (db_id, value) JOIN {inputs.QUESTIONS_SQL} USING (db_id, question)
    WHERE (i = 1 OR strpos('''"()`,.?! ', lq[i - 1]) > 0)
      AND (i + length(lv) > length(lq) OR strpos('''"()`,.?! ', lq[i + length(lv)]) > 0)
      AND strpos('''"()`,.?! ', lv[1]) = 0 AND strpos('''"()`,.?! ', lv[-1]) = 0
      AND lv NOT IN ({_words(STOPWORDS, DATABASE_TERMS)})"""


@query("value_link_exact", _EXACT_SQL)
def value_link_exact(spark, sf):
    """The matches whose source is the value itself."""
    found = linking.value_matches(inputs.questions(spark, sf), inputs.text_values(spark, sf))
    same = (F.col("score") == 1) & (F.lower("source_str") == F.lower("value"))
    return found.where(same).select("question_id", *linking.COLUMN, "value")


# Matches made from orders: a customer asks, the status is the matched text, the values are its orders.
_MATCHES_SQL = """(SELECT o_custkey AS question_id, 'star' AS db_id, 'orders' AS table_name, 'o_orderstatus' AS column_name,
    o_orderpriority || '#' || o_orderkey AS value, o_orderstatus AS match_str, o_orderpriority AS source_str,
    round(o_totalprice / 500000, 2) AS score, CAST(length(o_orderpriority) AS INT) AS match_size FROM orders)"""
_DEDUPED_SQL = f"""(SELECT question_id, db_id, table_name, column_name, match_str, value, source_str, score, match_size, first_value FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, match_str ORDER BY value DESC) AS n,
        min(value) OVER (PARTITION BY question_id, match_str) AS first_value FROM {_MATCHES_SQL}) WHERE n = 1)"""


def _matches(spark, sf):
    return scan_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("question_id"),
        F.lit("star").alias("db_id"),
        F.lit("orders").alias("table_name"),
        F.lit("o_orderstatus").alias("column_name"),
        F.concat_ws("#", "o_orderpriority", "o_orderkey").alias("value"),
        F.col("o_orderstatus").alias("match_str"),
        F.col("o_orderpriority").alias("source_str"),
        F.round(F.col("o_totalprice") / 500000, 2).alias("score"),
        F.length("o_orderpriority").alias("match_size"),
    )


@query("last_wins_dedupe", f"SELECT * FROM {_DEDUPED_SQL}")
def last_wins_dedupe(spark, sf):
    return linking.last_wins_dedupe(_matches(spark, sf))


@query(
    "topk_matches",
    f"""SELECT question_id, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id
        ORDER BY CAST(1e16 AS DOUBLE) * score + CAST(1e8 AS DOUBLE) * score + match_size DESC, first_value) AS rank FROM {_DEDUPED_SQL}) WHERE rank <= 2""",
)
def topk_matches(spark, sf):
    return linking.topk_matches(linking.last_wins_dedupe(_matches(spark, sf)), 2).select("question_id", "value", "rank")


# ---------------------------------------------------------------------------------------------------------------------
# BM25: the documents are indexed, the benchmark texts are the queries

_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_POSTINGS_SQL = f"""(SELECT doc_id, dl, term, count(*) AS tf, string_agg(p - 1, ',' ORDER BY p) AS positions FROM (
    SELECT doc_id, len(terms) AS dl, unnest(terms) AS term, generate_subscripts(terms, 1) AS p FROM (
        SELECT doc_id, {_TERMS} AS terms FROM documents)) GROUP BY doc_id, dl, term)"""
_SCORES_SQL = f"""p AS MATERIALIZED (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term
            FROM (SELECT doc_id, {_TERMS} AS terms FROM documents)) GROUP BY ALL),
        f AS MATERIALIZED (SELECT term, count(*) AS df FROM p GROUP BY term),
        s AS MATERIALIZED (SELECT count(*) AS n, avg(len({_TERMS})) AS avgdl FROM documents),
        q AS MATERIALIZED (SELECT item_id AS query_id, term, count(*) AS qtf FROM (
            SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
        r AS MATERIALIZED (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf /
            (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))) AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL)"""


def documents(spark, sf):
    docs = scan_table(spark, sf, "documents")
    return docs.select(F.lit("web").alias("db_id"), "doc_id", F.col("text").alias("contents"))


def searches(spark, sf):
    bench = scan_table(spark, sf, "benchmark")
    return bench.select(F.col("item_id").alias("query_id"), F.lit("web").alias("db_id"), "text")


@query("bm25_index", f"SELECT * FROM {_POSTINGS_SQL}")
def bm25_index(spark, sf):
    postings = bm25.bm25_index(documents(spark, sf)).postings
    return postings.select(
        "doc_id", "dl", "term", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")
    )


_SEARCH_SQL = f"""WITH {_SCORES_SQL} SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 10"""


@query("bm25_search", _SEARCH_SQL)
def bm25_search(spark, sf):
    found = bm25.bm25_search(bm25.bm25_index(documents(spark, sf)), searches(spark, sf), 10)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("write_index", _SEARCH_SQL)
def write_index(spark, sf):
    """Writes the index and searches the written copy."""
    path = scratch_path(spark, "index")
    bm25.write_index(bm25.bm25_index(documents(spark, sf)), path)
    found = bm25.bm25_search(bm25.read_index(spark, path), searches(spark, sf), 10)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("search_bounded", _SEARCH_SQL)
def search_bounded(spark, sf):
    """Writes the index and searches the written copy, scoring only documents that can be among the best."""
    path = scratch_path(spark, "bounded-index")
    bm25.write_index(bm25.bm25_index(documents(spark, sf)), path)
    found = bm25.bounded_search(bm25.read_index(spark, path), searches(spark, sf), 10)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))
