"""How the operators' inputs are derived from the given tables, in Spark and (``*_SQL``) in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.corpus import corpus_text, corpus_union, row_index
from loomwright.operators.profile import sample_values
from loomwright.operators.schema import comment_enrich, schema_columns
from loomwright.sources.tables import (
    catalog_columns,
    non_null_counts,
    scan_database,
    scan_distinct_values,
    scan_smallest_values,
    scan_table,
)

# ---------------------------------------------------------------------------------------------------------------------
# Two databases with their catalogs. Types as the catalog names them; "n" marks numbers, "t" text, "-" neither.

CATALOG = {
    "star": {
        "region": "r_regionkey:int:n r_name:string:t",
        "nation": "n_nationkey:int:n n_name:string:t n_regionkey:int:n",
        "customer": "c_custkey:bigint:n c_name:string:t c_nationkey:int:n c_acctbal:double:n c_mktsegment:string:t",
        "supplier": "s_suppkey:bigint:n s_name:string:t s_nationkey:int:n s_acctbal:double:n",
        "part": "p_partkey:bigint:n p_name:string:t p_brand:string:t p_type:string:t p_size:int:n p_retailprice:double:n",
        "orders": "o_orderkey:bigint:n o_custkey:bigint:n o_orderstatus:string:t o_totalprice:double:n "
        "o_orderdate:timestamp_ntz:- o_orderpriority:string:t",
        "lineitem": "l_orderkey:bigint:n l_partkey:bigint:n l_suppkey:bigint:n l_linenumber:int:n l_quantity:double:n "
        "l_extendedprice:double:n l_discount:double:n l_tax:double:n l_returnflag:string:t l_linestatus:string:t "
        "l_shipdate:timestamp_ntz:-",
    },
    "web": {
        "events": "event_id:bigint:n ts:timestamp_ntz:- user_id:bigint:n event_type:string:t value:double:n props:string:t",
        "documents": "doc_id:bigint:n text:string:t lang:string:t source:string:t n_chars:bigint:n",
        "pages": "page_id:bigint:n url:string:t html:string:t",
        "benchmark": "item_id:bigint:n text:string:t",
        "labels": "doc_id:bigint:n quality:int:n toxic:int:n",
        "conversations": "conv_id:bigint:n turn:bigint:n role:string:t text:string:t",
    },
}
PRIMARY_KEYS = {
    ("star", "region"): ["r_regionkey"],
    ("star", "nation"): ["n_nationkey"],
    ("star", "customer"): ["c_custkey"],
    ("star", "supplier"): ["s_suppkey"],
    ("star", "part"): ["p_partkey"],
    ("star", "orders"): ["o_orderkey"],
    ("star", "lineitem"): ["l_orderkey", "l_linenumber"],
    ("web", "events"): ["event_id"],
    ("web", "documents"): ["doc_id"],
    ("web", "pages"): ["page_id"],
    ("web", "benchmark"): ["item_id"],
    ("web", "labels"): ["doc_id"],
    ("web", "conversations"): ["conv_id", "turn"],
}
# Declared keys; some are incomplete or in another letter case on purpose.
FOREIGN_KEYS = [
    ("star", "nation", "n_regionkey", "region", "r_regionkey"),
    ("star", "Customer", "C_NationKey", "nation", "n_nationkey"),
    ("star", "supplier", "s_nationkey", "nation", "n_nationkey"),
    ("star", "orders", "o_custkey", "customer", "c_custkey"),
    ("star", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("star", "lineitem", "l_partkey", "part", "p_partkey"),
    ("star", "lineitem", "l_suppkey", "supplier", None),
    ("star", "part", None, "supplier", "s_suppkey"),
    ("web", "labels", "doc_id", "documents", "doc_id"),
    ("web", "pages", "page_id", None, "doc_id"),
]
TABLE_COMMENTS = [
    ("star", "part", "articles on offer"),
    ("star", "orders", "orders of customers"),
    ("star", "nation", ""),
]
COLUMN_COMMENTS = [
    ("star", "part", "p_brand", "maker of the article"),
    ("star", "part", "p_size", "size in centimetres"),
    ("star", "orders", "o_orderpriority", "how urgent the order is"),
    ("star", "customer", "c_acctbal", "never shown: its table has no record"),
]
_FK_COLUMNS = "db_id string, src_table string, src_column string, ref_table string, ref_column string"


def catalog_rows():
    """``(db_id, table, table_ord, column, column_ord, type, kind, pk)`` of every column."""
    for db_id, tables in CATALOG.items():
        for table_ord, (table, columns) in enumerate(tables.items()):
            key = PRIMARY_KEYS.get((db_id, table), [])
            for column_ord, spec in enumerate(columns.split()):
                column, kind, form = spec.split(":")
                pk = key.index(column) + 1 if column in key else 0
                yield db_id, table, table_ord, column, column_ord, kind, form, pk


def databases(spark: SparkSession, sf: str, *only: str) -> dict[str, dict[str, DataFrame]]:
    return {db: scan_database(spark, sf, list(CATALOG[db])) for db in (only or CATALOG)}


def values(spark: SparkSession, sf: str, *only: str) -> DataFrame:
    return scan_distinct_values(databases(spark, sf, *only))


def text_values(spark: SparkSession, sf: str, *only: str) -> DataFrame:
    """Distinct values of text columns only."""
    return scan_distinct_values(databases(spark, sf, *only), text_only=True)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """The sample values of every column."""
    return sample_values(scan_smallest_values(databases(spark, sf)))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """All columns with the number of cells they hold."""
    dbs = databases(spark, sf)
    counts = non_null_counts(dbs)
    return catalog_columns(spark, dbs, PRIMARY_KEYS).join(counts, ["db_id", "table_name", "column_name"])


def comments(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame(TABLE_COMMENTS, "db_id string, table_name string, table_comment string"),
        spark.createDataFrame(
            COLUMN_COMMENTS, "db_id string, table_name string, column_name string, column_comment string"
        ),
    )


def declared_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOREIGN_KEYS, _FK_COLUMNS)


def full_columns(spark: SparkSession, sf: str, samples: DataFrame) -> DataFrame:
    """Catalog rows with comments and sample values."""
    columns = catalog_columns(spark, databases(spark, sf), PRIMARY_KEYS)
    return schema_columns(comment_enrich(columns, *comments(spark)), samples)


def _quoted(*items) -> str:
    return ", ".join("NULL" if i is None else "'" + str(i).replace("'", "''") + "'" for i in items)


def _values(rows, names: str) -> str:
    body = ", ".join(f"({_quoted(*r)})" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


def cells_sql(*only: str, kinds: str = "nt") -> str:
    return " UNION ALL ".join(
        f"SELECT '{db}' AS db_id, '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value "
        f"FROM {t} WHERE {c} IS NOT NULL"
        for db, t, _, c, _, _, form, _ in catalog_rows()
        if form in kinds and (not only or db in only)
    )


def values_sql(*only: str, kinds: str = "nt") -> str:
    return f"SELECT DISTINCT db_id, table_name, column_name, value FROM ({cells_sql(*only, kinds=kinds)})"


CATALOG_SQL = " UNION ALL ".join(
    f"SELECT '{db}' AS db_id, '{t}' AS table_name, {o} AS table_ord, '{c}' AS column_name, {i} AS column_ord, "
    f"'{kind}' AS column_type, {pk} AS pk, count({c}) AS non_null FROM {t}"
    for db, t, o, c, i, kind, _, pk in catalog_rows()
)
FOREIGN_KEYS_SQL = _values(FOREIGN_KEYS, "db_id, src_table, src_column, ref_table, ref_column")
EDGES_SQL = f"""(SELECT db_id, lower(src_table) AS src_table, lower(src_column) AS src_column, lower(ref_table) AS ref_table,
    lower(ref_column) AS ref_column FROM {FOREIGN_KEYS_SQL}
    WHERE src_column IS NOT NULL AND ref_table IS NOT NULL AND ref_column IS NOT NULL)"""
TABLE_COMMENTS_SQL = _values(TABLE_COMMENTS, "db_id, table_name, table_comment")
COLUMN_COMMENTS_SQL = _values(COLUMN_COMMENTS, "db_id, table_name, column_name, column_comment")
ENRICHED_SQL = f"""(SELECT c.db_id, c.table_name, table_ord, c.column_name, column_ord, column_type, pk, non_null,
        coalesce(t.table_comment, '') AS table_comment,
        CASE WHEN t.table_name IS NULL THEN '' ELSE coalesce(k.column_comment, '') END AS column_comment
    FROM ({CATALOG_SQL}) c
    LEFT JOIN {TABLE_COMMENTS_SQL} t ON c.db_id = t.db_id AND c.table_name = t.table_name
    LEFT JOIN {COLUMN_COMMENTS_SQL} k
        ON c.db_id = k.db_id AND c.table_name = k.table_name AND c.column_name = k.column_name)"""
SAMPLES_SQL = f"""(SELECT db_id, table_name, column_name, ord, trim_value AS value FROM (
    SELECT *, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS trim_value FROM (
        SELECT *, row_number() OVER (PARTITION BY db_id, table_name, column_name ORDER BY value) AS ord
        FROM ({values_sql()})) WHERE ord <= 2)
    WHERE length(trim_value) BETWEEN 1 AND 25)"""


# ---------------------------------------------------------------------------------------------------------------------
# Questions about articles and pages


def questions(spark: SparkSession, sf: str) -> DataFrame:
    part = scan_table(spark, sf, "part")
    text = F.concat(
        F.lit("How many "), F.col("p_name"), F.lit(" of "), F.col("p_brand"), F.lit(" cost more than 10?")
    )
    about_parts = part.select(F.col("p_partkey").alias("question_id"), F.lit("star").alias("db_id"), text.alias("question"))
    said = F.concat(F.lit("Where is it said that "), F.col("text"), F.lit("?"))
    about_pages = scan_table(spark, sf, "benchmark").select(
        (-1 - F.col("item_id")).alias("question_id"), F.lit("web").alias("db_id"), said.alias("question")
    )
    return about_parts.unionByName(about_pages)


# Questions of one partition, where each of them becomes many rows or a long one.
DEALT_QUESTIONS = 10_000


def dealt_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The questions, partitioned by their id: short as they are, a file of them is read by one task."""
    asked = questions(spark, sf)
    return asked.repartition(asked.count() // DEALT_QUESTIONS + 1, "question_id")


QUESTIONS_SQL = """(SELECT p_partkey AS question_id, 'star' AS db_id,
    'How many ' || p_name || ' of ' || p_brand || ' cost more than 10?' AS question FROM part
    UNION ALL SELECT -1 - item_id, 'web', 'Where is it said that ' || text || '?' FROM benchmark)"""


# ---------------------------------------------------------------------------------------------------------------------
# Corpora


def raw_corpora(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, list[str], list[str]]]:
    """Per corpus its rows, its order columns and its text columns."""
    docs = scan_table(spark, sf, "documents").select("doc_id", F.col("text").alias("sql"))
    turns = scan_table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", "text")
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("code")
    )
    bench = scan_table(spark, sf, "benchmark").select(
        "item_id", F.col("text").alias("input_text"), F.col("text").alias("output_text")
    )
    return {
        "pure_sql": (docs, ["doc_id"], ["sql"]),
        "text2code": (asked.join(answers, ["conv_id", "turn"]), ["conv_id", "turn"], ["text", "code"]),
        "text2text": (bench, ["item_id"], ["input_text", "output_text"]),
    }


def corpora(spark: SparkSession, sf: str) -> DataFrame:
    """``(corpus_ord, corpus, idx, sequence)`` of all three."""
    return corpus_union(
        [
            (name, corpus_text(row_index(df, order), *parts))
            for name, (df, order, parts) in raw_corpora(spark, sf).items()
        ]
    )


CORPORA_SQL = r"""(
    SELECT 0 AS corpus_ord, 'pure_sql' AS corpus, row_number() OVER (ORDER BY doc_id) - 1 AS idx,
        regexp_replace(text, '^\s+|\s+$', '', 'g') AS sequence FROM documents
    UNION ALL
    SELECT 1, 'text2code', row_number() OVER (ORDER BY conv_id, turn) - 1,
        regexp_replace(text || chr(10) || code, '^\s+|\s+$', '', 'g') FROM (
        SELECT u.conv_id, u.turn, u.text, a.text AS code FROM conversations u JOIN conversations a
        ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
    UNION ALL
    SELECT 2, 'text2text', row_number() OVER (ORDER BY item_id) - 1,
        regexp_replace(text || chr(10) || text, '^\s+|\s+$', '', 'g') FROM benchmark)"""
WORD = r"\p{L}+|\p{N}+|[^\p{L}\p{N}]"
WORDS_SQL = f"""(SELECT corpus_ord, corpus, idx, regexp_extract_all(sequence, '{WORD}') AS words
    FROM {CORPORA_SQL})"""
VOCABULARY_SQL = """(SELECT word, rank + 257 AS token_id FROM (
    SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (
        SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) WHERE length(word) <= 64 GROUP BY word))
    WHERE rank <= 48894)"""


def ids_sql(keys: str, words: str) -> str:
    """One row per id with its place: words by the vocabulary ``v``, other words by their bytes."""
    return f"""SELECT {keys}, p * 1048576 AS pos, token_id AS id FROM ({words}) JOIN v USING (word)
        UNION ALL SELECT {keys}, p * 1048576 + k, CAST('0x' || hh AS INT) + 2 FROM (
            SELECT {keys}, p, unnest(spelled) AS hh, generate_subscripts(spelled, 1) AS k FROM (
                SELECT {keys}, p, regexp_extract_all(hex(encode(word)), '..') AS spelled FROM ({words}) ANTI JOIN v USING (word)))"""


_KEYS = "corpus_ord, corpus, idx"
_EXPLODED = f"SELECT {_KEYS}, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w"
# common table expressions: w (words), v (vocabulary), t (one row per token, in order of pos, end mark last), l (tokens per sequence)
TOKENS_WITH = f"""w AS MATERIALIZED (SELECT * FROM {WORDS_SQL}), v AS MATERIALIZED (SELECT * FROM {VOCABULARY_SQL}),
    t AS MATERIALIZED ({ids_sql(_KEYS, _EXPLODED)}
        UNION ALL SELECT {_KEYS}, (len(words) + 1) * 1048576, 0 FROM w),
    l AS MATERIALIZED (SELECT {_KEYS}, count(*) AS length FROM t GROUP BY {_KEYS})"""


# ---------------------------------------------------------------------------------------------------------------------
# Dialogue examples, logits, metrics


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``(conv_id, turn, prefix, target)``: a user turn and the turn that follows it."""
    turns = scan_table(spark, sf, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return (
        turns.where("role = 'user'")
        .select("conv_id", "turn", F.col("text").alias("prefix"))
        .join(following, ["conv_id", "turn"])
    )


PAIRS_SQL = """(SELECT a.conv_id, a.turn, a.text AS prefix, b.text AS target FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"""


def student_logits(spark: SparkSession, sf: str) -> DataFrame:
    return _logits(scan_table(spark, sf, "embeddings"))


def teacher_logits(spark: SparkSession, sf: str) -> DataFrame:
    """The next vector's logits; the last vector has the first one as its teacher."""
    vectors = scan_table(spark, sf, "embeddings")
    count = vectors.agg(F.count(F.lit(1)).alias("n"))
    before = F.when(F.col("vec_id") == 0, F.col("n")).otherwise(F.col("vec_id")) - 1
    return _logits(vectors.join(F.broadcast(count)).withColumn("vec_id", before))  # one row


def _logits(df: DataFrame) -> DataFrame:
    return df.select(
        F.expr("vec_id div 8").alias("batch_id"),
        F.expr("vec_id div 2").alias("example_id"),
        F.expr("cast(vec_id % 2 as int)").alias("pos"),
        F.col("embedding").alias("logits"),
        F.expr("if(label = 0, -100, label)").alias("label"),
    )


# z: one row per position and element, with student and teacher logits as doubles
LOGITS_SQL = """(SELECT s.vec_id, s.vec_id // 8 AS batch_id, s.vec_id // 2 AS example_id, s.vec_id % 2 AS pos,
    unnest(s.embedding)::DOUBLE AS s, unnest(t.embedding)::DOUBLE AS t, generate_subscripts(s.embedding, 1) AS i
    FROM embeddings s JOIN embeddings t ON t.vec_id = (s.vec_id + 1) % (SELECT count(*) FROM embeddings))"""


def loss_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as logged values: a run per user."""
    return scan_table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        (F.col("user_id") % 4).alias("gpu"),
        F.col("event_type").alias("tag"),
        F.col("event_id").alias("step"),
        "value",
        "ts",
    )
