"""Queries: scans, catalog, profiling, schemas, prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwright.functions.prompt import content_sequence, label_text, prompt_prefix, schema_sequence
from loomwright.functions.text import (
    STOPWORDS,
    COMMON_WORDS,
    DATABASE_TERMS,
    decode_text,
    is_filtered_word,
    is_number,
    quote_identifier,
)
from loomwright.operators import profile, schema
from loomwright.plans import inputs
from loomwright.plans.registry import query
from loomwright.session import shared_folder
from loomwright.sources import files
from loomwright.sources.tables import catalog_columns as catalog_rows
from loomwright.sources.tables import register_views, scan_cells, scan_table

STRIPPED = r"regexp_replace(value, '^\s+|\s+$', '', 'g')"
NUMBERED_SQL = f"""(SELECT db_id, table_name, column_name, value,
    row_number() OVER (PARTITION BY db_id, table_name, column_name ORDER BY value) - 1 AS c_id FROM ({inputs.values_sql()}))"""


SAMPLE_SCHEMA = "db_id string, table_name string, column_name string, ord int, value string"


def scratch_path(spark, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/loomwright-{uuid.uuid4().hex}/{name}"


@query("scan_tables", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def scan_tables(spark, sf):
    register_views(inputs.databases(spark, sf, "star")["star"])
    return spark.sql("SELECT c_custkey, c_name, c_mktsegment FROM customer")


@query("catalog_columns", inputs.CATALOG_SQL)
def catalog_columns(spark, sf):
    return inputs.catalog(spark, sf)


@query(
    "multi_db_scan",
    f"""SELECT db_id, table_name, column_name, count(*) AS n_cells, CAST(sum(length(value)) AS BIGINT) AS n_chars
    FROM ({inputs.cells_sql()}) GROUP BY ALL""",
)
def multi_db_scan(spark, sf):
    cells = scan_cells(inputs.databases(spark, sf))
    return cells.groupBy(*profile.COLUMN_KEY).agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(F.length("value")).alias("n_chars")
    )


@query("distinct_values", inputs.values_sql())
def distinct_values(spark, sf):
    return inputs.values(spark, sf)


@query("content_row_id", f"SELECT * FROM {NUMBERED_SQL}")
def content_row_id(spark, sf):
    return profile.number_values(inputs.values(spark, sf))


@query(
    "value_length_filter",
    f"""SELECT * FROM (SELECT db_id, table_name, column_name, {STRIPPED} AS value FROM ({inputs.values_sql()}))
    WHERE length(value) BETWEEN 1 AND 25""",
)
def value_length_filter(spark, sf):
    return profile.short_values(inputs.values(spark, sf))


DOCUMENTS_SQL = f"""SELECT db_id, table_name, column_name, c_id,
    lower(table_name || '-**-' || column_name || '-**-' || c_id) AS id, contents
    FROM (SELECT *, {STRIPPED} AS contents FROM {NUMBERED_SQL}) WHERE length(contents) BETWEEN 1 AND 25"""


@query("content_doc_id", DOCUMENTS_SQL)
def content_doc_id(spark, sf):
    return profile.content_documents(inputs.values(spark, sf))


@query("write_documents", f"SELECT id, contents FROM ({DOCUMENTS_SQL})")
def write_documents(spark, sf):
    path = scratch_path(spark, "documents")
    files.write_documents(profile.content_documents(inputs.values(spark, sf)), path)
    return files.read_documents(spark, path)


@query("sample_values", f"SELECT db_id, table_name, column_name, CAST(ord AS INT) AS ord, value FROM {inputs.SAMPLES_SQL}")
def sample_values(spark, sf):
    return inputs.samples(spark, sf)


_FILTERED = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS + COMMON_WORDS + DATABASE_TERMS)


@query(
    "stopword_filter",
    f"""SELECT word, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}'']+')) AS word FROM documents)
    WHERE word NOT IN ({_FILTERED}) GROUP BY word""",
)
def stopword_filter(spark, sf):
    text = F.lower("text")
    found = scan_table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}']+"), F.lit(0))).alias("word")
    )
    return found.where(~is_filtered_word("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "is_number",
    f"""SELECT db_id, table_name, column_name, value,
        try_cast(replace(value, ',', '') AS DOUBLE) IS NOT NULL AS is_number FROM ({inputs.values_sql()})""",
)
def is_number_query(spark, sf):
    return inputs.values(spark, sf).withColumn("is_number", is_number("value"))


@query(
    "quote_identifier",
    f"""SELECT db_id, table_name, column_name, value, CASE WHEN regexp_matches(value, '[(\\-) /]')
        THEN '`' || value || '`' ELSE value END AS quoted FROM ({inputs.values_sql(kinds='t')})""",
)
def quote_identifier_query(spark, sf):
    found = inputs.text_values(spark, sf)
    return found.select("db_id", "table_name", "column_name", "value", quote_identifier("value").alias("quoted"))


@query(
    "text_decode",
    """SELECT doc_id, text, md5(chr(233) || array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'),
        lambda x: chr(CAST('0x' || x AS INTEGER))), '')) AS stray_md5 FROM documents""",
)
def text_decode(spark, sf):
    """The texts from their bytes, and from bytes that a stray E9 in front makes invalid as UTF-8, so that each is a Latin-1 letter."""
    docs = scan_table(spark, sf, "documents")
    raw = F.encode("text", "UTF-8")
    stray = decode_text(F.concat(F.unhex(F.lit("E9")), raw))
    return docs.select("doc_id", decode_text(raw).alias("text"), F.md5(stray.cast("binary")).alias("stray_md5"))


@query(
    "fk_not_null",
    f"""SELECT e.*, c.non_null AS n_references FROM {inputs.EDGES_SQL} e JOIN ({inputs.CATALOG_SQL}) c
    ON c.db_id = e.db_id AND c.table_name = e.src_table AND c.column_name = e.src_column""",
)
def fk_not_null(spark, sf):
    counts = inputs.catalog(spark, sf).select(
        "db_id",
        F.col("table_name").alias("src_table"),
        F.col("column_name").alias("src_column"),
        F.col("non_null").alias("n_references"),
    )
    return schema.foreign_key_edges(inputs.declared_keys(spark)).join(counts, ["db_id", "src_table", "src_column"])


@query(
    "comment_enrich",
    f"""SELECT db_id, table_name, column_name, table_comment, column_comment, non_null FROM {inputs.ENRICHED_SQL}""",
)
def comment_enrich(spark, sf):
    return schema.comment_enrich(inputs.catalog(spark, sf), *inputs.comments(spark)).select(
        "db_id", "table_name", "column_name", "table_comment", "column_comment", "non_null"
    )


def _schemas(spark, sf, sampled=True):
    samples = inputs.samples(spark, sf) if sampled else spark.createDataFrame([], SAMPLE_SCHEMA)
    edges = schema.foreign_key_edges(inputs.declared_keys(spark))
    return schema.schema_build(inputs.full_columns(spark, sf, samples), edges)


# one row per column, with its sample values as one text ('' if none)
_COLUMNS_SQL = f"""(SELECT c.*, coalesce(s.vals, '') AS vals FROM {inputs.ENRICHED_SQL} c LEFT JOIN (
    SELECT db_id, table_name, column_name, string_agg(value, ' , ' ORDER BY ord) AS vals FROM {inputs.SAMPLES_SQL}
    GROUP BY ALL) s USING (db_id, table_name, column_name))"""


@query(
    "schema_build",
    f"""SELECT db_id, table_name, table_comment, CAST(table_ord AS INT) AS table_ord, string_agg(
        column_name || ':' || column_type || ':' || pk || ':' || column_comment || ':' || vals, chr(10) ORDER BY column_ord)
        AS columns FROM {_COLUMNS_SQL} GROUP BY ALL""",
)
def schema_build(spark, sf):
    def line(c):
        parts = (c["name"], c["type"], c["pk"].cast("string"), c["comment"], F.array_join(c["contents"], " , "))
        return F.concat_ws(":", *parts)

    return (
        _schemas(spark, sf)
        .select("db_id", F.inline("schema_items"))
        .select(
            "db_id", "table_name", "table_comment", "table_ord", F.array_join(F.transform("columns", line), "\n").alias("columns")
        )
    )


def _quote_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[(\\-) /]') THEN '`' || {c} || '`' ELSE {c} END"


_SCHEMA_TEXT_SQL = f"""(SELECT t.db_id, 'database schema :' || chr(10) || tables || chr(10) ||
        coalesce('foreign keys :' || chr(10) || edges, 'foreign keys : None') AS schema_text FROM (
    SELECT db_id, string_agg('table ' || {_quote_sql('table_name')} || ' , columns = [ ' || cols || ' ]', chr(10) ORDER BY table_ord)
        AS tables FROM (
        SELECT db_id, table_name, table_ord, string_agg({_quote_sql('table_name')} || '.' || {_quote_sql('column_name')} || ' ( ' ||
            column_type || CASE WHEN pk <> 0 THEN ' | primary key' ELSE '' END ||
            CASE WHEN column_comment <> '' THEN ' | comment : ' || column_comment ELSE '' END ||
            CASE WHEN vals <> '' THEN ' | values : ' || vals ELSE '' END || ' )', ' , ' ORDER BY column_ord) AS cols
        FROM {_COLUMNS_SQL} GROUP BY ALL) GROUP BY db_id) t
    LEFT JOIN (SELECT db_id, string_agg(src_table || '.' || src_column || ' = ' || ref_table || '.' || ref_column, chr(10)
        ORDER BY src_table, src_column, ref_table, ref_column) AS edges FROM {inputs.EDGES_SQL} GROUP BY db_id) e USING (db_id))"""


def _schema_texts(spark, sf):
    return _schemas(spark, sf).select("db_id", schema_sequence(F.col("schema_items"), F.col("foreign_keys")).alias("schema_text"))


@query("schema_sequence", f"SELECT * FROM {_SCHEMA_TEXT_SQL}")
def schema_sequence_query(spark, sf):
    return _schema_texts(spark, sf)


_CONTENT_TEXT_SQL = f"""(SELECT db_id, 'matched contents :' || chr(10) || string_agg({_quote_sql('table_name')} || '.' ||
    {_quote_sql('column_name')} || ' ( ' || vals || ' )', chr(10) ORDER BY table_name || '.' || column_name) AS content_text FROM (
    SELECT db_id, table_name, column_name, string_agg(value, ' , ' ORDER BY ord) AS vals FROM {inputs.SAMPLES_SQL} GROUP BY ALL)
    GROUP BY db_id)"""


ENTRIES = "array<struct<key:string,values:array<string>>>"


def _content_entries(spark, sf):
    """The sample values of a database in the form of matched contents."""
    samples = inputs.samples(spark, sf)
    per_column = samples.groupBy(*profile.COLUMN_KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda v: v["value"]).alias("values")
    )
    entry = F.struct(F.concat_ws(".", "table_name", "column_name").alias("key"), "values")
    return per_column.groupBy("db_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def _content_texts(spark, sf):
    return _content_entries(spark, sf).select("db_id", content_sequence(F.col("entries")).alias("content_text"))


@query("content_sequence", f"SELECT * FROM {_CONTENT_TEXT_SQL}")
def content_sequence_query(spark, sf):
    return _content_texts(spark, sf)


@query(
    "prompt_prefix",
    f"""SELECT question_id, md5(prefix) AS prefix_md5, length(prefix) AS prefix_chars FROM (
        SELECT question_id, schema_text || chr(10) || content_text || chr(10) || question || chr(10) AS prefix
        FROM {inputs.QUESTIONS_SQL} q JOIN {_SCHEMA_TEXT_SQL} s USING (db_id) JOIN {_CONTENT_TEXT_SQL} c USING (db_id))""",
)
def prompt_prefix_query(spark, sf):
    texts = _schema_texts(spark, sf).join(_content_texts(spark, sf), "db_id")  # one row per database
    asked = inputs.questions(spark, sf).join(F.broadcast(texts), "db_id")
    prefix = prompt_prefix(F.col("schema_text"), F.col("content_text"), F.col("question"))
    return asked.select(
        "question_id", F.md5(prefix).alias("prefix_md5"), F.length(prefix).cast("bigint").alias("prefix_chars")
    )


@query(
    "label_text",
    f"""SELECT db_id, table_name, column_name, non_null,
        CASE WHEN table_comment <> '' THEN table_name || ' ( ' || table_comment || ' ) ' ELSE table_name END AS table_label,
        CASE WHEN column_comment <> '' THEN column_name || ' ( ' || column_comment || ' ) ' ELSE column_name END AS column_label
    FROM {inputs.ENRICHED_SQL}""",
)
def label_text_query(spark, sf):
    rows = schema.comment_enrich(inputs.catalog(spark, sf), *inputs.comments(spark))
    return rows.select(
        "db_id",
        "table_name",
        "column_name",
        "non_null",
        label_text(F.col("table_name"), F.col("table_comment")).alias("table_label"),
        label_text(F.col("column_name"), F.col("column_comment")).alias("column_label"),
    )


# Which schema items a question about articles needs.
GOLD_TABLE = "part"
GOLD_COLUMNS = ("p_name", "p_brand", "p_retailprice")


def _scored_columns(spark, sf):
    """Every question with the columns of its database, scored for training."""
    columns = catalog_rows(spark, inputs.databases(spark, sf), inputs.PRIMARY_KEYS).select(
        "db_id", "table_name", "table_ord", "column_name", "column_ord"
    )
    # a catalog; sorted by db_id, all questions about one database would meet in one task
    asked = inputs.dealt_questions(spark, sf).select("question_id", "db_id").join(F.broadcast(columns), "db_id")
    q, t, c = F.col("question_id"), F.col("table_name"), F.col("column_name")
    return asked.withColumn(
        "table_score", schema.training_score((t == GOLD_TABLE).cast("int"), q, t, seed=7)
    ).withColumn("column_score", schema.training_score(c.isin(*GOLD_COLUMNS).cast("int"), q, t, c, seed=7))


_TOPK_SQL = f"""(SELECT question_id, db_id, table_name, column_name, table_rank, column_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, table_name ORDER BY column_score DESC, column_ord) AS column_rank FROM (
        SELECT *, dense_rank() OVER (PARTITION BY question_id ORDER BY table_score DESC, table_ord) AS table_rank FROM (
            SELECT q.question_id, c.*,
                CASE WHEN table_name = 'part' THEN '1' ELSE '0' END || md5('7:' || question_id || ':' || table_name) AS table_score,
                CASE WHEN column_name IN ('p_name', 'p_brand', 'p_retailprice') THEN '1' ELSE '0' END ||
                    md5('7:' || question_id || ':' || table_name || ':' || column_name) AS column_score
            FROM {inputs.QUESTIONS_SQL} q JOIN ({inputs.CATALOG_SQL}) c USING (db_id)))
    WHERE table_rank <= 6) WHERE column_rank <= 10)"""


@query(
    "schema_topk",
    f"""SELECT question_id, table_name, column_name, CAST(table_rank AS INT) AS table_rank,
        CAST(column_rank AS INT) AS column_rank FROM {_TOPK_SQL}""",
)
def schema_topk(spark, sf):
    kept = schema.schema_topk(_scored_columns(spark, sf))
    return kept.select("question_id", "table_name", "column_name", "table_rank", "column_rank")


@query(
    "fk_within_selection",
    f"""WITH kept AS MATERIALIZED (SELECT DISTINCT question_id, db_id, table_name FROM {_TOPK_SQL})
    SELECT q.question_id, src_table, src_column, ref_table, ref_column FROM {inputs.QUESTIONS_SQL} q
    JOIN {inputs.EDGES_SQL} e USING (db_id)
    WHERE (q.question_id, src_table) IN (SELECT question_id, table_name FROM kept)
      AND (q.question_id, ref_table) IN (SELECT question_id, table_name FROM kept)""",
)
def fk_within_selection(spark, sf):
    kept = schema.schema_topk(_scored_columns(spark, sf))
    edges = schema.foreign_key_edges(inputs.declared_keys(spark))
    asked = inputs.questions(spark, sf).select("question_id", "db_id").join(F.broadcast(edges), "db_id")  # a catalog's keys
    return schema.edges_within(asked, kept, ["question_id", "db_id"]).drop("db_id")


def _classifier_records(spark, sf):
    """Questions with their database's schema and gold labels."""
    records = inputs.questions(spark, sf).join(F.broadcast(_schemas(spark, sf, sampled=False)), "db_id")  # one row per database
    gold = F.array(*[F.lit(c) for c in GOLD_COLUMNS])
    return records.select(
        "question_id",
        F.col("question").alias("text"),
        "schema_items",
        F.transform("schema_items", lambda t: (t["table_name"] == GOLD_TABLE).cast("int")).alias("table_labels"),
        F.transform(
            "schema_items",
            lambda t: F.transform(t["columns"], lambda c: F.array_contains(gold, c["name"]).cast("int")),
        ).alias("column_labels"),
    )


_FLAT_LABELS_SQL = f"""(SELECT db_id, string_agg(CASE WHEN column_name IN ('p_name', 'p_brand', 'p_retailprice') THEN '1' ELSE '0' END,
    ',' ORDER BY table_ord, column_ord) AS column_labels, string_agg(CASE WHEN column_comment <> '' THEN column_name || ' ( ' ||
    column_comment || ' ) ' ELSE column_name END, ',' ORDER BY table_ord, column_ord) AS column_infos
    FROM {inputs.ENRICHED_SQL} GROUP BY db_id)"""
_TABLE_LABELS_SQL = f"""(SELECT db_id, string_agg(CASE WHEN table_name = 'part' THEN '1' ELSE '0' END, ',' ORDER BY table_ord)
    AS table_labels, string_agg(CASE WHEN table_comment <> '' THEN table_name || ' ( ' || table_comment || ' ) '
    ELSE table_name END, ',' ORDER BY table_ord) AS table_names
    FROM (SELECT DISTINCT db_id, table_name, table_ord, table_comment FROM {inputs.ENRICHED_SQL}) GROUP BY db_id)"""


@query(
    "flatten_labels",
    f"SELECT question_id, column_labels FROM {inputs.QUESTIONS_SQL} JOIN {_FLAT_LABELS_SQL} USING (db_id)",
)
def flatten_labels(spark, sf):
    records = _classifier_records(spark, sf)
    return records.select(
        "question_id", F.array_join(F.flatten("column_labels").cast("array<string>"), ",").alias("column_labels")
    )


@query(
    "classifier_examples",
    f"""SELECT question_id, question AS text, table_names, table_labels, column_infos, column_labels
    FROM {inputs.QUESTIONS_SQL} JOIN {_FLAT_LABELS_SQL} USING (db_id) JOIN {_TABLE_LABELS_SQL} USING (db_id)""",
)
def classifier_examples(spark, sf):
    made = schema.classifier_examples(_classifier_records(spark, sf))
    return made.select(
        "question_id",
        "text",
        F.array_join("table_names", ",").alias("table_names"),
        F.array_join(F.col("table_labels").cast("array<string>"), ",").alias("table_labels"),
        F.array_join(F.flatten("column_infos"), ",").alias("column_infos"),
        F.array_join(F.col("column_labels").cast("array<string>"), ",").alias("column_labels"),
    )


@query(
    "zip_columns",
    """SELECT conv_id, string_agg(q || ' -> ' || a, chr(10) ORDER BY i) AS pairs, count(*) AS n_pairs FROM (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text AS q FROM conversations WHERE role = 'user') u
    JOIN (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text AS a FROM conversations
        WHERE role <> 'user') v USING (conv_id, i) GROUP BY conv_id""",
)
def zip_columns(spark, sf):
    from loomwright.functions.arrays import zip_shortest

    turn = F.struct("turn", "text")
    is_user = F.col("role") == "user"

    def texts(which):
        ordered = F.array_sort(F.collect_list(F.when(which, turn)))
        return F.transform(ordered, lambda t: t["text"])

    # a group is one conversation
    lists = scan_table(spark, sf, "conversations").groupBy("conv_id").agg(texts(is_user).alias("_q"), texts(~is_user).alias("_a"))
    zipped = lists.select("conv_id", zip_shortest(q=F.col("_q"), a=F.col("_a")).alias("z")).where(F.size("z") > 0)
    return zipped.select(
        "conv_id",
        F.array_join(F.transform("z", lambda p: F.concat(p["q"], F.lit(" -> "), p["a"])), "\n").alias("pairs"),
        F.size("z").cast("bigint").alias("n_pairs"),
    )
