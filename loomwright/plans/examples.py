"""Queries: nested examples read from files, cut, rendered and made into features in one go."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions.prompt import content_sequence, schema_sequence
from loomwright.operators import corpus, examples
from loomwright.plans import inputs, profiling
from loomwright.plans.corpora import BOS, PAD, _fill, _text, joined
from loomwright.plans.registry import query
from loomwright.session import cut_lineage
from loomwright.sources import files

LENGTH, SEED = 512, 7
RECORD = f"question_id bigint, table_labels array<int>, column_labels array<array<int>>, {files.EXAMPLE_SCHEMA}"
_GOLD_SQL = """CASE WHEN db_id = 'star' THEN 'SELECT count(*) FROM part WHERE p_partkey <> ' || question_id
    ELSE 'SELECT text FROM benchmark WHERE item_id = ' || (-1 - question_id) END"""


def written_examples(spark, sf):
    """The path of one record a line: every question with the schema of its database, sample values as matched contents, gold labels."""
    schemas = profiling._schemas(spark, sf).join(profiling._content_entries(spark, sf), "db_id", "left")  # one row per database
    gold = F.array(*[F.lit(c) for c in profiling.GOLD_COLUMNS])

    def lists(t):
        def column(name):
            return F.transform(t["columns"], lambda c: c[name])

        return F.struct(
            t["table_name"].alias("table_name"),
            t["table_comment"].alias("table_comment"),
            column("name").alias("column_names"),
            column("type").alias("column_types"),
            column("comment").alias("column_comments"),
            column("contents").alias("column_contents"),
            column("pk").alias("pk_indicators"),
        )

    def edge(e):
        return F.array(e["src_table"], e["src_column"], e["ref_table"], e["ref_column"])

    def labels(t):
        return F.transform(t["columns"], lambda c: F.array_contains(gold, c["name"]).cast("int"))

    record = F.struct(
        F.transform("schema_items", lists).alias("schema_items"), F.transform("foreign_keys", edge).alias("foreign_keys")
    )
    schemas = schemas.select(
        "db_id",
        record.alias("schema"),
        F.map_from_entries("entries").alias("matched_contents"),
        F.transform("schema_items", lambda t: (t["table_name"] == profiling.GOLD_TABLE).cast("int")).alias("table_labels"),
        F.transform("schema_items", labels).alias("column_labels"),
    )
    asked = inputs.dealt_questions(spark, sf).withColumnRenamed("question", "text").withColumn("sql", F.expr(_GOLD_SQL))
    path = profiling.scratch_path(spark, "examples")
    # one row per database; sorted by db_id, all records about one database would meet in one task
    asked.join(F.broadcast(schemas), "db_id").drop("db_id").write.json(path)
    return path


def read_records(spark, sf):
    """The records in the nested form."""
    found = files.read_examples(spark, written_examples(spark, sf), RECORD, lines=True)
    entries = F.coalesce(files.content_entries(F.col("matched_contents")), F.array().cast(profiling.ENTRIES))
    return found.select(
        "question_id", "text", "sql", "table_labels", "column_labels", *files.nested_schema(F.col("schema")), entries.alias("entries")
    )


@query(
    "read_examples",
    f"""SELECT question_id, question AS text, {_GOLD_SQL} AS sql, md5(schema_text) AS schema_md5,
        md5(coalesce(content_text, 'matched contents : None')) AS content_md5
    FROM {inputs.QUESTIONS_SQL} JOIN {profiling._SCHEMA_TEXT_SQL} USING (db_id) LEFT JOIN {profiling._CONTENT_TEXT_SQL} USING (db_id)""",
)
def read_examples(spark, sf):
    """Writes the examples as files and reads them; schema and matched values are rendered from what was read."""
    return read_records(spark, sf).select(
        "question_id",
        "text",
        "sql",
        F.md5(schema_sequence(F.col("schema_items"), F.col("foreign_keys"))).alias("schema_md5"),
        F.md5(content_sequence(F.col("entries"))).alias("content_md5"),
    )


_quote = profiling._quote_sql
# k: kept columns; y: prompt and gold query of each question
_PROMPTS_SQL = f"""k AS MATERIALIZED (SELECT question_id, db_id, table_name, column_name FROM {profiling._TOPK_SQL}),
    c AS MATERIALIZED (SELECT * FROM {profiling._COLUMNS_SQL}),
    o AS MATERIALIZED (SELECT db_id, table_name, column_name, string_agg(value, ' , ' ORDER BY ord) AS vals FROM {inputs.SAMPLES_SQL} GROUP BY ALL),
    t AS MATERIALIZED (SELECT question_id, string_agg('table ' || {_quote('table_name')} || ' , columns = [ ' || cols || ' ]', chr(10) ORDER BY table_ord)
        AS tables FROM (SELECT question_id, table_name, table_ord, string_agg({_quote('table_name')} || '.' || {_quote('column_name')} || ' ( ' ||
            column_type || CASE WHEN pk <> 0 THEN ' | primary key' ELSE '' END ||
            CASE WHEN column_comment <> '' THEN ' | comment : ' || column_comment ELSE '' END ||
            CASE WHEN vals <> '' THEN ' | values : ' || vals ELSE '' END || ' )', ' , ' ORDER BY column_ord) AS cols
        FROM k JOIN c USING (db_id, table_name, column_name) GROUP BY ALL) GROUP BY question_id),
    h AS MATERIALIZED (SELECT DISTINCT question_id, db_id, table_name FROM k),
    e AS MATERIALIZED (SELECT question_id, string_agg(src_table || '.' || src_column || ' = ' || ref_table || '.' || ref_column, chr(10)
        ORDER BY src_table, src_column, ref_table, ref_column) AS edges FROM {inputs.EDGES_SQL} x JOIN h USING (db_id)
        WHERE src_table = h.table_name AND EXISTS (SELECT 1 FROM h g WHERE g.question_id = h.question_id AND g.table_name = ref_table)
        GROUP BY question_id),
    m AS MATERIALIZED (SELECT question_id, string_agg({_quote('table_name')} || '.' || {_quote('column_name')} || ' ( ' || vals || ' )', chr(10)
        ORDER BY table_name || '.' || column_name) AS matched FROM k JOIN o USING (db_id, table_name, column_name) GROUP BY question_id),
    y AS MATERIALIZED (SELECT question_id, 'database schema :' || chr(10) || tables || chr(10) ||
            coalesce('foreign keys :' || chr(10) || edges, 'foreign keys : None') || chr(10) ||
            coalesce('matched contents :' || chr(10) || matched, 'matched contents : None') || chr(10) || question || chr(10) AS prefix,
            {_GOLD_SQL} AS sql
        FROM {inputs.QUESTIONS_SQL} JOIN t USING (question_id) LEFT JOIN e USING (question_id) LEFT JOIN m USING (question_id))"""
_KEYS = "question_id, part"
_EXPLODED = f"SELECT {_KEYS}, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w"
_IDS = f"CASE WHEN size <= {LENGTH} THEN list_concat(ids, {_fill(PAD, f'{LENGTH} - size')}) ELSE list_concat([{BOS}], ids[-{LENGTH - 1}:]) END"
_LABELS = f"""CASE WHEN size <= {LENGTH} THEN list_concat(list_concat({_fill(-100, 'len(a)')}, b), {_fill(-100, f'{LENGTH} - size')})
    ELSE list_concat({_fill(-100, 'len(a)')}, b)[-{LENGTH}:] END"""


@query(
    "sft_examples",
    f"""WITH {_PROMPTS_SQL},
        w AS MATERIALIZED (SELECT question_id, 0 AS part, regexp_extract_all(prefix, '{inputs.WORD}') AS words FROM y
            UNION ALL SELECT question_id, 1, regexp_extract_all(sql, '{inputs.WORD}') FROM y),
        v AS MATERIALIZED {inputs.VOCABULARY_SQL},
        i AS MATERIALIZED (SELECT {_KEYS}, list(id ORDER BY pos) AS ids FROM ({inputs.ids_sql(_KEYS, _EXPLODED)}) GROUP BY {_KEYS}),
        n AS MATERIALIZED (SELECT *, list_concat(a, b) AS ids, len(a) + len(b) AS size FROM (SELECT y.question_id, md5(prefix) AS prefix_md5,
            list_concat([{BOS}], coalesce(p.ids, [])) AS a, list_concat(coalesce(s.ids, []), [0]) AS b FROM y
            LEFT JOIN i p ON p.question_id = y.question_id AND p.part = 0 LEFT JOIN i s ON s.question_id = y.question_id AND s.part = 1))
    SELECT question_id, prefix_md5, CAST(least(size, {LENGTH}) AS INT) AS n_tokens, md5({_text(_IDS)}) AS ids_md5,
        md5({_text(_LABELS)}) AS labels_md5 FROM n""",
)
def sft_examples(spark, sf):
    """From the files to features: records read, schema and matched values cut, prompts rendered, tokenised and made into features."""
    scored = examples.label_scores(read_records(spark, sf), seed=SEED)
    prompted = cut_lineage(examples.prompts(examples.cut_records(scored)).select("question_id", "prefix", "sql"))
    texts = prompted.select(F.explode(F.array("prefix", "sql")).alias("sequence"))
    hashed = prompted.withColumn("prefix_md5", F.md5("prefix"))
    made = examples.sft_features(hashed, corpus.vocabulary(texts), "question_id", LENGTH, BOS, PAD, keep=["prefix_md5"])
    return made.select(
        "question_id",
        "prefix_md5",
        F.aggregate("attention_mask", F.lit(0), lambda n, one: n + one).alias("n_tokens"),
        F.md5(joined("input_ids")).alias("ids_md5"),
        F.md5(joined("labels")).alias("labels_md5"),
    )
