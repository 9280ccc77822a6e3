"""Queries: corpora, tokens, blocks, training examples, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions.arrays import next_token_pairs, position_ids
from loomwright.operators import corpus, features, monitor
from loomwright.plans import inputs
from loomwright.plans.profiling import scratch_path
from loomwright.plans.registry import query
from loomwright.session import cut_lineage
from loomwright.sources import files
from loomwright.sources.tables import scan_table

BLOCK = 128
# Characters of the corpora in one partition of their tokens.
TASK_CHARS = 8_000_000
MAX_TOKENS = 64
# ids beyond the vocabulary
BOS, PAD = 49152, 49153
KEY = ["corpus_ord", "corpus", "idx"]


def joined(c):
    """An array as one text, for comparing."""
    return F.array_join((F.col(c) if isinstance(c, str) else c).cast("array<string>"), ",")


@query("corpus_text", f"SELECT corpus, idx, sequence FROM {inputs.CORPORA_SQL}")
def corpus_text(spark, sf):
    return inputs.corpora(spark, sf).select("corpus", "idx", "sequence")


@query("corpus_union", f"SELECT corpus_ord, corpus, idx, length(sequence) AS n_chars FROM {inputs.CORPORA_SQL}")
def corpus_union(spark, sf):
    united = inputs.corpora(spark, sf)
    return united.select("corpus_ord", "corpus", "idx", F.length("sequence").cast("bigint").alias("n_chars"))


@query("read_corpora", f"SELECT corpus, md5(sequence) AS sequence_md5 FROM {inputs.CORPORA_SQL}")
def read_corpora(spark, sf):
    """Writes the corpora as JSON lines and reads them back."""
    folder = scratch_path(spark, "corpora")
    read = []
    for name, (df, _, parts) in inputs.raw_corpora(spark, sf).items():
        df.select(*parts).write.json(f"{folder}/{name}")
        text = corpus.corpus_text(files.read_corpus(spark, f"{folder}/{name}", name), *parts)
        read.append(text.select(F.lit(name).alias("corpus"), F.md5("sequence").alias("sequence_md5")))
    return read[0].unionByName(read[1]).unionByName(read[2])


def _tokens(spark, sf):
    # used several times by every caller, and as wide as the corpus: written once, in the order of the stream; texts as files, which are smaller
    sequences = inputs.corpora(spark, sf)
    path = scratch_path(spark, "sequences")
    sequences.write.parquet(path)
    sequences = spark.read.schema(sequences.schema).parquet(path)
    chars = sequences.agg(F.sum(F.length("sequence"))).first()[0] or 0
    parts = max(chars // TASK_CHARS + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(corpus.tokenize(sequences, corpus.vocabulary(sequences), KEY, ranges=parts))


@query("detokenize", f"SELECT corpus, idx, md5(sequence) AS sequence_md5 FROM {inputs.CORPORA_SQL}")
def detokenize(spark, sf):
    """The texts restored from their ids."""
    sequences = cut_lineage(inputs.corpora(spark, sf))
    vocab = cut_lineage(corpus.vocabulary(sequences))
    restored = corpus.detokenize(corpus.tokenize(sequences, vocab, KEY), vocab, KEY)
    return restored.select("corpus", "idx", F.md5("sequence").alias("sequence_md5"))


@query(
    "tokenize",
    f"""WITH {inputs.TOKENS_WITH} SELECT corpus, idx, string_agg(id, ',' ORDER BY pos) AS input_ids, count(*) AS length
    FROM t GROUP BY corpus, idx""",
)
def tokenize(spark, sf):
    sequences = inputs.corpora(spark, sf)
    tokens = corpus.tokenize(sequences, corpus.vocabulary(sequences), KEY)
    return tokens.select("corpus", "idx", joined("input_ids").alias("input_ids"), "length")


_SLICES_SQL = """(SELECT l.*, slice FROM l JOIN (SELECT corpus, count(*) AS n FROM l GROUP BY corpus) c
    USING (corpus) CROSS JOIN (VALUES (0, 2), (1, 4), (2, 6), (3, 8)) AS d(slice, divisor)
    WHERE idx < n // divisor * CASE WHEN corpus = 'pure_sql' THEN 2 ELSE 1 END)"""


@query("corpus_slices", f"WITH {inputs.TOKENS_WITH} SELECT corpus, slice, idx, length FROM {_SLICES_SQL}")
def corpus_slices(spark, sf):
    return corpus.corpus_slices(_tokens(spark, sf)).select("corpus", "slice", "idx", "length")


@query(
    "corpus_token_count",
    f"""WITH {inputs.TOKENS_WITH} SELECT slice, corpus, CAST(sum(length) AS BIGINT) AS n_tokens, count(*) AS n_rows FROM {_SLICES_SQL}
    GROUP BY GROUPING SETS ((slice, corpus), (slice))""",
)
def corpus_token_count(spark, sf):
    return corpus.corpus_token_count(corpus.corpus_slices(_tokens(spark, sf)))


@query(
    "prefix_offset",
    f"""WITH {inputs.TOKENS_WITH}
    SELECT corpus, idx, length, row_number() OVER o - 1 AS seq, CAST(sum(length) OVER o - length AS BIGINT) AS "offset"
    FROM l WINDOW o AS (ORDER BY corpus_ord, idx)""",
)
def prefix_offset(spark, sf):
    return corpus.prefix_offset(_tokens(spark, sf)).drop("corpus_ord")


_BLOCKS_SQL = f"""WITH {inputs.TOKENS_WITH}, g AS (
        SELECT id, row_number() OVER (ORDER BY corpus_ord, idx, pos) - 1 AS place FROM t)
    SELECT place // {BLOCK} AS block_id, string_agg(id, ',' ORDER BY place) AS input_ids, count(*) AS n_ids
    FROM g GROUP BY place // {BLOCK} HAVING count(*) = {BLOCK}"""


@query("pack_blocks", _BLOCKS_SQL)
def pack_blocks(spark, sf):
    blocks = corpus.pack_blocks(_tokens(spark, sf), BLOCK, ordered=True)
    return blocks.select(
        "block_id", joined("input_ids").alias("input_ids"), F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_ids")
    )


@query(
    "pack_slices",
    f"""WITH {inputs.TOKENS_WITH}, g AS (
        SELECT slice, id, row_number() OVER (PARTITION BY slice ORDER BY t.corpus_ord, t.idx, pos) - 1 AS place
        FROM t JOIN {_SLICES_SQL} s ON s.corpus = t.corpus AND s.idx = t.idx)
    SELECT slice, place // {BLOCK} AS block_id, string_agg(id, ',' ORDER BY place) AS input_ids
    FROM g GROUP BY slice, place // {BLOCK} HAVING count(*) = {BLOCK}""",
)
def pack_slices(spark, sf):
    """Every slice of the corpora as a stream of its own, cut into blocks."""
    blocks = corpus.pack_slices(_tokens(spark, sf), BLOCK)
    return blocks.select("slice", "block_id", joined("input_ids").alias("input_ids"))


@query("write_blocks", _BLOCKS_SQL)
def write_blocks(spark, sf):
    path = scratch_path(spark, "blocks")
    files.write_blocks(corpus.pack_blocks(_tokens(spark, sf), BLOCK, ordered=True), path, ranged=True)
    return files.read_blocks(spark, path).select(
        "block_id", joined("labels").alias("input_ids"), F.size("attention_mask").cast("bigint").alias("n_ids")
    )


@query(
    "contiguous_shard",
    f"""SELECT corpus, idx, CASE WHEN idx < r * (q + 1) THEN idx // (q + 1) ELSE r + (idx - r * (q + 1)) // nullif(q, 0) END AS shard
    FROM (SELECT l.corpus, idx, n // 2048 AS q, n % 2048 AS r FROM {inputs.CORPORA_SQL} l
        JOIN (SELECT corpus, count(*) AS n FROM {inputs.CORPORA_SQL} GROUP BY corpus) c USING (corpus))""",
)
def contiguous_shard(spark, sf):
    rows = cut_lineage(inputs.corpora(spark, sf).select("corpus", "idx"))
    sizes = rows.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    sharded = corpus.contiguous_shard(rows.join(F.broadcast(sizes), "corpus"), F.col("n"))  # three rows
    return sharded.select("corpus", "idx", "shard")


@query(
    "next_token_pairs",
    f"""WITH {inputs.TOKENS_WITH} SELECT id AS input, target, count(*) AS n FROM (
        SELECT id, lead(id) OVER (PARTITION BY corpus, idx ORDER BY pos) AS target FROM t) WHERE target IS NOT NULL
    GROUP BY id, target""",
)
def next_token_pairs_query(spark, sf):
    tokens = _tokens(spark, sf)
    pairs = tokens.select(F.inline(next_token_pairs(F.col("input_ids"))))
    return pairs.groupBy(F.col("input").cast("bigint").alias("input"), F.col("target").cast("bigint").alias("target")).agg(
        F.count(F.lit(1)).alias("n")
    )


# ---------------------------------------------------------------------------------------------------------------------
# Examples from dialogues


def _turn_ids(spark, sf, text="text"):
    """Ids of every turn (without end mark), by a vocabulary of all turns; ``text`` may change the turn's text."""
    turns = scan_table(spark, sf, "conversations")
    vocab = corpus.vocabulary(turns, "text")
    ids = corpus.tokenize(turns.select("conv_id", "turn", F.expr(text).alias("text")), vocab, ["conv_id", "turn"], "text")
    return ids.select("conv_id", "turn", F.slice("input_ids", F.lit(1), F.size("input_ids") - 1).alias("ids"))


def _examples(spark, sf):
    ids = cut_lineage(_turn_ids(spark, sf))
    asked = scan_table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn")
    targets = ids.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("target_ids"))
    return (
        ids.join(asked, ["conv_id", "turn"])
        .withColumnRenamed("ids", "prefix_ids")
        .join(targets, ["conv_id", "turn"])
        .select(F.concat_ws("/", "conv_id", "turn").alias("example"), "prefix_ids", "target_ids")
    )


def _example_with(target_text: str = "text") -> str:
    """x: one row per example with prefix (p, led by the begin mark) and target (y, followed by the end mark) as lists."""
    def listed(words: str) -> str:
        exploded = f"SELECT conv_id, turn, unnest({words}) AS word, generate_subscripts({words}, 1) AS p FROM w"
        return f"""SELECT conv_id, turn, list(id ORDER BY pos) AS ids FROM ({inputs.ids_sql("conv_id, turn", exploded)})
            GROUP BY conv_id, turn"""

    return f"""WITH w AS MATERIALIZED (SELECT conv_id, turn, role, regexp_extract_all(text, '{inputs.WORD}') AS words,
            regexp_extract_all({target_text}, '{inputs.WORD}') AS other FROM conversations),
        v AS MATERIALIZED {inputs.VOCABULARY_SQL},
        i AS MATERIALIZED ({listed("words")}),
        j AS MATERIALIZED ({listed("other")}),
        x AS MATERIALIZED (SELECT a.conv_id || '/' || a.turn AS example, list_concat([{BOS}], coalesce(i.ids, [])) AS p,
            list_concat(coalesce(j.ids, []), [0]) AS y FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
            LEFT JOIN i ON i.conv_id = a.conv_id AND i.turn = a.turn
            LEFT JOIN j ON j.conv_id = b.conv_id AND j.turn = b.turn WHERE a.role = 'user'),
        n AS MATERIALIZED (SELECT example, p, y, list_concat(p, y) AS ids, len(p) + len(y) AS size FROM x)"""


def _fill(value, count: str) -> str:
    return f"list_transform(range(greatest({count}, 0)), lambda k: {value})"


def _text(lists: str) -> str:
    return f"array_to_string({lists}, ',')"


_M = MAX_TOKENS
_CUT_IDS = f"list_concat([{BOS}], ids[-{_M - 1}:])"
_TRAIN_COLUMNS = f"""example, {_text(f"CASE WHEN size <= {_M} THEN list_concat(ids, {_fill(PAD, f'{_M} - size')}) ELSE {_CUT_IDS} END")}
        AS input_ids,
    {_text(f"CASE WHEN size <= {_M} THEN list_concat({_fill(1, 'size')}, {_fill(0, f'{_M} - size')}) ELSE {_fill(1, str(_M))} END")}
        AS attention_mask,
    {_text(f"CASE WHEN size <= {_M} THEN list_concat(list_concat({_fill(-100, 'len(p)')}, y), {_fill(-100, f'{_M} - size')}) "
           f"ELSE list_concat({_fill(-100, 'len(p)')}, y)[-{_M}:] END")} AS labels"""


def _as_text(df, *columns):
    return df.select("example", *[joined(c).alias(c) for c in columns])


@query("features_train", f"{_example_with()} SELECT {_TRAIN_COLUMNS} FROM n")
def features_train(spark, sf):
    made = features.features_train(_examples(spark, sf), MAX_TOKENS, BOS, corpus.EOS, PAD)
    return _as_text(made, "input_ids", "attention_mask", "labels")


@query(
    "features_ppo",
    f"""{_example_with()} SELECT example,
    {_text(f"CASE WHEN size <= {_M} THEN list_concat({_fill(PAD, f'{_M} - len(p)')}, p) ELSE {_CUT_IDS} END")} AS input_ids,
    {_text(f"CASE WHEN size <= {_M} THEN list_concat({_fill(0, f'{_M} - len(p)')}, {_fill(1, 'len(p)')}) ELSE {_fill(1, str(_M))} END")}
        AS attention_mask,
    {_text(f"CASE WHEN size <= {_M} THEN list_concat({_fill(PAD, f'{_M} - len(y)')}, y) ELSE y END")} AS response FROM n""",
)
def features_ppo(spark, sf):
    made = features.features_ppo(_examples(spark, sf), MAX_TOKENS, BOS, corpus.EOS, PAD)
    return _as_text(made, "input_ids", "attention_mask", "response")


_EVAL_LENGTH = 32
_EVAL_IDS = f"CASE WHEN len(p) > {_EVAL_LENGTH} THEN list_concat([{BOS}], p[-{_EVAL_LENGTH - 1}:]) ELSE p END"


@query(
    "features_eval",
    f"""{_example_with()} SELECT example, {_text(_EVAL_IDS)} AS input_ids,
    {_text(_fill(1, f"len({_EVAL_IDS})"))} AS attention_mask FROM n""",
)
def features_eval(spark, sf):
    made = features.features_eval(_examples(spark, sf).drop("target_ids"), _EVAL_LENGTH, BOS)
    return _as_text(made, "input_ids", "attention_mask")


@query("tail_truncate", f"{_example_with()} SELECT example, {_text(_CUT_IDS)} AS ids FROM n WHERE size > {_M}")
def tail_truncate(spark, sf):
    ids = F.concat(F.array(F.lit(BOS)), F.col("prefix_ids"), F.col("target_ids"), F.array(F.lit(corpus.EOS)))
    rows = _examples(spark, sf).select("example", ids.alias("ids")).where(F.size("ids") > MAX_TOKENS)
    return rows.select("example", joined(features.tail_truncate(F.col("ids"), MAX_TOKENS, BOS)).alias("ids"))


# The teacher's output stands in for the gold target: the same turn, doubled.
_TEACHER_TEXT = "text || ' ' || text"


@query(
    "seqkd_target_join",
    f"SELECT conv_id || '/' || turn AS example, prefix, target || ' ' || target AS target FROM {inputs.PAIRS_SQL}",
)
def seqkd_target_join(spark, sf):
    example = F.concat_ws("/", "conv_id", "turn").alias("example")
    pairs = inputs.turn_pairs(spark, sf)
    outputs = pairs.select(example, F.concat_ws(" ", "target", "target").alias("teacher_target"))
    return features.seqkd_target_join(pairs.select(example, "prefix", "target"), outputs, "example")


@query("features_seqkd", f"{_example_with(_TEACHER_TEXT)} SELECT {_TRAIN_COLUMNS} FROM n")
def features_seqkd(spark, sf):
    outputs = _turn_ids(spark, sf, _TEACHER_TEXT).select(
        F.concat_ws("/", "conv_id", F.col("turn") - 1).alias("example"), F.col("ids").alias("teacher_target")
    )
    made = features.features_seqkd(_examples(spark, sf), outputs, "example", MAX_TOKENS, BOS, corpus.EOS, PAD)
    return _as_text(made, "input_ids", "attention_mask", "labels")


@query(
    "position_ids",
    f"""{_example_with()} SELECT example, string_agg(CASE WHEN m = 0 THEN 1 ELSE k - 1 END, ',' ORDER BY i) AS position_ids FROM (
        SELECT example, i, m, sum(m) OVER (PARTITION BY example ORDER BY i) AS k FROM (
            SELECT example, CAST(unnest(range({_M})) AS INT) AS i,
                CASE WHEN size > {_M} OR unnest(range({_M})) >= {_M} - len(p) THEN 1 ELSE 0 END AS m FROM n)) GROUP BY example""",
)
def position_ids_query(spark, sf):
    made = features.features_ppo(_examples(spark, sf), MAX_TOKENS, BOS, corpus.EOS, PAD)
    return made.select("example", joined(position_ids(F.col("attention_mask"))).alias("position_ids"))


# ---------------------------------------------------------------------------------------------------------------------
# Batches

EPOCHS, BATCH = 3, 16


def _batches_sql(table="documents", key="doc_id") -> str:
    return f"""(SELECT epoch, place // {BATCH} AS batch_id, place % {BATCH} AS pos, {key} FROM (
        SELECT epoch, {key}, row_number() OVER (PARTITION BY epoch ORDER BY md5('5:' || epoch || ':' || {key}), {key}) - 1 AS place,
            count(*) OVER (PARTITION BY epoch) AS n FROM {table} CROSS JOIN (SELECT CAST(unnest(range({EPOCHS})) AS INT) AS epoch))
    WHERE place // {BATCH} < n // {BATCH})"""


@query("shuffled_batches", f"SELECT * FROM {_batches_sql()}")
def shuffled_batches(spark, sf):
    return corpus.shuffled_batches(scan_table(spark, sf, "documents"), "doc_id", EPOCHS, BATCH, seed=5)


_ACCUMULATION = 2  # resumed after one and a half epochs, whatever the size of the table


@query(
    "resume_filter",
    f"""SELECT b.* FROM {_batches_sql()} b,
        (SELECT per_epoch, per_epoch * 3 // 4 * {_ACCUMULATION} AS done FROM (SELECT count(*) // {BATCH} AS per_epoch FROM documents))
    WHERE epoch > done // per_epoch OR (epoch = done // per_epoch AND batch_id >= done % per_epoch)""",
)
def resume_filter(spark, sf):
    docs = scan_table(spark, sf, "documents")
    batches = corpus.shuffled_batches(docs, "doc_id", EPOCHS, BATCH, seed=5)
    per_epoch = docs.count() // BATCH
    return monitor.resume_filter(batches, per_epoch * 3 // 4, _ACCUMULATION, per_epoch)


def _permuted_sql(seed: int, resumed: str = "") -> str:
    """One row per round: x and y of a cell change places, the new y is moved by the hash of the old one."""
    (m1, m2), (p1, p2), rounds = corpus.MULTIPLIERS, corpus.PRIMES, corpus.ROUNDS
    key = f"((({seed} * 7919 + epoch * 104729 + 12345 + (r % {rounds}) * 1299709) % {p1}) * {m2} % {p2})"
    line = f"((y * {m1} + {key}) % {p1})"
    moved = f"((({line} * {line}) % {p1} * {line} + {key}) % {p1} * {m2} % {p2}) // 1024"
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b, n // {BATCH} AS per_epoch FROM (
            SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM documents)),
        d AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
        c(epoch, i, r, x, y) AS (
            SELECT CAST(epoch AS BIGINT), i, CAST(0 AS BIGINT), i % a, i // a FROM d, s, (SELECT unnest(range({EPOCHS})) AS epoch)
            UNION ALL SELECT epoch, i, r + 1, y, (x + {moved}) % (CASE WHEN r % 2 = 0 THEN a ELSE b END)
            FROM c, s WHERE r = 0 OR r % {rounds} <> 0 OR y * a + x >= n)
        SELECT CAST(epoch AS INT) AS epoch, place // {BATCH} AS batch_id, place % {BATCH} AS pos, doc_id
        FROM (SELECT epoch, i, y * a + x AS place FROM c, s WHERE r > 0 AND r % {rounds} = 0 AND y * a + x < n) JOIN d USING (i), s
        WHERE place // {BATCH} < per_epoch {resumed}"""


def _permuted(spark, sf, done=lambda per_epoch: 0):
    indexed = cut_lineage(corpus.row_index(scan_table(spark, sf, "documents").select("doc_id"), ["doc_id"]))
    n = indexed.count()
    return corpus.permuted_batches(indexed, n, "doc_id", EPOCHS, BATCH, seed=5, done=done(n // BATCH))


@query("permuted_batches", _permuted_sql(5))
def permuted_batches(spark, sf):
    """The batches of all epochs by a keyed permutation of the row index."""
    return _permuted(spark, sf)


@query("permuted_resume", _permuted_sql(5, f"AND epoch * per_epoch + place // {BATCH} >= per_epoch * 3 // 4 * {_ACCUMULATION}"))
def permuted_resume(spark, sf):
    """What is left of them after one and a half epochs."""
    return _permuted(spark, sf, lambda per_epoch: per_epoch * 3 // 4 * _ACCUMULATION)
