"""Tokens are looked up inside their row."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomwright.operators import corpus
from loomwright.session import cut_lineage
from loomwright.sources import files

KEY = ["corpus_ord", "corpus", "idx"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_row_per_token(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, None), (None, "b")], "k int, sequence string")
    vocab = corpus.vocabulary(df)
    tokens = corpus.tokenize(df, vocab, ["k"])
    assert "Generate" not in plan(tokens) and "Generate" not in plan(corpus.detokenize(tokens, vocab, ["k"]))
    assert {r.k: r.length for r in tokens.collect()} == {1: 8, 2: 1, None: 2}


def test_rows_of_one_key_become_one_by_place(spark):
    df = spark.createDataFrame([(1, "b€"), (1, "a c"), (1, None), (2, "a")], "k int, sequence string")
    vocab = spark.createDataFrame([("a", 259), ("b", 258), ("c", 260), (" ", 261)], "word string, token_id int")
    tokens = corpus.tokenize(df, vocab, ["k"])
    euro = [b + 2 for b in "€".encode()]
    assert {r.k: r.input_ids for r in tokens.collect()} == {1: [258, 259, *euro, 261, 260, 0], 2: [259, 0]}
    two = spark.createDataFrame([(1, [258, 99]), (1, [259, 0, 260]), (2, None), (3, []), (4, [7777, None, 258])], "k int, input_ids array<int>")
    got = {r.k: r.sequence for r in corpus.detokenize(two, vocab, ["k"]).collect()}
    assert got == {1: "abac", 2: "", 3: "", 4: "b"}


def test_batches_may_be_empty_or_cut_out():
    words, ids = pa.array(["x"]), np.array([258], dtype=np.int32)
    kind = pa.list_(pa.list_(pa.string()))
    assert corpus.ids_of_words(pa.array([], kind), words, ids).to_pylist() == []
    rows = pa.array([[["q"]], [], [["x", "q"]], [[]], [["x"]]], kind)
    assert corpus.ids_of_words(rows.slice(1, 3), words, ids).to_pylist() == [[0], [258, 115, 0], [0]]
    numbers = pa.array([[[258]], [], [[258, 115, 0]], [[]]], pa.list_(pa.list_(pa.int32())))
    assert corpus.bytes_of_ids(numbers.slice(1, 2), words, ids).to_pylist() == [b"", b"xq"]


def test_slices_as_streams(spark):
    rows = [(o, c, i, [o * 100 + i] * (i % 3), i % 3) for o, c in enumerate(("pure_sql", "text2code")) for i in range(40)]
    tokens = spark.createDataFrame(rows, "corpus_ord int, corpus string, idx long, input_ids array<int>, length long")
    want = corpus.pack_blocks(corpus.corpus_slices(tokens), 7, ["slice"])
    got = corpus.pack_slices(tokens, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert got.columns == want.columns and got.where(F.size("input_ids") != 7).isEmpty()


def test_ascii_texts_are_taken_apart_as_others(spark, monkeypatch):
    monkeypatch.setattr(corpus, "STEP_BYTES", 7)
    texts = ["ab12  c,\x00d\n", "", None, "é1 ab", "x" * 70 + "7", "日本 12", "12", "Ab"]
    rows = [(i // 2, t) for i, t in enumerate([*texts, *texts[::-1]])]
    df = spark.createDataFrame(rows, "k int, sequence string")
    counted = corpus.word_counts(df, "sequence").groupBy("word").agg(F.sum("n").alias("n"))
    slowly = df.select(F.explode(corpus.words("sequence")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, slowly.collect()))
    vocab = corpus.vocabulary(df.where("k % 2 = 0"))
    together = df.groupBy("k").agg(F.collect_list("sequence").alias("t"))
    known = {r.word: [r.token_id] for r in vocab.collect()}
    listed = {r.k: r.w for r in together.select("k", F.transform("t", corpus.words).alias("w")).collect()}
    for r in corpus.tokenize(df, vocab, ["k"]).collect():
        spelled = [(i, known.get(w, [b + corpus.FIRST_BYTE_ID for b in w.encode()])) for t in listed[r.k] for i, w in enumerate(t)]
        assert r.input_ids == [x for _, ids in sorted(spelled) for x in ids] + [corpus.EOS]


def test_blocks_are_cut_where_the_stream_stands_in_order(spark):
    rows = [("pure_sql" if i < 20 else "text2code", i // 20, i % 20, [i * 100 + j for j in range((i * 7) % 11)]) for i in range(35)]
    df = spark.createDataFrame([(*r, len(r[3])) for r in rows], "corpus string, corpus_ord int, idx long, input_ids array<int>, length long")
    whole = sum((r[3] for r in rows), [])
    for partitions, size in ((1, 8), (6, 8), (40, 50), (3, 1), (4, len(whole)), (2, 1000)):
        tokens = cut_lineage(df.repartitionByRange(partitions, *KEY).sortWithinPartitions(*KEY))
        blocks = corpus.pack_blocks(tokens, size, ordered=True)
        assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
        got = blocks.collect()  # in order
        assert [(r.block_id, r.input_ids) for r in got] == [(i, whole[i * size : (i + 1) * size]) for i in range(len(whole) // size)]
        assert sorted(got) == sorted(corpus.pack_blocks(tokens, size).collect())


def test_tokens_in_ranges_of_keys(spark, tmp_path):
    df = spark.createDataFrame([(i % 50, f"w{i} é") for i in range(60)], "k int, sequence string")
    vocab = corpus.vocabulary(df)
    tokens = corpus.tokenize(df, vocab, ["k"], ranges=4)
    keys = [r.k for r in tokens.collect()]
    assert keys == sorted(keys) == list(range(50)) and tokens.rdd.getNumPartitions() == 4
    assert sorted(tokens.collect()) == sorted(corpus.tokenize(df, vocab, ["k"]).collect())
    stream = cut_lineage(tokens.selectExpr("0 as corpus_ord", "'pure_sql' as corpus", "k as idx", "input_ids", "length"))
    files.write_blocks(corpus.pack_blocks(stream, 5, ordered=True), str(tmp_path), ranged=True)
    parts = [[r.block_id for r in spark.read.parquet(str(p)).collect()] for p in sorted(tmp_path.glob("part-*"))]
    assert sum(parts, []) == list(range(sum(r.length for r in tokens.collect()) // 5))
