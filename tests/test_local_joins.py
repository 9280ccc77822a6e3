"""Large sides of joins stay where they are, and short questions are dealt out before they are multiplied."""

from loomwright.operators import bm25
from loomwright.operators.ordering import ordered_index
from loomwright.plans import inputs, profiling


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rounded(scores):
    return sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in scores.collect())


def test_rows_of_groups_stay_in_their_partitions(spark):
    rows = spark.range(1000).selectExpr("id % 3 as g", "id as k")
    index = ordered_index(rows, ["k"], ["g"])
    assert "BroadcastHashJoin" in plan(index) and "SortMergeJoin" not in plan(index)
    assert all(r.idx == r.k // 3 for r in index.collect())


def test_postings_stay_in_their_partitions(spark, monkeypatch):
    monkeypatch.setattr(bm25, "TASK_CHARS", 40)
    docs = spark.createDataFrame([("d", i, "a b " * (i % 5) + "c") for i in range(20)], "db_id string, doc_id long, contents string")
    index = bm25.bm25_index(docs)
    assert index.postings.rdd.getNumPartitions() > 1  # 20 texts of up to 17 characters
    queries = spark.createDataFrame([(1, "d", "a c"), (2, "d", "b")], "query_id int, db_id string, text string")
    scores = bm25.bm25_scores(index, queries)
    assert "SortMergeJoin" not in plan(scores) and scores.count() == 20 + 16
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 0)
    assert rounded(bm25.bm25_scores(index, queries)) == rounded(scores)


SEARCHES = [(1, "web", "a c w1 w2"), (2, "web", "b w3 w3 w4"), (3, "web", "nothing here"), (4, "other", "a b")]


def searched_tables(spark):
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(i % 9)) + " a b c" * (i % 4)) for i in range(100)]
    docs = spark.createDataFrame([*rows, (100, None), (101, "")], "doc_id long, contents string")
    return docs.selectExpr("'web' as db_id", "*"), spark.createDataFrame(SEARCHES, "query_id int, db_id string, text string")


def test_texts_are_dealt_out_once(spark, monkeypatch):
    """Also when the database's name is a constant; and they are taken apart once."""
    monkeypatch.setattr(bm25, "TASK_CHARS", 200)
    docs, queries = searched_tables(spark)
    index = bm25.bm25_index(docs)
    scores = bm25.bm25_scores(index, queries)
    made = plan(scores).split("== Initial Plan ==")[0]
    assert made.count("Exchange hashpartitioning") == 1 and made.count("regexp_extract_all") == 1
    assert index.postings.where("db_id <> 'web' or term is null").count() == 0


def test_a_read_index_is_searched_in_place(spark, tmp_path, monkeypatch):
    docs, queries = searched_tables(spark)
    bm25.write_index(bm25.bm25_index(docs), str(tmp_path))
    index = bm25.read_index(spark, str(tmp_path))
    expected = bm25.bm25_index(docs).term_stats
    assert sorted(map(tuple, index.term_stats.select("db_id", "term", "df").collect())) == sorted(map(tuple, expected.collect()))
    blocks = bm25.block_stats(index)
    monkeypatch.setattr(bm25, "STEP_ROWS", 5)
    monkeypatch.setattr(bm25, "TASK_POSTINGS", 50)
    scores = bm25.bounded_scores(bm25.asked(index, queries), blocks, queries, 3)
    found = plan(scores)
    made = found.split("== Initial Plan ==")[0]
    assert made.count("Exchange hashpartitioning") == 1 and "Join" not in made.replace("BroadcastHashJoin", "")
    assert {r.query_id for r in scores.collect()} == {1, 2}
    all_scores = {(r.query_id, r.doc_id): r.score for r in bm25.bm25_scores(index, queries).collect()}
    tops = rounded(bm25.bounded_search(index, queries, 3))
    assert tops == rounded(bm25.bm25_search(index, queries, 3)) and len(tops) == 6
    assert all(abs(all_scores[r.query_id, r.doc_id] - r.score) < 1e-9 for r in bm25.bounded_search(index, queries, 3).collect())
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", 0)
    assert rounded(bm25.bounded_search(index, queries, 3)) == tops


def test_questions_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inputs, "DEALT_QUESTIONS", 10)
    spark.createDataFrame([(i, f"p{i}", "b") for i in range(95)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dealt = inputs.dealt_questions(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 96
    monkeypatch.setattr(profiling, "catalog_rows", lambda *_: spark.createDataFrame([("star", "part", 0, f"c{i}", i) for i in range(3)], "db_id string, table_name string, table_ord int, column_name string, column_ord int"))
    monkeypatch.setattr(inputs, "databases", lambda *_: {})
    scored = profiling._scored_columns(spark, str(tmp_path))
    assert scored.count() == 95 * 3 and "SortMergeJoin" not in plan(scored)
