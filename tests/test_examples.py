"""Records cut inside the record."""

from pyspark.sql import functions as F

from loomwright.operators import corpus, examples, features

COLUMN = "struct<name:string,type:string,comment:string,contents:array<string>,pk:int>"
TABLE = f"struct<table_ord:int,table_name:string,table_comment:string,columns:array<{COLUMN}>>"
EDGE = "struct<src_table:string,src_column:string,ref_table:string,ref_column:string>"
SCHEMA = f"""question_id long, schema_items array<{TABLE}>, foreign_keys array<{EDGE}>,
    entries array<struct<key:string,values:array<string>>>, table_labels array<int>, column_labels array<array<int>>"""


def table(i, name, *columns):
    return (i, name, "", [(c, "text", "", [], 0) for c in columns])


RECORD = (
    1,
    [table(0, "a", "x", "y", "z"), table(1, "b", "x", "y"), table(2, "c", "x")],
    [("a", "x", "b", "x"), ("a", "y", "c", "x"), ("b", "y", "a", "z")],
    [("c.x", ["1"]), ("a.z", ["2"]), ("a.y", ["3"]), ("b.x", ["4", "5"])],
    [0, 1, 1],
    [[0, 0, 1], [1, 0], [0]],
)


def names(row):
    return [(t["table_name"], [c["name"] for c in t["columns"]]) for t in row["schema_items"]]


def test_labelled_items_stay_in_order(spark):
    rows = spark.createDataFrame([RECORD], SCHEMA)
    got = examples.cut_records(examples.label_scores(rows), 2, 1).first()
    assert names(got) == [("b", ["x"]), ("c", ["x"])]
    assert got["foreign_keys"] == []
    assert [e["key"] for e in got["entries"]] == ["c.x", "b.x"]
    whole = examples.cut_records(examples.label_scores(rows), 6, 10).first()
    assert (names(whole), len(whole["foreign_keys"]), len(whole["entries"])) == (names(rows.first()), 3, 4)


def test_keys_by_table_and_by_column(spark):
    scored = spark.createDataFrame([RECORD], SCHEMA).withColumn("table_scores", F.lit([3, 2, 1])).withColumn(
        "column_scores", F.array(F.lit([5, 5, 9]), F.lit([0, 0]), F.lit([7]))
    )
    by_table = examples.cut_records(scored, 2, 1).first()
    assert names(by_table) == [("a", ["z"]), ("b", ["x"])]  # of equal scores the earlier
    assert [tuple(e) for e in by_table["foreign_keys"]] == [("a", "x", "b", "x"), ("b", "y", "a", "z")]
    assert examples.cut_records(scored, 2, 1, by_column=True).first()["foreign_keys"] == []
    assert [e["key"] for e in by_table["entries"]] == ["a.z", "b.x"]


def test_empty_records_and_missing_labels(spark):
    rows = [(1, [], [], [], [], []), (2, *RECORD[1:4], [1], [[1]])]
    got = {r["question_id"]: r for r in examples.cut_records(examples.label_scores(spark.createDataFrame(rows, SCHEMA)), 1, 1).collect()}
    assert names(got[1]) == []
    assert names(got[2]) == [("a", ["x"])]
    text = examples.prompts(spark.createDataFrame(rows, SCHEMA).withColumn("text", F.lit("how many?"))).where("question_id = 1").first()
    assert text["prefix"] == "database schema :\nforeign keys : None\nmatched contents : None\nhow many?\n"
    assert examples.cut_records(examples.label_scores(spark.createDataFrame([], SCHEMA))).collect() == []


def test_both_texts_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(examples, "TASK_CHARS", 20)
    rows = [(i % 7 if i % 10 else None, f"how many p{i}", None if i % 4 == 0 else f"SELECT {i % 7}", i) for i in range(30)]
    prompted = spark.createDataFrame(rows, "k int, prefix string, sql string, i int")
    vocab = corpus.vocabulary(prompted, "prefix")
    made = examples.sft_features(prompted, vocab, "k", 12, 1000, 1001, keep=["i"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {r.i: r for r in made.collect()}
    assert sorted(got) == [r[3] for r in rows if r[0] is not None]
    for column, name in (("prefix", "prefix_ids"), ("sql", "target_ids")):
        tokens = corpus.tokenize(prompted, vocab, ["k"], column)
        part = tokens.select("k", F.slice("input_ids", F.lit(1), F.size("input_ids") - 1).alias(name))
        both = part if column == "prefix" else both.join(part, "k")
    alone = {r.k: r for r in features.features_train(both, 12, 1000, corpus.EOS, 1001).collect()}
    for r in got.values():
        assert (r.input_ids, r.attention_mask, r.labels) == (alone[r.k].input_ids, alone[r.k].attention_mask, alone[r.k].labels)
    assert {r.k for r in examples.sft_features(prompted, vocab, "k", 12, 1000, 1001).collect()} == set(alone)
