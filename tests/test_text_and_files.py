import json

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.functions.prompt import content_sequence, label_text, schema_sequence
from loomwright.functions.arrays import last_elements, position_ids, zip_shortest
from loomwright.operators import bm25, profile, schema
from loomwright.sources import files, tables

EDGE = ["", "   ", "\t x ", "a" * 25, "a" * 26, " b\x1c\n", "id", "the", "yes", "x\u0085"]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_strip_is_pythons(spark):
    assert column(spark, EDGE, text.strip) == [v.strip() for v in EDGE]


def test_numbers(spark):
    values = ["1", "1_000", "1,000", "inf", " 2.5 ", "1e5", ".5", "5.", "1d", "0x10", "", "nan", "--1", "1__0", "٣"]
    got = column(spark, values, text.is_number)

    def reads(v):
        try:
            float(v.replace(",", ""))
            return True
        except ValueError:
            return False

    assert got == [reads(v) for v in values]
    assert column(spark, ["1,000"], lambda c: text.is_number(c, drop_commas=False)) == [False]


def test_doubles_read_as_in_python(spark):
    values = [0.0, -1.5, 1e7, 12345678.9, 1e15, 1e16, 1.25e20, 0.001, 0.00012345, 1e-5, 2.5e-9, 1e100, float("inf"), float("-inf"), float("nan"), -12345678.25]
    assert column(spark, values, text.number_text, "double") == [str(v) for v in values]


def test_words_and_names(spark):
    assert column(spark, EDGE[6:9], text.is_stopword) == [False, True, False]
    assert column(spark, EDGE[6:9], text.is_filtered_word) == [True, True, True]
    assert column(spark, ["a b", "a-b", "(a)", "a/b", "a_b"], text.quote_identifier) == ["`a b`", "`a-b`", "`(a)`", "`a/b`", "a_b"]
    data = ["é".encode(), "é".encode("latin-1"), b"ab\xffc"]
    assert column(spark, data, text.decode_text, "binary") == ["é", "é", "abÿc"]
    assert column(spark, data, text.decode_text_dropping, "binary") == [b.decode(errors="ignore") for b in data]


def test_arrays(spark):
    assert column(spark, [[1, 2, 3], [1]], lambda c: last_elements(c, 2), "array<int>") == [[2, 3], [1]]
    assert column(spark, [[0, 0, 1, 1], [1, 0, 1]], position_ids, "array<int>") == [[1, 1, 0, 1], [0, 1, 1]]
    df = spark.createDataFrame([([1, 2, 3], ["a", "b"])], "x array<int>, y array<string>")
    assert [tuple(p) for p in df.select(zip_shortest(x=F.col("x"), y=F.col("y")).alias("z")).collect()[0].z] == [(1, "a"), (2, "b")]


RECORD = {
    "text": "how many?",
    "sql": "select 1",
    "schema": {
        "schema_items": [
            {
                "table_name": "air port",
                "table_comment": "places",
                "column_names": ["id", "city-name", "left over"],
                "column_types": ["int", "text", "text"],
                "column_comments": ["", "the city", ""],
                "column_contents": [[], ["Rome", "Oslo"], []],
                "pk_indicators": [1, 0],
            },
            {"table_name": "flight", "table_comment": "", "column_names": ["src"], "column_types": ["int"], "column_comments": [""], "column_contents": [["1"]], "pk_indicators": [0]},
        ],
        "foreign_keys": [["flight", "src", "air port", "id"]],
    },
    "matched_contents": {"air port.city-name.more": ["Rome", "Oslo"], "flight.src": ["1"]},
}


def test_example_file_to_prompt(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([RECORD, {**RECORD, "matched_contents": {}, "schema": {**RECORD["schema"], "foreign_keys": []}}]))
    df = files.read_examples(spark, str(tmp_path / "a.json"))
    nested = df.select("text", "matched_contents", *files.nested_schema(F.col("schema")))
    rendered = nested.select(
        schema_sequence(F.col("schema_items"), F.col("foreign_keys")).alias("s"),
        content_sequence(files.content_entries(F.col("matched_contents"))).alias("c"),
    ).collect()
    assert rendered[0].s == (
        "database schema :\n"
        "table `air port` , columns = [ `air port`.id ( int | primary key ) , "
        "`air port`.`city-name` ( text | comment : the city | values : Rome , Oslo ) ]\n"
        "table flight , columns = [ flight.src ( int | values : 1 ) ]\n"
        "foreign keys :\nflight.src = `air port`.id"
    )
    assert rendered[0].c == "matched contents :\n`air port`.`city-name` ( Rome , Oslo )\nflight.src ( 1 )"
    assert rendered[1].s.endswith("foreign keys : None") and rendered[1].c == "matched contents : None"
    labels = spark.createDataFrame([("t", "c"), ("t", "")], "n string, k string").select(label_text(F.col("n"), F.col("k")))
    assert [r[0] for r in labels.collect()] == ["t ( c ) ", "t"]


def test_profile_keeps_gaps_and_case(spark):
    rows = [("d", "T", "C", v) for v in ["b" * 26, "A", " c ", "  ", "d"]] + [("d", "T", "E", None)]
    cells = spark.createDataFrame(rows + rows[:2], tables.CELL_SCHEMA)
    values = profile.distinct_values(cells)
    docs = {r.id: r.contents for r in profile.content_documents(values).collect()}
    # by value: "  ", " c ", "A", "bbb…", "d"
    assert docs == {"t-**-c-**-1": "c", "t-**-c-**-2": "A", "t-**-c-**-4": "d"}
    columns = [("b" * 26, 2.5), ("A", None), (" c ", 1.5), ("  ", None), ("d", 10.0), ("  ", 1.5)]
    table = spark.createDataFrame([(*c, None) for c in columns], "C string, N double, E string")
    smallest = tables.scan_smallest_values({"d": {"T": table, "sqlite_sequence": table}})
    assert "Exchange hashpartitioning" not in smallest._jdf.queryExecution().toString()
    got = sorted((r.column_name, r.ord, r.value) for r in profile.sample_values(smallest).collect())
    assert got == [("C", 2, "c"), ("N", 1, "1.5"), ("N", 2, "10.0")]


def test_documents_are_written_in_ascii(spark, tmp_path):
    path = str(tmp_path / "docs")
    files.write_documents(spark.createDataFrame([("t-**-c-**-0", "Zürich 😀")], "id string, contents string"), path)
    raw = "".join(p.read_text("ascii") for p in (tmp_path / "docs").glob("*.json"))
    assert json.loads(raw) == {"id": "t-**-c-**-0", "contents": "Zürich 😀"}
    assert files.read_documents(spark, path).collect()[0].contents == "Zürich 😀"


def test_predictions_keep_line_order(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"p{part}.txt").write_text("".join(f"  select {part} , {i}\t\n" for i in range(50 * (part + 1))))
    got = files.read_predictions(spark, str(tmp_path)).orderBy("line_no").collect()
    want = [f"select {part} , {i}" for part in range(3) for i in range(50 * (part + 1))]
    assert [r.pred_sql for r in got] == want and [r.line_no for r in got] == list(range(len(want)))


def test_block_ids_must_fit(spark, tmp_path):
    ok = spark.createDataFrame([(1, [0, 65535]), (0, [1, 2])], "block_id long, input_ids array<int>")
    files.write_blocks(ok, str(tmp_path / "b"))
    got = files.read_blocks(spark, str(tmp_path / "b"), first=1).collect()
    assert [(r.block_id, r.input_ids, r.attention_mask, r.labels) for r in got] == [(1, [0, 65535], [1, 1], [0, 65535])]
    with pytest.raises(Exception, match="token id beyond two bytes"):
        files.write_blocks(spark.createDataFrame([(0, [65536])], "block_id long, input_ids array<int>"), str(tmp_path / "c"))


def test_one_database_of_the_index_is_replaced(spark, tmp_path):
    def index(rows):
        return bm25.bm25_index(spark.createDataFrame(rows, "db_id string, doc_id long, contents string"))

    folder = str(tmp_path / "index")
    bm25.write_index(index([("a", 1, "red ring"), ("b", 1, "blue ring")]), folder)
    bm25.write_index(index([("b", 2, "green rod rod")]), folder)
    back = bm25.read_index(spark, folder)
    assert {(r.db_id, r.doc_id, r.term, r.tf, tuple(r.positions)) for r in back.postings.collect()} == {
        ("a", 1, "red", 1, (0,)), ("a", 1, "ring", 1, (1,)), ("b", 2, "green", 1, (0,)), ("b", 2, "rod", 2, (1, 2)),
    }
    q = spark.createDataFrame([(1, "b", "rod ring"), (2, "a", "ring")], "query_id long, db_id string, text string")
    assert {(r.query_id, r.doc_id) for r in bm25.bm25_search(back, q, 5).collect()} == {(1, 2), (2, 1)}


def test_schema_cut_and_comments(spark):
    rows = [(1, "d", f"t{t}", t, f"c{c}", c, float(-t), float(c)) for t in range(8) for c in range(12)]
    df = spark.createDataFrame(rows, "question_id long, db_id string, table_name string, table_ord int, column_name string, column_ord int, table_score double, column_score double")
    kept = schema.schema_topk(df)
    assert kept.count() == 60
    assert {r.table_name for r in kept.collect()} == {f"t{t}" for t in range(6)}
    assert {r.column_name for r in kept.collect()} == {f"c{c}" for c in range(2, 12)}
    edges = spark.createDataFrame([("d", "t0", "c2", "t1", "c3"), ("d", "t0", "c2", "t7", "c3"), ("d", "t0", "c0", "t1", "c3")], "db_id string, src_table string, src_column string, ref_table string, ref_column string")
    assert schema.edges_within(edges, kept).count() == 2
    assert schema.edges_within(edges, kept, by_column=True).count() == 1
