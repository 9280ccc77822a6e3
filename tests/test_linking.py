import os
import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions.text import COMMON_WORDS, STOPWORDS
from loomwright.operators import bm25, linking
from loomwright.plans import inputs, load
from loomwright.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
load()
SEP = "'\"()`,.?! "


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def fold(text):
    return "".join({"İ": "i", "ς": "σ"}.get(c, c.lower()) for c in text)


def match_value(question, value, theta):
    """The rules, word for word and without any speed."""
    q, v = fold(question), fold(value)
    shared = [
        (-n, i, j) for i in range(len(q)) for j in range(len(v)) for n in range(1, min(len(q) - i, len(v) - j) + 1)
        if q[i : i + n] == v[j : j + n]
    ]
    if not shared:
        return None
    size, start, place = min(shared)
    end = start - size
    if not (start == 0 or q[start] in SEP or q[start - 1] in SEP):
        return None
    stops = [p for p in range(end - 1, end + 3) if p == len(q) or p < len(q) and q[p] in SEP]
    if not stops:
        return None
    first, last = start, stops[0]
    while first < last and q[first] in SEP:
        first += 1
    while last > first and q[last - 1] in SEP:
        last -= 1
    matched, source = value[place : place - size], question[first:last]
    m, s, w = (fold(x).strip() for x in (matched, source, value))
    if not m or m == "id" or any(x in STOPWORDS for x in (m, s, w)):
        return None
    letter = lambda x: next((c for c in x if c not in SEP), x[-1:])
    score = 0.0
    if s.endswith(m + "'s"):
        score = 1.0
    elif s and letter(s) == letter(w):
        both = len(s) + len(w)
        score = (1.0 - (both - 2 * lcs(s, w)) / both) * 100 / 100
    if score < theta or score < 1 and (value.isupper() or any(x in COMMON_WORDS for x in (m, s, w))):
        return None
    return matched, source, score, -size


def test_common_length_is_not_levenshtein(spark):
    rng = random.Random(0)
    pairs = [["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in "xy"] for _ in range(300)]
    pairs += [["", "ab"], ["x" * 90, "x" * 80 + "y"]]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", linking.common_length(F.col("a"), F.col("b"))).collect()
    assert all(n == lcs(a, b) for a, b, n in got)


def scored(spark, pairs, theta):
    df = spark.createDataFrame(pairs, "question string, value string")
    return {(r.question, r.value): (r.match_str, r.source_str, r.score, r.match_size) for r in linking.score_pairs(df, theta).collect()}


def test_rules_for_one_pair(spark):
    pairs = [
        ("how many red rings", "red ring"),  # plural
        ("cost of Brand#13 now", "Brand#1"),
        ("how many rings", "the"),
        ("what id is it", "id"),
        ("say yes", "yes"),  # a common word counts when exact
        ("say yess", "yes"),
        ("visit PARI now", "PARIS"),  # upper case needs an exact match
        ("visit pari now", "Paris"),
        ("is Foo's here", "Foo"),
        ("string ring", "ring"),  # only the first place counts
        ("abc", "xyz"),
        ("", "xyz"),
        ("abc", ""),
    ]
    got = scored(spark, pairs, 0.85)
    assert got == {p: m for p in pairs if (m := match_value(*p, 0.85))}
    assert got[pairs[0]][2] == pytest.approx(16 / 17) and got[pairs[1]][1:3] == ("Brand#13", pytest.approx(14 / 15))
    assert got[pairs[4]][2] == 1 and got[pairs[7]][3] == 4 and got[pairs[8]][1] == "Foo" and len(got) == 5


WORDS = ["red", "ring", "rings", "the", "Brand#1", "Brand#13", "a", "ab", "abcd", "cold-plate", "yes", "id", "(big)", "x's", "New", "York", "newyork", "o'neil"]


def random_text(rng, longest):
    words = [rng.choice(WORDS) if rng.random() < 0.7 else "".join(rng.choice("abcr .,'") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, longest))]
    return rng.choice([" ", " ", ", "]).join(words).strip() or "a"


@pytest.mark.parametrize("theta", [0.85, 0.6, 1.0])
def test_candidates_lose_no_match(spark, theta):
    rng = random.Random(int(theta * 100))
    questions = sorted({random_text(rng, 9) for _ in range(60)} | {"long " * 14 + "tail words", "word " * 9 + "end"})
    values = sorted({random_text(rng, 4) for _ in range(250)} | {"long " * 13 + "long tail", "word " * 9 + "en", "ΣΑΣ", "İstanbul"})
    q = spark.createDataFrame([(i, "d", t) for i, t in enumerate(questions)], "question_id long, db_id string, question string")
    v = spark.createDataFrame([("d", "t", "c", t) for t in values], "db_id string, table_name string, column_name string, value string")
    found = {(r.question_id, r.value): (r.match_str, r.source_str, r.score, r.match_size) for r in linking.value_matches(q, v, theta).collect()}
    want = {}
    for i, text in enumerate(questions):
        for value in values:
            m = match_value(text, value, theta)
            if m:
                want[i, value] = m
    assert found == want and (want or theta == 1.0)


def test_last_value_wins_at_the_first_place_and_top_two(spark):
    rows = [
        (1, "d", "t", "c", "alpha", "al", "al", 0.9, 2),
        (1, "d", "t", "c", "alto", "al", "al", 0.9, 2),
        (1, "d", "t", "c", "almond", "alm", "alm", 0.9, 2),
        (1, "d", "t", "c", "zoo", "zoo", "zoo", 1.0, 3),
        (1, "d", "t", "first_name", "bob", "bob", "bobs", 0.9, 3),
        (1, "d", "t", "first_name", "bill", "bill", "bill", 1.0, 4),
    ]
    df = spark.createDataFrame(
        rows,
        "question_id long, db_id string, table_name string, column_name string, value string, match_str string, "
        "source_str string, score double, match_size int",
    )
    kept = linking.last_wins_dedupe(df)
    assert {(r.match_str, r.value, r.first_value) for r in kept.where("match_str = 'al'").collect()} == {("al", "alto", "alpha")}
    top = {(r.column_name, r["rank"]): r.value for r in linking.topk_matches(kept, 2).collect()}
    # almond sorts before alpha, so it comes first among the equals; near matches do not count in name columns
    assert top == {("c", 1): "zoo", ("c", 2): "almond", ("first_name", 1): "bill"}
    entries = linking.matched_contents(linking.topk_matches(kept, 2)).collect()[0].matched_contents
    assert [(e.key, e["values"]) for e in entries] == [("t.c", ["zoo", "almond"]), ("t.first_name", ["bill"])]


def test_whole_operator_strips_and_repeats_questions(spark):
    q = spark.createDataFrame([(1, "d", "  show red ring "), (2, "d", "show red ring"), (3, "e", "show red ring")], "question_id long, db_id string, question string")
    v = spark.createDataFrame([("d", "t", "c", "\tred ring "), ("d", "t", "c", "blue ring")], "db_id string, table_name string, column_name string, value string")
    got = sorted((r.question_id, r.value, r.score) for r in linking.value_link(q, v).collect())
    assert got == [(1, "red ring", 1.0), (2, "red ring", 1.0)]
    with pytest.raises(ValueError):
        linking.candidate_pairs(q, v, 0)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_value_link_reads_the_values_of_all_databases(spark, monkeypatch):
    asked = [(1, "web", "Which assistant answers in fr?"), (2, "star", "Which assistant answers in fr?")]
    schema = "question_id long, db_id string, question string"
    monkeypatch.setattr(inputs, "questions", lambda spark, sf: spark.createDataFrame(asked, schema))
    got = {(r.question_id, r.db_id, r.table_name, r.column_name, r.value) for r in QUERIES["value_link"](spark, SF_DIR).where("score = 1").collect()}
    assert got == {(1, "web", "conversations", "role", "assistant"), (1, "web", "documents", "lang", "fr")}


def test_long_values_are_left_out_by_the_longest_question_of_their_database(spark):
    q = spark.createDataFrame([(1, "d", "long " * 14 + "tail words"), (2, "e", "red ring")], "question_id long, db_id string, question string")
    value = "long " * 14 + "tail word"
    rows = [(d, "t", "c", value) for d in "def"] + [("e", "t", "c", "red rings")]
    v = spark.createDataFrame(rows, "db_id string, table_name string, column_name string, value string")
    assert {(r.db_id, r.value) for r in linking.value_matches(q, v).collect()} == {("d", value), ("e", "red rings")}
    assert linking.value_matches(q.limit(0), v).collect() == []


def _search_tables(spark, rng):
    """Documents of very different length over a skewed vocabulary, and queries with rare and frequent terms; one database holds almost nothing."""
    words = [f"w{i}" for i in range(300)]
    pick = lambda n: " ".join(words[min(int(rng.paretovariate(0.7)) - 1, 299)] for _ in range(n))
    docs = [("a", i, pick(rng.choice([1, 5, 40, 300]))) for i in range(400)] + [("b", i, pick(6)) for i in range(4)] + [("a", 900, ""), ("a", 901, None)]
    queries = [(i, rng.choice("ab"), pick(rng.choice([1, 3, 12, 30]))) for i in range(60)] + [(100, "a", "unknown"), (101, "c", "w1"), (102, "a", "")]
    return spark.createDataFrame(docs, "db_id string, doc_id long, contents string"), spark.createDataFrame(queries, "query_id long, db_id string, text string")


@pytest.mark.parametrize("k, k1, b", [(1, 0.9, 0.4), (10, 0.9, 0.4), (5, 2.0, 0.9), (500, 0.9, 0.4)])
def test_bounded_search_finds_the_same(spark, k, k1, b):
    docs, queries = _search_tables(spark, random.Random(k))
    index = bm25.bm25_index(docs)
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())
    assert rows(bm25.bounded_search(index, queries, k, k1, b)) == rows(bm25.bm25_search(index, queries, k, k1, b))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_bounded_search_meets_few_postings(spark):
    """Essential terms meet less than a fifth of the postings that the queries' terms have."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    queries = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").selectExpr("item_id as query_id", "'web' as db_id", "text")
    index = bm25.bm25_index(docs.selectExpr("'web' as db_id", "doc_id", "text as contents"))
    judged, _ = bm25.judged_terms(index, bm25.block_stats(index), queries)
    met = bm25._blocked(index).join(judged.where("essential"), list(bm25._BY_TERM)).count()
    assert 0 < met < index.postings.join(bm25.query_weights(index, queries), ["db_id", "term"]).count() / 5


def test_common_length_by_bits_and_by_places(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(rng.choice(["ab", "abcdefghij ", "é😀x"])) for _ in range(rng.choice([0, 1, 5, 30, 61, 62, 63, 64, 90]))) for _ in range(160)]
    pairs = [(a, b) for a, b in zip(texts, texts[1:] + texts[:1])] + [(t, t) for t in texts[:20]]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", linking.common_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == [lcs(a, b) for a, b in pairs]
