"""BPE against the public library, language and quality on held-out rows, neighbours against brute force."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from fixtures import corpus, row, rows
from tokenizers import Tokenizer

from loomwright.llm import ann, bpe, langid, quality

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def test_random_texts(library, vocabulary):
    rng = random.Random(3)
    letters = ["abcdefgh ", "the ing tion ", "  \n\t\r\x0b\x1c\x85  　 a", "0123٣५", "日本語한😀👩‍👩‍👧é́ﬀßſK", "'s'll<|endoftext|>", "=-_!?", "\x00"]
    for _ in range(500):
        s = "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 80))) + rng.choice(["", "<|endoftext|>x"])
        ids = vocabulary.encode([s])[0]
        want = library.encode(s, add_special_tokens=False).ids
        assert ids == want and vocabulary.decode(ids) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 20_000, "-" * 9_000, " " * 9_000, "thing" * 5_000, "é" * 3_000])
def test_long_words(library, vocabulary, text):
    assert vocabulary.encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_neighbouring_tokens(vocabulary):
    """The border rule agrees with plain merging of both tokens' bytes."""

    def merged(raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            ranked = [(vocabulary.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in vocabulary.ranks]
            if not ranked:
                return parts
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(5)
    ids = list(vocabulary.ids.values())
    for _ in range(3_000):
        a, b = rng.choice(ids), rng.choice(ids[:600])
        x, y = vocabulary.bytes[a], vocabulary.bytes[b]
        assert vocabulary.beside(a, b) == (merged(x + y) == [x, y])


def test_words_are_forgotten(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 50)
    rng = random.Random(9)
    texts = [" ".join(str(rng.randint(0, 10**6)) for _ in range(40)) for _ in range(20)]
    for t in texts:
        assert vocabulary.encode([t])[0] == library.encode(t, add_special_tokens=False).ids


def test_round_trip_rows(spark, library):
    got = bpe.round_trip(corpus(spark), PATH).collect()
    assert len(got) == len(rows())
    want = {}
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.setdefault(r[0], set()).add(
            (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)))
        )
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) in want[r.doc_id] for r in got)
    assert got[0].asDict().keys() >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and "text" not in got[0]
    listed = bpe.round_trip(corpus(spark).select("doc_id", "text", "kept"), PATH, ids="ids").collect()
    assert all(hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 and r.kept == "own" for r in listed)
    both = bpe.encode(corpus(spark), PATH)
    assert both.columns == [c for c in corpus(spark).columns if c != "ids"] + ["ids"]
    assert bpe.round_trip(corpus(spark, []), PATH).collect() == []


def test_vocabulary_goes_with_its_broadcast(spark):
    """A worker that turns to other work no longer holds the vocabulary and the words remembered."""

    def held(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(isinstance(x, bpe.Vocabulary) for x in gc.get_objects())]})

    assert bpe.round_trip(corpus(spark).repartition(8), PATH).count() == len(rows())
    bpe.encode(corpus(spark).repartition(8), PATH).write.format("noop").mode("overwrite").save()
    found = spark.range(0, 32, 1, 8).mapInArrow(held, "n long").collect()
    assert len(found) == 8 and sum(r.n for r in found) == 0


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([([15496, None, -1, 10**6, 50256],), (None,), ([187],)], "ids array<int>")
    assert [r.text for r in bpe.decode(df, PATH).collect()] == ["Hello<|endoftext|>", "", bpe.Vocabulary(open(PATH).read()).decode([187])]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def plain_languages(learned, texts, languages):
    """The method read plainly: counts in dictionaries, one word and one language at a time."""
    words, grams = {x: Counter() for x in languages}, {(x, n): Counter() for x in languages for n in range(1, 6)}
    for text, lang in learned:
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            words[lang][w] += 1
            for n in range(1, 6):
                grams[lang, n].update(langid.gram_texts(w, n))
    prior = Counter(lang for _, lang in learned)

    def logs(counts, entry):
        every = set().union(*counts)
        return [math.log(c[entry] + 0.5) - math.log(max(sum(c.values()), 1) + 0.5 * len(every)) for c in counts] if entry in every else None

    def of_word(w):
        found = logs([words[x] for x in languages], w)
        for n in range(5, 0, -1):
            if found is None:
                known = [g for g in (logs([grams[x, n] for x in languages], g) for g in langid.gram_texts(w, n)) if g]
                found = [sum(column) / len(known) for column in zip(*known)] if known else None
        return found or [0.0] * len(languages)

    out = []
    for text in texts:
        split = regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
        total = [math.log(prior[x] / len(learned)) for x in languages]
        for w in split:
            total = [a + b for a, b in zip(total, of_word(w))]
        best = max(range(len(languages)), key=lambda i: total[i])
        out.append((languages[best], 1 / sum(math.exp(t - total[best]) for t in total)) if split else ("und", 0.0))
    return out


def test_languages_against_plain_scoring(spark):
    rng = random.Random(8)
    own = {"de": "der die und Haus Bäume Straße nicht", "en": "the and house trees street not", "fr": "le la et maison arbres rue pas"}
    data = [r for r in rows() if r[0] != 152]
    for i in range(60):
        lang = rng.choice(list(own))
        words = [rng.choice(own[lang].split()) + rng.choice(["", "", "en", "s", "x"]) for _ in range(rng.randint(1, 9))]
        data.append(row(2_000 + i, " ".join(words), lang))
    got = {(r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.languages(corpus(spark, data)).collect()}
    learned = [(r[1], r[2]) for r in data if r[1] is not None and r[2] and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 4 != 2]
    found = plain_languages(learned, [r[1] for r in data], sorted({x for _, x in learned}))
    assert got == {(r[0], name, round(score, 4)) for r, (name, score) in zip(data, found)}


def test_language_sample(spark):
    """The share that is learned from follows the characters of a language, and rows of one id differ by their text."""
    docs = corpus(spark, [row(7, f"text number {i}", "en") for i in range(400)] + [row(i, "kurz", "de") for i in range(20)])
    per_language = spark.createDataFrame([("en", 400, 6_000), ("de", 20, 80)], "lang string, docs long, chars long")
    counts = Counter(r.lang for r in langid.sampled(docs.select("doc_id", "text", "lang"), per_language, 1_500).collect())
    assert 60 < counts["en"] < 140 and counts["de"] == 20


def test_columns_that_clash_in_another_case(spark):
    df = spark.createDataFrame([(1, "the house", "en", "own", "own", "own")], "doc_id long, text string, lang string, Score string, Lang_Pred string, IDS string")
    found = langid.predict(df, langid.fit(df))
    assert found.columns == ["doc_id", "text", "lang", "IDS", "lang_pred", "score"] and found.first().lang_pred == "en"
    assert [tuple(r) for r in langid.accepted(df).collect()] in ([], [tuple(df.first())]) and langid.accepted(df).columns == df.columns
    coded = bpe.round_trip(df, PATH, ids="ids")
    assert coded.columns == ["doc_id", "lang", "Score", "Lang_Pred", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert len(coded.first().ids) == coded.first().n_tokens


def test_language_cases(spark):
    texts = [("der Hund und die Katze", "de"), ("the dog and the cat", "en"), ("le chien et la vache", "fr")]
    data = [row(i, texts[i % 3][0], texts[i % 3][1]) for i in range(60)]
    extra = [row(1001, None), row(1002, "  12 ?"), row(1003, "Katzen", None), row(1004, "THE CATS", None), row(None, "vaches", None, None), row(1005, "日本")]
    got = {r.doc_id: r for r in langid.languages(corpus(spark, data + extra)).collect()}
    assert [got[k].lang_pred for k in (1001, 1002, 1003, 1004, None)] == ["und", "und", "de", "en", "fr"]
    assert got[1005].lang_pred in ("de", "en", "fr")
    unlearned = langid.languages(corpus(spark, [row(1, "text", None)])).first()
    assert (unlearned.lang_pred, unlearned.score) == ("und", 0.0)
    assert langid.languages(corpus(spark, [])).collect() == []
    kept = langid.accepted(corpus(spark, data + extra))
    assert kept.columns == corpus(spark).columns and {1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())


def test_known_words_and_grams_have_all_their_counts(spark):
    many = " ".join(2 * ["".join("abcdefghij"[int(c)] for c in f"{i:04d}") for i in range(6000)])
    model = langid.fit(corpus(spark, [row(1, f"{many} jjjj jjjj", "x"), row(2, "jjjj zz zz", "y")]))
    assert len(model.words) == 6002
    # Frequent in one language, counted once in the other.
    total, size = np.array([12002, 3]), 6002
    assert model.words["jjjj"] == pytest.approx(np.log(np.array([2, 1]) + 0.5) - np.log(total + 0.5 * size))
    grams = {f"_{w}_"[i : i + 5] for w in model.words for i in range(len(w) - 2)}
    assert set(model.grams[5]) == {g for g in grams if len(g) == 5}


def test_backoff_goes_from_long_to_short():
    model = langid.Model(["x", "y"], {}, {2: {"ab": np.array([-1.0, -5.0])}, 1: {"a": np.array([-9.0, -1.0])}}, np.zeros(2))
    assert model.of_word("ab").argmax() == 0  # the longer n-gram decides
    assert model.of_word("ac").argmax() == 1
    assert not model.of_word("zz").any()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.qualities(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = (got.score[got.quality == q].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_quality_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = quality.qualities(corpus(spark), labels).collect()
    assert len(got) == len(rows()) and {r.score for r in got} == {0.5}
    assert quality.qualities(corpus(spark, []), labels).collect() == []
    both = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    scored = quality.score(corpus(spark), quality.fit(corpus(spark), both))
    assert scored.columns == [*corpus(spark).columns, "predicted"] and all(0 <= r.score <= 1 for r in scored.collect())


def test_pairwise_loss_finds_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    labels = (x @ [2.0, -1.0, 0.0] > 0.5).astype(int)
    model = quality.fit_rows(x, labels)
    score = model.scores(x)
    assert score[labels == 1].min() > score[labels == 0].max() - 0.2
    assert abs((score >= quality.THRESHOLD).mean() - labels.mean()) < 0.02


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, list string, score string")


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16))
    x = (centres[np.arange(900) % 8] + 0.3 * rng.normal(size=(900, 16))).astype("float32")
    x[300:600] = x[300]  # a third of the rows are one vector
    x[0] *= 3
    data = [(i, v.tolist(), "own", "own") for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [float("inf")] + [1.0] * 15), (1080, [1.0] * 3)]
    odd += [(1100, [None] + [1.0] * 15), (None, [1.0] * 16)]
    got = ann.neighbours(vectors(spark, data + [(*o, "own", "own") for o in odd]), "id % 20 = 0").collect()
    assert {r.query_id for r in got} == set(range(0, 900, 20))
    hits = 0
    wide = x.astype(float)
    for q in range(0, 900, 20):
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        scores = (wide * wide[q]).sum(axis=1)
        assert [m[0] for m in mine] == list(range(1, 21)) and all(m[2] == scores[m[1]] for m in mine)
        assert [m[1:] for m in mine] == sorted((m[1:] for m in mine), key=lambda m: (-m[1], m[0]))
        scores[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(900), -scores))[:20]) & {m[1] for m in mine})
    assert hits >= 0.9 * 20 * 45


def test_few_vectors(spark):
    data = [(0, [1.0, 0.0], "", ""), (20, [0.0, 2.0], "", ""), (21, [1.0, 1.0], "", ""), (21, [1.0, 1.0], "", "")]
    got = [tuple(r) for r in ann.neighbours(vectors(spark, data), "id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 21, 1.0), (0, 2, 20, 0.0), (20, 1, 21, 2.0), (20, 2, 0, 0.0)]
    assert ann.neighbours(vectors(spark, []), "id % 20 = 0").collect() == []
    assert ann.neighbours(vectors(spark, [(20, [1.0], "", "")]), "id % 20 = 0").collect() == []


@pytest.mark.parametrize("alike", [True, False])
def test_neighbours_of_repeated_ids(spark, alike):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(61, 8))
    data = [(i, x[i].tolist(), "", "") for i in range(61)] * 2
    # One id, hundreds of times, nearer to the query than all others.
    data += [(61, (x[0] * (3 if alike else 3 + 0.01 * k)).tolist(), "", "") for k in range(400)]
    got = sorted(ann.neighbours(vectors(spark, data), "id = 0").collect(), key=lambda r: r["rank"])
    scores = x @ x[0]
    best = [61] + [int(i) for i in np.argsort(-scores) if i != 0][:19]
    assert [r["rank"] for r in got] == list(range(1, 21)) and len({r.vec_id for r in got}) == 20
    assert got[0].vec_id == 61 and got[0].score == pytest.approx(scores[0] * (3 if alike else 3 + 0.01 * 399))
    assert len({r.vec_id for r in got} & set(best)) >= 15


def test_lists_count_each_id_once(spark):
    rng = np.random.default_rng(10)
    near = (np.array([9.0, 0.0, 0.0]) + rng.normal(size=(1000, 3)) / 100).tolist()
    data = [(1, v, "", "") for v in near] + [(i, [-9.0 + i / 100, 1.0, i / 50], "", "") for i in range(20, 60)]
    data += [(0, [9.0, 0.0, 0.0], "", "")]
    got = ann.neighbours(vectors(spark, data), "id = 0").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 21))
