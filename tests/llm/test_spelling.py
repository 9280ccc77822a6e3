"""Spelling variants against a plain reading of the contract, and the index against all edits."""

import random
import re
import zlib
from collections import Counter

import pytest
from fixtures import corpus, row, rows, sentence

from loomwright.llm import spelling


def edits(words):
    """All ordered pairs of ``words`` that are one edit apart, by trying every edit."""
    known, letters, out = set(words), set().union(*words), set()
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in known:
                out |= {(w, shorter), (shorter, w)}
            for c in letters - {w[i]}:
                if (other := w[:i] + c + w[i + 1 :]) in known:
                    out.add((w, other))
    return out


def brute(data, least_count=5):
    counts = Counter()
    for r in data:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_count}
    near = {w: [] for w in words}
    for a, b in edits(words) if words else ():
        near[a].append(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def spelled(seed=5):
    """Documents full of words with variants of variants, of very different frequency."""
    rng = random.Random(seed)
    base = ["stonewall", "Übergröße", "anticonstitution", "aaaaaaa", "river" * 40, "naïveté", "×÷÷×××"]
    data = rows()[:14]
    for i in range(60):
        words = []
        for _ in range(200):
            w = rng.choice(base[: rng.randint(1, len(base))])
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "", w[at] * 2, "e", "é"]) + w[at + 1 :]
            words.append(w)
        data.append(row(1000 + i if i % 9 else None, rng.choice([" ", "_", "1", "ー"]).join(words)))
    return data


@pytest.mark.parametrize("least_count", [2, 5])
def test_variants(spark, least_count):
    got = [tuple(r) for r in spelling.variants(corpus(spark, spelled()), least_count).collect()]
    want = brute(spelled(), least_count)
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r[1] is not None for r in want) > 20


def test_index_finds_every_edit_once():
    rng = random.Random(1)
    for _ in range(40):
        letters = "abcdé"[: rng.choice([1, 2, 3, 5])]
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(rng.randint(1, 250))}
        words = sorted(words | {"aaab" * 200, "aaab" * 199 + "aab"}, key=lambda w: rng.random())
        a, b, deleted = spelling.near_pairs(words, words, words)
        got = [*zip(a, b), *((y, x) for x, y, d in zip(a, b, deleted) if d)]
        assert len(got) == len(set(got)) and set(got) == edits(words)


def test_large_halves_are_dealt_over_shares(spark):
    rng = random.Random(2)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(400)}
    words |= {"".join(rng.choice("abc") for _ in range(6)) + "suffix" for _ in range(400)}
    table = spark.createDataFrame([(w, len(w) + i) for i, w in enumerate(sorted(words))], "word string, n long")
    counts = {r.word: r.n for r in table.collect()}
    want = {(a, b, counts[b]) for a, b in edits(words)}
    for share, share_words in ((20, 100), (20, 10**6), (10**6, 50)):
        got = [tuple(r) for r in spelling.near_words(table, share, share_words).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_long_run_of_letters_and_a_long_text(spark):
    rng = random.Random(3)
    run = "".join(rng.choice("abcdefgh") for _ in range(3_000))
    data = [row(i, run if i % 2 else run[:-1]) for i in range(12)] + [row(20, sentence(rng, 50_000))]
    got = spelling.variants(corpus(spark, data)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, brute(data))) and {r.word: r.n_near for r in got}[run] == 1


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(f"w{i}", "w9") for i in range(9)}


def test_empty(spark):
    assert spelling.variants(corpus(spark, [])).collect() == []
    assert spelling.variants(corpus(spark, [row(1, None), row(2, "too rare a word")])).collect() == []
