"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from fixtures import corpus, row, rows

from loomwright.llm import exact_dedup, minhash
from loomwright.llm.common import linked_groups


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def late(doc_id):
    return doc_id is None, doc_id or 0


def brute_copies(data):
    groups = {}
    for r in data:
        groups.setdefault(normal(r[1]), []).append(r[0])
    out = Counter()
    for text, ids in groups.items():
        ids = sorted(ids, key=late)
        for i, d in enumerate(ids):
            out[d, ids[0], len(ids), i == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_copies(spark):
    for heavy in (2, 4, 256):
        assert Counter(map(tuple, exact_dedup.copies(corpus(spark), heavy).collect())) == brute_copies(rows())


def test_frequent_finds_every_heavy_digest(spark):
    digests = corpus(spark).select("doc_id", exact_dedup.digest("text").alias("text_sha256"))
    found = exact_dedup.frequent(digests, 8).collect()
    sizes = Counter(normal(r[1]) for r in rows())
    assert len(found) == sum(n * 8 > len(rows()) for n in sizes.values()) == 1 and found[0].group_size == 13


def test_deduplicate_keeps_rows_and_columns(spark):
    df = corpus(spark)
    got = exact_dedup.deduplicate(df, 8)
    assert got.columns == df.columns
    want = {}
    for r in sorted(rows(), key=lambda r: late(r[0])):
        want.setdefault(normal(r[1]), r)
    key = lambda r: (r[0], r[1])
    assert Counter(key(r) for r in got.collect()) == Counter(map(key, want.values()))


def test_empty_tables(spark):
    empty = corpus(spark, [])
    assert exact_dedup.copies(empty).collect() == [] and exact_dedup.deduplicate(empty).collect() == []
    assert minhash.near_duplicates(empty).collect() == [] and minhash.deduplicate(empty).collect() == []


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    size = min(4, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_near(data):
    sets = [shingles(r[1]) for r in data]
    at = list(range(len(data)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                at[find(i)] = find(j)
    out = Counter()
    for i, r in enumerate(data):
        component = min((data[j][0] for j in range(len(data)) if find(j) == find(i)), key=late)
        out[r[0], len(sets[i]), component, r[0] == component] += 1
    return out


def test_near_duplicates(spark):
    got = minhash.near_duplicates(corpus(spark)).drop("text_md5")
    assert Counter(map(tuple, got.collect())) == brute_near(rows())


@pytest.mark.parametrize("few", [1, 1000])
def test_links_between_groups_of_one_leader(spark, monkeypatch, few):
    """Many close variants of one text: neighbours are linked, distant ones are not, and no link may be lost."""
    monkeypatch.setattr(minhash, "FEW", few)
    words = [f"w{i}" for i in range(60)]
    data = [row(900 + i, " ".join(words[:30]) + f" own{i} " + " ".join(f"p{i}-{k // 2}" for k in range(40))) for i in range(20)]
    for i in range(40):
        v = list(words)
        for k in range(i // 2 % 5 + 1):
            v[(i * 7 + 11 * k) % 60] = f"x{i}-{k}"
        data.append(row(i, " ".join(v)))
    got = minhash.near_duplicates(corpus(spark, data)).drop("text_md5")
    assert Counter(map(tuple, got.collect())) == brute_near(data)


def test_near_deduplicate_keeps_one_of_each_group(spark):
    df = corpus(spark)
    got = minhash.deduplicate(df)
    assert got.columns == df.columns
    kept = {(r[0], r[1]) for r in got.collect()}
    want = brute_near(rows())
    assert {d for d, _ in kept} == {d for d, _, _, k in want if k}


def test_signatures_estimate_similarity():
    x = [f"a{i}" for i in range(400)]
    y = x[:300] + [f"b{i}" for i in range(100)]
    a, b = (minhash.signature(minhash.shingle_set(" ".join(t))) for t in (x, y))
    sets = [shingles(" ".join(t)) for t in (x, y)]
    assert abs((a == b).mean() - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.12


def test_linked_groups(spark):
    chain = [(i, i + 1) for i in range(0, 50)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (200, 201), (300, 300)]
    got = dict(map(tuple, linked_groups(spark.createDataFrame(chain, "a long, b long")).collect()))
    want = {i: 0 for i in range(1, 51)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert {k: v for k, v in got.items() if k != v} == want
    assert linked_groups(spark.createDataFrame([], "a long, b long")).collect() == []


def test_linked_groups_of_random_links(spark):
    draw = random.Random(3)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)]
    links += [(1000, 1000 + i) for i in range(200)] + [(2000 + i, 2000 + i // 2) for i in range(1, 100)]
    smallest = {n: n for pair in links for n in pair}
    for _ in smallest:
        before = dict(smallest)
        for a, b in links:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
        if smallest == before:
            break
    got = linked_groups(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({g["node"] for g in got})
    assert {g["node"]: g["group"] for g in got} == {n: least for n, least in smallest.items() if n != least}
