"""Mixing and sharding against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import corpus, row, rows

from loomwright.llm import mixing, sharding
from loomwright.llm.common import rows_before, slice_bits


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def source_order(source):
    return source is None, (source or "").encode()


def brute_targets(sizes):
    names = sorted(sizes, key=source_order)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return share | fixed
        fixed |= {s: 3.0 * sizes[s] for s in above}


def test_mix(spark):
    data = rows()
    sizes = defaultdict(int)
    for r in data:
        sizes[r[3]] += size(r[1])
    targets = brute_targets(sizes)
    got = mixing.mix(corpus(spark)).select("doc_id", "text", "source", "size", "source_size", "target", "taken").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in data)
    taken = defaultdict(int)
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(corpus(spark)).select(*got[0].__fields__).collect()))


def test_mixture_has_the_words_it_takes(spark):
    df = corpus(spark)
    got = mixing.mixture(df)
    assert got.columns == df.columns
    counts = Counter()
    for r in got.collect():
        counts[r.source] += size(r.text)
        assert r.size == "own"
    wanted = Counter()
    for r in mixing.mix(df).collect():
        wanted[r.source] += r.taken
    assert counts == +wanted


def test_words_are_counted_in_any_text(spark):
    texts = [None, "", " ", "a", " a", "a ", "\ta\x0b\x0cb\r\n c ", " a b", "x" * 100_000, "a " * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(mixing.word_count(df["text"])).collect()] == [size(t) for t in texts]


def brute_shards(data, n):
    per = defaultdict(list)
    for r in data:
        raw = (r[1] or "").encode()
        key = hashlib.md5(f"{sharding.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        per[r[3]].append((key, r[0] is not None, r[0] or 0, len(raw) + 8, zlib.crc32(raw)))
    placed = sorted(((2 * i + 1) / (2 * len(p)), *x) for p in per.values() for i, x in enumerate(sorted(p)))
    out, slots = Counter(), Counter()
    for i, (_, _, known, d, s, c) in enumerate(placed):
        shard = i * n // len(placed)
        out[d if known else None, s, c, "rows", shard, slots[shard], None] += 1
        slots[shard] += 1
    return out


@pytest.mark.parametrize("n", [1, 5, 24, 100])
def test_shards(spark, n):
    got = Counter(map(tuple, sharding.shards(corpus(spark), n).drop("source").collect()))
    assert got == brute_shards(rows(), n)
    counts = Counter(k[4] for k in got.elements())
    assert max(counts.values()) - min(counts.get(i, 0) for i in range(n)) <= 1


def test_every_shard_has_the_mixture(spark):
    data = [row(i, "x", source="big" if i % 3 else f"s{i % 7}") for i in range(2100)]
    per = defaultdict(Counter)
    for r in sharding.shards(corpus(spark, data), 7).collect():
        per[r.shard][r.source] += 1
    whole = Counter(r[3] for r in data)
    # Before any fraction each source is short or ahead by half a row at most, and both ends of a shard are cut to whole rows.
    most = {s: 2 * (n / 2100 * len(whole) / 2 + 1) for s, n in whole.items()}
    assert all(abs(c[s] - whole[s] / 7) <= most[s] for c in per.values() for s in whole)


def test_empty_tables(spark):
    assert mixing.mix(corpus(spark, [])).collect() == [] and mixing.mixture(corpus(spark, [])).collect() == []
    assert sharding.shards(corpus(spark, [])).collect() == []


def test_rows_before(spark):
    data = [(g, i % 5, i) for i in range(60) for g in "ab"]
    got = rows_before(spark.createDataFrame(data, "g string, s long, v long"), ["g"], "s", ["v"], "at").collect()
    order = {g: sorted((s, v) for h, s, v in data if h == g) for g in "ab"}
    assert all(order[r.g].index((r.s, r.v)) == r["at"] for r in got)
    assert [slice_bits(n, 100) for n in (0, 1, 100, 101, 10_000)] == [0, 0, 1, 1, 8] or slice_bits(10_000, 100) >= 6
