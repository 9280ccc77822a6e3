"""Source divergence against a plain reading of its contract."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SCHEMA, corpus, rows
from pyspark.sql import functions as F

from loomwright.llm import divergence


def brute(data, least_docs, top):
    """``lang, source, part, item, value, rank`` of rows (doc_id, text, lang, source, ...)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in data:
        text, lang, source = (x or "" for x in r[1:4])
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for rank, (value, item) in enumerate(found[: top if part == "term" else None], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("least_docs", [2, 5, 10_000])
def test_audit(spark, least_docs):
    got = divergence.audit(corpus(spark), least_docs, 7).collect()
    want = brute(rows(), least_docs, 7)
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_many_blocks(spark):
    data = [(i, f"{r[1] or ''} w{i % 5} Été", "en", f"s{i % 7}", *r[4:]) for i, r in enumerate(rows()) if r[0] != 152]
    docs = corpus(spark, data)
    cells = divergence.term_cells(docs, 2).cache()
    groups = divergence.group_totals(docs, cells)
    got = {tuple(r) for r in divergence.pairs(cells, groups, width=2, terms=5).collect()}
    assert got == {(x[0], x[1], x[3], x[4]) for x in brute(data, 2, 7) if x[2] == "pair"} and len(got) == 42


def test_product_is_exact_for_large_counts():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 10 ** rng.integers(1, 12, (40, 3))) for _ in range(2))
    totals = [[int(x) + 200 for x in m.sum(axis=0)] for m in (a, b)]
    got = divergence.priced(a, b, *totals, rows=7)
    share = lambda c, t: 1 + 10**9 * (int(c) + 5) // t
    want = [[sum(abs(share(x, s) - share(y, t)) for x, y in zip(a[:, i], b[:, j])) for j, t in enumerate(totals[1])] for i, s in enumerate(totals[0])]
    assert got.tolist() == want


def test_shares_of_counts_beyond_64_bits(spark):
    df = spark.sql("select 5000000000000 as n, 5000000000007 as total")
    assert df.select(divergence.share(F.col("n"), F.col("total"))).first()[0] == 1 + 10**9 * (5000000000005) // 5000000000007


def test_cells_cross_tasks(spark):
    wide = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    one = {tuple(r) for r in divergence.term_cells(wide, 2).collect()}
    assert one == {tuple(r) for r in divergence.term_cells(corpus(spark).coalesce(1), 2).collect()} and one


def test_empty(spark):
    assert divergence.audit(corpus(spark, [])).collect() == []
    alone = divergence.audit(corpus(spark, [rows()[0]])).collect()
    assert alone == []
