"""How far the sources of a language differ in their words, and by which words.

``term_cells`` counts the terms of every text per (lang, source), combined per task before anything moves, and keeps those that stand in at least
``LEAST_DOCS`` documents of their language. Every group of a language, and the language itself, gives each kept term the whole-number share
``p = 1 + floor(10^9 * (count + 5) / (N + 5 * V))``.

``pairs`` compares all sources of a language without pairing their rows. Of a block of terms it builds the one-hot matrix X with one column per
(source, count level), level 0 included; the product of its transpose with X holds, for every two sources at once, the joint table of
their levels: how many terms of the block have count c here and count d there. A joint table is priced by ``abs(p(c) - p(d))``. The products
are blocked both ways: ``TERMS`` terms and ``SOURCES`` sources on either side make a task, ``ROWS`` terms at a time one product, whose entries
stay below 2^24 and so are exact in single precision. Prices and sums are whole numbers. Terms that none of a task's sources has add nothing there;
they are counted, and priced at the end by what both sides give to level 0.

``distinctive`` ranks the terms that a group has more of than its language; only each task's first ranks move.

Defined cases: null text, lang and source count as empty; a source without kept terms, or without any term, takes part in all pairs;
a language without kept terms gives value 0; repeated rows are documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import keep, text_blocks, text_or_empty

LEAST_DOCS = 30
TOP = 50
# Of a task: terms, sources on either side, terms in one product.
TERMS = 4096
SOURCES = 64
ROWS = 256
# Counts that a task holds before it passes them on.
MOST_COUNTS = 400_000

SCALE = 1_000_000_000
ADDED = 5
# Bytes of UTF-8 that are part of a term, A-Z made small; all others separate. Fixed by the contract.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occurrences: dict[tuple, Counter] = defaultdict(Counter)
    documents: dict[tuple, Counter] = defaultdict(Counter)

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            docs, size = documents[lang, source], len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array(counts.keys(), pa.binary()).cast(pa.string()),
                    pa.array(counts.values(), pa.int64()),
                    pa.array(map(docs.__getitem__, counts), pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        occurrences.clear()
        documents.clear()

    for batch in batches:
        langs, sources, texts = (c.to_pylist() for c in batch.columns)
        for block in text_blocks(texts):
            for lang, source, text in zip(langs[block], sources[block], texts[block]):
                terms = text.encode().translate(_LETTERS).split()
                occurrences[lang, source].update(terms)
                documents[lang, source].update(set(terms))
            if sum(map(len, occurrences.values())) > MOST_COUNTS:
                yield from passed_on()
    yield from passed_on()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty("text").alias("text"))


def term_cells(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, source, n, lang_n``: occurrences of each kept term per source that has it, and in the whole language.

    One shuffle by (lang, term) serves the sums per source and those per language.
    """
    counted = _named(docs).mapInArrow(_count, _COUNTS).repartition("lang", "term")
    cells = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = cells.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
    return whole.where(F.col("lang_docs") >= least_docs).select("lang", "term", "source", "n", "lang_n")


def group_totals(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per (lang, source) of ``docs``: ``total`` (N + 5V), ``lang_total``, ``v`` and the place ``nth`` of the source in its language."""
    groups = _named(docs).select("lang", "source").distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("sum_n"))
    sizes = cells.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_sum"))
    v = F.coalesce("v", F.lit(0)).cast("long")
    return (
        groups.join(sums, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select(
            "lang",
            "source",
            (F.coalesce("sum_n", F.lit(0)) + ADDED * v).alias("total"),
            (F.coalesce("lang_sum", F.lit(0)) + ADDED * v).alias("lang_total"),
            v.alias("v"),
            (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("nth"),
        )
    )


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / total) in whole numbers; decimals, since the product can pass 64 bits."""
    return F.lit(1) + F.call_function("div", (count + ADDED).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def _shares(counts: np.ndarray, total: int) -> list[int]:
    return [1 + SCALE * (c + ADDED) // total for c in counts.tolist()]


def _one_hot(counts: np.ndarray, totals: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``counts`` (terms x sources): the indicator columns of all (source, level), the share of each, and where each source's begin."""
    columns, prices, starts = [], [], []
    for source, total in zip(counts.T, totals):
        levels, at = np.unique(source, return_inverse=True)
        starts.append(len(prices))
        prices += _shares(levels, total)
        columns.append(at + starts[-1])
    hot = np.zeros((len(counts), len(prices)), dtype=np.float32)
    for at in columns:
        hot[np.arange(len(counts)), at] = 1
    return hot, np.array(prices, dtype=np.int64), np.array(starts)


def priced(left: np.ndarray, right: np.ndarray, left_totals: list[int], right_totals: list[int], rows: int = ROWS) -> np.ndarray:
    """Summed distance of every source on the left to every one on the right, from count matrices of the same terms."""
    out = np.zeros((len(left_totals), len(right_totals)), dtype=np.int64)
    for at in range(0, len(left), rows):
        x, x_price, x_starts = _one_hot(left[at : at + rows], left_totals)
        y, y_price, y_starts = _one_hot(right[at : at + rows], right_totals)
        joint = (x.T @ y).astype(np.int64)
        joint *= np.abs(x_price[:, None] - y_price[None, :])
        out += np.add.reduceat(np.add.reduceat(joint, x_starts, axis=0), y_starts, axis=1)
    return out


_PRICED = "lang string, a string, b string, value long, seen long, rest long"


def _price_block(width: int, key: tuple, cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    lang, _, low, high = key
    sources = sources.sort_values("nth")
    sides = [sources[sources["nth"] // width == b] for b in (low, high)]
    totals = [list(map(int, s["total"])) for s in sides]
    codes, terms = pd.factorize(cells["term"])
    matrices = []
    for b, side in zip((low, high), sides):
        here = (cells["nth"] // width == b).to_numpy()
        m = np.zeros((len(terms), len(side)), dtype=np.int64)
        m[codes[here], cells["nth"].to_numpy()[here] - b * width] = cells["n"].to_numpy()[here]
        matrices.append(m)
    empty = int(sources["v"].iloc[0]) == 0
    values = np.zeros((len(sides[0]), len(sides[1])), dtype=np.int64) if empty else priced(*matrices, *totals)
    none = [np.zeros(len(t), dtype=np.int64) if empty else np.array([_shares(np.zeros(1, int), x)[0] for x in t], dtype=np.int64) for t in totals]
    rest = np.abs(none[0][:, None] - none[1][None, :])
    a, b = np.meshgrid(sides[0]["source"].to_numpy(), sides[1]["source"].to_numpy(), indexing="ij")
    one = np.triu(np.ones(values.shape, dtype=bool), 1) if low == high else np.ones(values.shape, dtype=bool)
    return pd.DataFrame({"lang": lang, "a": a[one], "b": b[one], "value": values[one], "seen": len(terms), "rest": rest[one]})


def pairs(cells: DataFrame, groups: DataFrame, width: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """``lang, source, item, value``: the distance of each source to each other source of its language."""
    blocks = groups.groupBy("lang").agg(
        (F.max("nth") / width).cast("int").alias("last_block"), F.max((F.col("v") / terms).cast("int")).alias("last_terms")
    )
    own = (F.col("nth") / width).cast("int")

    def met(rows: DataFrame) -> DataFrame:
        """Each row once for every block of sources that its own block is compared with, itself included."""
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "last_block")))
        return other.withColumns({"low": F.least(own, "other"), "high": F.greatest(own, "other")})

    sources = groups.select("lang", "source", "nth", "total", "v").join(blocks, "lang")
    spread = F.pmod(F.xxhash64("term"), F.col("last_terms") + 1).cast("int")
    left = met(cells.join(sources, ["lang", "source"]).withColumn("part", spread)).select("lang", "part", "low", "high", "term", "nth", "n")
    right = met(sources.withColumn("part", F.explode(F.sequence(F.lit(0), "last_terms"))))
    key = ["lang", "part", "low", "high"]
    names = [*key, "source", "nth", "total", "v"]
    right = right.select(*names).toDF(*names)  # columns of its own, since both sides stem from the same table
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda k, x, y: _price_block(width, k, x, y), _PRICED)
    sums = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("rest").alias("rest"))
    sizes = groups.groupBy("lang").agg(F.max("v").alias("v"))
    value = (F.col("value") + (F.col("v") - F.col("seen")) * F.col("rest")).alias("value")
    once = sums.join(sizes, "lang").select("lang", "a", "b", value)
    return once.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        once.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    )


def distinctive(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the terms of each source whose share is above their share in the language."""
    here = cells.join(groups, ["lang", "source"])
    value = share(F.col("n"), F.col("total")) - share(F.col("lang_n"), F.col("lang_total"))
    return here.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources, and the first ``top`` terms of each source."""
    cells = keep(term_cells(docs, least_docs))
    groups = keep(group_totals(docs, cells))
    terms = _ranked(distinctive(cells, groups), "term").where(F.col("rank") <= top)
    return _ranked(pairs(cells, groups), "pair").unionByName(terms)
