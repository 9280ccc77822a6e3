"""Language of texts, word first.

A word that is known in any language scores with its log frequency in each of them. An unseen word backs off to its character
n-grams, the longest length first: as soon as some n-grams of a length are known, their mean log frequency is its score; a word without
known letters says nothing. The sum over all words of the text and the languages' log shares gives the posterior, whose largest value is
the prediction and its score (ties: the language first by code point).

The model is fitted on a sample of labelled texts that is bounded by ``SAMPLE_CHARS`` characters per language in the mean (drawn by the hash of
id and text) and holds every word and every n-gram that stands there, counted in each language by Spark: the sample alone bounds the model.
It reaches the tasks as sorted hashes beside one matrix of log frequencies. The prediction sees nothing but the text, and all of it.

Defined cases: ``und`` with score 0 if a text is null, empty or has no letter, or if nothing was learned; texts or languages that are
null are not learned from; repeated rows count as often as they are there; other columns are kept, those named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwright.llm.common import crc_of_id, keep, map_in_arrow, text_blocks

SAMPLE_CHARS = 3_000_000
LONGEST_GRAM = 5
SMOOTHING = 0.5
UNKNOWN = "und"
# Words that a task remembers.
CACHE_WORDS = 60_000

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from. Fixed by the contract."""
    return crc_of_id(doc_id) % 4 == 2


def gram_texts(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def key_of(text: str) -> int:
    """Spark's ``xxhash64`` of a text, without sign."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)


class Table(Mapping):
    """Log frequencies of texts per language: sorted hashes, and a matrix with a row for each.

    It is a mapping from texts too; the texts themselves are asked for when it is walked through, and stay on the driver.
    """

    def __init__(self, keys: np.ndarray, logs: np.ndarray, texts: Callable[[], list[str]] | None = None):
        order = np.argsort(keys, kind="stable")
        self.keys, self.logs, self.texts = keys[order], logs[order], texts

    @classmethod
    def counted(cls, keys: np.ndarray, counts: np.ndarray, texts: Callable[[], list[str]] | None = None) -> Table:
        """``counts`` are those of each text in each language. Smoothed by ``SMOOTHING`` more occurrences of every text."""
        sums = np.maximum(counts.sum(axis=0), 1)
        logs = (np.log(counts + SMOOTHING) - np.log(sums + SMOOTHING * len(keys))).astype(np.float32)
        return cls(keys, logs, texts)

    @classmethod
    def of(cls, logs: Mapping[str, np.ndarray], languages: int) -> Table:
        if isinstance(logs, Table):
            return logs
        keys = np.array([key_of(t) for t in logs], dtype=np.uint64)
        return cls(keys, np.array([*logs.values()], dtype=np.float32).reshape(len(keys), languages), partial(list, logs))

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "logs": self.logs, "texts": None}

    def __len__(self) -> int:
        return len(self.keys)

    def __iter__(self) -> Iterator[str]:
        return iter(self.texts())

    def __getitem__(self, text: str) -> np.ndarray:
        at, known = self.rows(np.array([key_of(text)], dtype=np.uint64))
        if not known[0]:
            raise KeyError(text)
        return self.logs[at[0]]

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of these keys, and whether they are known."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


@dataclass
class Model:
    """Log frequencies per language of words and of n-grams by length, and the log shares of the languages."""

    languages: list[str]
    words: Mapping[str, np.ndarray]
    grams: dict[int, Mapping[str, np.ndarray]]
    prior: np.ndarray
    _rows: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.words = Table.of(self.words, len(self.languages))
        self.grams = {n: Table.of(self.grams.get(n, {}), len(self.languages)) for n in range(1, LONGEST_GRAM + 1)}

    def of_word(self, word: str) -> np.ndarray:
        return self.of_words([word])[0]

    def of_words(self, words: list[str]) -> np.ndarray:
        """The score of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        keys = np.fromiter(map(key_of, words), dtype=np.uint64, count=len(words))
        at, known = self.words.rows(keys)
        out[known] = self.words.logs[at[known]]
        left = np.flatnonzero(~known)
        for n in range(LONGEST_GRAM, 0, -1):
            grams = [gram_texts(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), np.fromiter(map(len, grams), dtype=np.int64, count=len(grams)))
            keys = np.fromiter((key_of(g) for each in grams for g in each), dtype=np.uint64, count=len(owner))
            at, known = self.grams[n].rows(keys)
            owner, logs = owner[known], self.grams[n].logs[at[known]].astype(np.float64)
            found = np.bincount(owner, minlength=len(left))
            hit = found > 0
            for k in range(len(self.languages)):
                out[left[hit], k] = np.bincount(owner, logs[:, k], len(left))[hit] / found[hit]
            left = left[~hit]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [WORD.findall((t or "").lower()) for t in texts]
        lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        if not lengths.any() or not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = self._rows
        new = list({w for words in split for w in words}.difference(rows))
        if len(rows) + len(new) > CACHE_WORDS or self._scores is None:
            rows.clear()
            new = list({w for words in split for w in words})
            self._scores = np.zeros((0, len(self.languages)), dtype=np.float64)
        rows.update(zip(new, range(len(rows), len(rows) + len(new))))
        self._scores = np.concatenate([self._scores, self.of_words(new)])
        flat = np.fromiter((rows[w] for words in split for w in words), dtype=np.int64, count=int(lengths.sum()))
        has = lengths > 0
        starts = (np.cumsum(lengths) - lengths)[has]
        total = np.add.reduceat(self._scores[flat], starts, axis=0) + self.prior
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names, values = iter(best.tolist()), iter(share.tolist())
        pairs = [(self.languages[next(names)], next(values)) if h else (UNKNOWN, 0.0) for h in has]
        return [p[0] for p in pairs], [p[1] for p in pairs]


def sampled(labelled: DataFrame, per_language: DataFrame, sample_chars: int) -> DataFrame:
    """The rows of ``labelled`` that are learned from: of each language so large a share that ``sample_chars`` characters are to be expected."""
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).cast("double") / (1 << 30)
    return labelled.join(per_language, "lang").where(place * F.col("chars") < sample_chars)


def fit(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """The model of ``docs`` (``doc_id, text, lang``), all of which may be learned from."""
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    per_language = keep(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars")))
    known = per_language.orderBy("lang").collect()
    names = [r.lang for r in known]
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}[\p{L}\p{M}]*)")))
    sample = sampled(labelled, per_language, sample_chars)
    counts = keep(sample.select("lang", words.alias("entry")).groupBy("lang", "entry").agg(F.count(F.lit(1)).alias("n")))
    padded = F.concat(F.lit("_"), "entry", F.lit("_"))
    size = F.col("size")
    cut = F.transform(F.sequence(F.lit(1), F.length(padded) - size + 1), lambda i: F.substring(padded, i, size))
    grams = (
        counts.select("lang", "entry", "n", F.explode(F.sequence(F.lit(1), F.lit(LONGEST_GRAM))).alias("size"))
        .where(F.length(padded) >= size)
        .select("size", F.explode(cut).alias("entry"), "lang", "n")
    )
    each = [F.sum(F.when(F.col("lang") == name, F.col("n")).otherwise(0)).alias(f"n{i}") for i, name in enumerate(names)]
    entries = counts.select(F.lit(0).alias("size"), "entry", "lang", "n").unionByName(grams).groupBy("size", "entry").agg(F.count(F.lit(1)), *each)
    # What comes to the driver is bounded by the sample: a hash and a count per language of each entry.
    model = entries.select("size", F.xxhash64("entry").alias("key"), *[f"n{i}" for i in range(len(names))]).toArrow()
    sizes, keys = model.column("size").to_numpy(), model.column("key").to_numpy().astype(np.int64).view(np.uint64)
    table = np.zeros((len(keys), len(names)))
    for i in range(len(names)):
        table[:, i] = model.column(f"n{i}").to_numpy()
    docs_of = np.array([r.docs for r in known], dtype=float)
    prior = np.log(docs_of / docs_of.sum()) if known else np.zeros(0)

    def of_size(n: int) -> Table:
        def texts() -> list[str]:
            return [r.entry for r in entries.where(F.col("size") == n).select("entry").collect()]

        return Table.counted(keys[sizes == n], table[sizes == n], texts)

    return Model(names, of_size(0), {n: of_size(n) for n in range(1, LONGEST_GRAM + 1)}, prior)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of these names in any case. The model, bounded by its sample,
    travels as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            columns = [batch.column(batch.schema.names.index(f.name)) for f in kept]
            sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            for block in text_blocks(sizes, size_of=int):
                size = block.stop - block.start
                found, scores = shared.value.predict(column.slice(block.start, size).to_pylist())
                results = [pa.array(found, pa.string()), pa.array(scores, pa.float64())]
                own = [c.slice(block.start, size) for c in columns]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*own, *results], arrow)], schema=arrow)

    return map_in_arrow(docs, run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (``doc_id, text, lang``): ``doc_id, held_out, lang_pred, score``; learned from the rows
    that are not held out."""
    fold = held_out(F.col("doc_id"))
    model = fit(docs.where(~fold))
    return predict(docs.select("doc_id", fold.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is recognised: letters, and a score of at least ``least_score``."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    names = docs.columns
    # Own names for the time of the prediction, so that no column of ``docs`` is replaced.
    judged = predict(docs.toDF(*(f"c{i}" for i in range(len(names)))), model, f"c{names.index('text')}")
    rows = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return rows.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
