"""Quality of texts by pairwise ranking.

Labelled texts are described by a few numbers each (``FEATURES``). Preference pairs set a text with label 1 against one with
label 0; a Bradley-Terry model says that the first wins with probability sigmoid(w . (x1 - x0)), and w is learned by the logistic loss on
these differences. A text's raw score is w . x. The limit is a quantile of the raw scores of the labelled texts: as many of them lie below it as
have label 0. Scores are mapped to 0..1 so that this limit becomes ``THRESHOLD``.

The model is fitted on the features of a sample of labelled rows that is bounded by ``SAMPLE_ROWS`` per label in the mean (drawn by the hash
of the id), and on ``PARTNERS`` pairs for each of them, so not on all pairs. The score sees nothing but the text, and all of it.

Defined cases: null and empty texts have the features of an empty text and are scored like others; labels that are null are not
learned from; without labels of both kinds every score is 0.5; a document with several labels counts with each; repeated rows are scored
each; other columns are kept, those named like results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import crc_of_id, keep, shuffle_key, text_blocks

SAMPLE_ROWS = 3_000
PARTNERS = 8
RIDGE = 1e-3
STEPS = 200
THRESHOLD = 0.3  # fixed by the contract
SEED = 9

FEATURES = (
    "log_words", "mean_word", "short_words", "upper_words", "odd_ends", "distinct_words", "top_word", "distinct_lines", "letters",
    "digits", "blanks", "sentence_ends", "commas", "bars", "loud", "marks", "lower_starts",
)
_LETTERS = bytes(b for b in range(256) if chr(b).isalpha() and b < 128 or b >= 128)
_MARKS = b"#$%&*@^~<>{}[]\\=+_"


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from. Fixed by the contract."""
    return crc_of_id(doc_id) % 5 == 0


def describe(text: str | None) -> tuple[float, ...]:
    """The values of ``FEATURES`` for a text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw))
    without = lambda chars: size - len(raw.translate(None, chars)) if raw else 0
    counts = Counter(words)
    return (
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n,
        sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:") / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(lines)) / max(1, len(lines)),
        without(_LETTERS) / size,
        without(b"0123456789") / size,
        without(b" \t\n\r\x0b\x0c") / size,
        text.count(". ") / n,
        text.count(",") / n,
        text.count("|") / n,
        text.count("!") / n,
        without(_MARKS) / size,
        sum(x[:1].islower() for x in lines) / max(1, len(lines)),
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    limit: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(features), 0.5)
        raw = np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.limit + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights that make ``better[i]`` win against ``worse[i]``: Newton steps on the mean logistic loss of the differences."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        lose = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        slope = -(d * lose[:, None]).mean(axis=0) + ridge * w
        curve = (d * (lose * (1 - lose))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_rows(features: np.ndarray, labels: np.ndarray, share_bad: float | None = None) -> Model:
    """The model of labelled rows; ``share_bad`` is the share of label 0 among all labelled texts, if the rows are not a plain sample."""
    width = features.shape[1]
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale == 0] = 1
    x = np.clip((features - mean) / scale, -8, 8)
    # Each text meets PARTNERS texts of the other label, which are taken in turn.
    pairs = max(len(good), len(bad)) * PARTNERS
    turn = np.arange(pairs)
    draw = np.random.default_rng(SEED)
    w = bradley_terry(x[draw.permutation(good)[turn % len(good)]], x[draw.permutation(bad)[turn // PARTNERS % len(bad)]])
    raw = x @ w
    share = len(bad) / len(labels) if share_bad is None else share_bad
    # The quantile of the scores, each label weighed by its true share.
    weight = np.where(labels == 1, (1 - share) / len(good), share / len(bad))
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    at = min(int(np.searchsorted(below, share)), len(order) - 2)
    return Model(mean, scale, w, float((raw[order[at]] + raw[order[at + 1]]) / 2))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the array ``features`` of the whole text."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([describe(t) for t in batch])

    return docs.withColumn("features", run(text))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of ``docs`` (``doc_id, text``) with ``labels`` (``doc_id, quality``); all of them may be learned from."""
    known = labels.where("quality in (0, 1)").select("doc_id", "quality")
    totals = keep(known.groupBy("quality").agg(F.count(F.lit(1)).alias("rows")))
    place = F.conv(F.substring(shuffle_key(SEED, F.col("doc_id")), 1, 8), 16, 10).cast("double") / 2**32
    drawn = known.join(totals, "quality").where(place * F.col("rows") < sample_rows).select("doc_id", "quality")
    # A few thousand short rows come to the driver.
    sampled = features(docs.select("doc_id", "text").join(keep(drawn), "doc_id")).select("doc_id", "quality", "features").toPandas()
    sampled = sampled.sort_values(["doc_id", "quality"])
    counts = {r["quality"]: r["rows"] for r in totals.collect()}
    share = counts.get(0, 0) / max(1, sum(counts.values()))
    rows = np.array(sampled["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_rows(rows, sampled["quality"].to_numpy(dtype=int), share)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (higher: better) and ``predicted`` (1 from ``THRESHOLD`` on)."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = list(batch)
            found = [model.scores(np.array([describe(t) for t in texts[b]])) for b in text_blocks(texts)]
            yield pd.Series(np.concatenate(found) if found else [], dtype=float)

    return docs.withColumn("score", run(text)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``; learned from the rows that are not held out."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    judged = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return judged.select("doc_id", "held_out", "score", "predicted")
