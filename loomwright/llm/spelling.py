"""Groups of spelling variants: words that differ by one code point, found in a bidirectional FM-index of the vocabulary.

``vocabulary`` counts the words of whole texts, combined per task. ``near_words`` finds all pairs of words with one inserted, deleted or replaced
code point by a search scheme: an error in the right part of a word leaves its left half as it is, one in the left half its right
part. So a word is looked up twice: its left half is matched exactly from the front and extended to the right over the rest with one
error, and its right part is matched exactly from the back and extended to the left. Two words that are found this way share the exact half; the
vocabulary is dealt out by halves (a word lies with every half that a partner can look it up by, three or four at most), and each share
has an index of its own. A half with more than ``SHARE`` words is dealt over several shares, each of which all its lookups visit.

An index keeps its words, delimited, in both directions. Of each direction it keeps the Burrows-Wheeler letters as bit rows with counts, so that the rank
of a letter takes one look and one popcount; a search holds intervals of suffix ranks, and all words of a share go on together, code point by
code point. While no error is spent, words with a common beginning share an interval, whose letters are listed once. A replaced or a deleted
code point is tried by the search, an inserted one is the deleted one of the other word; a deletion inside a run of one code point is
tried at the run's last place only, so every pair is found once.

Defined cases: null text counts as empty, a null id as an empty one; repeated rows count as often as they are there; words of any length;
other columns are ignored; an empty table gives no rows. Ties go to the word that is smaller in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import keep, text_blocks

LEAST_LENGTH = 6
LEAST_COUNT = 5
# How much more frequent a word must be to be the form of another.
TIMES = 5
# Words of one half in one share, and dealt words of one share in the mean.
SHARE = 20_000
SHARE_WORDS = 60_000
# Counts that a task holds before it passes them on.
MOST_COUNTS = 400_000

# One run in so many loses a code point. Fixed by the contract.
_ONE_IN = 199


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
    counts: Counter = Counter()

    def passed_on() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        ids, texts = (c.to_pylist() for c in batch.columns)
        for block in text_blocks(texts):
            for doc_id, text in zip(ids[block], texts[block]):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(run.findall((text or "").encode().lower().decode())).items():
                    mark = zlib.crc32(word.encode(), start)
                    if mark % _ONE_IN == 0:
                        at = mark % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    counts[word] += n
            if len(counts) > MOST_COUNTS:
                yield passed_on()
    yield passed_on()


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of ``docs`` (``doc_id, text``): the words of at least ``LEAST_LENGTH`` code points that occur ``least_count`` times."""
    counted = docs.select("doc_id", "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Direction:
    """The FM-index of delimited words, which are read from their last letter to the first."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sigma: int):
        """``letters`` from 1 to ``sigma - 1``, all words one after the other, each followed by the delimiter 0; the words in ascending order,
        by which equal endings are ranked too."""
        order = self._suffixes(letters, starts, lengths)
        before = letters[order - 1]  # the one before the first word is the last delimiter
        self.size = len(letters)
        words = (self.size >> 6) + 1
        self.bits = np.zeros((sigma, words), dtype=np.uint64)
        at = np.arange(self.size)
        np.bitwise_or.at(self.bits, (before, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        counts = np.bitwise_count(self.bits).astype(np.int32)
        self.counts = np.cumsum(counts, axis=1, dtype=np.int32) - counts
        self.first = np.concatenate([[0], np.cumsum(np.bincount(letters, minlength=sigma))[:-1]])
        self.before = before

    @staticmethod
    def _suffixes(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places in the order of the suffixes that start there and end with their word, equal ones in the order of the words."""
        size = len(letters)
        left = np.repeat(lengths + 1, lengths + 1) - (np.arange(size) - np.repeat(starts, lengths + 1))
        rank, width, longest = letters.astype(np.int64), 1, int(lengths.max()) + 1
        order = np.argsort(rank, kind="stable")
        while width < longest:
            ahead = np.zeros(size, dtype=np.int64)
            more = left > width
            ahead[more] = rank[np.flatnonzero(more) + width]
            key = rank * (size + 1) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(size, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])]) + 1
            rank[letters == 0] = 0
            width *= 2
        return order

    def rank(self, letter: np.ndarray | int, place: np.ndarray) -> np.ndarray:
        """How often ``letter`` stands before the suffixes of ranks below ``place``."""
        word = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[letter, word] + np.bitwise_count(self.bits[letter, word] & mask)

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[letter]
        return first + self.rank(letter, low), first + self.rank(letter, high)

    def letters(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ``(interval, letter)`` that occur before the suffixes of these intervals, delimiters left out."""
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]
        found = np.unique(owner * 256 * 256 + self.before[place])
        found = found[found % (256 * 256) > 0]
        return found // (256 * 256), found % (256 * 256)


class Index:
    """Delimited words in both directions."""

    def __init__(self, words: list[str], alphabet: dict[str, int]):
        self.words, self.alphabet = words, alphabet
        sigma = len(alphabet) + 1
        self.back = [np.argsort(np.array(words, dtype=object), kind="stable"), None]
        mirrored = [w[::-1] for w in words]
        self.back[1] = np.array(sorted(range(len(words)), key=mirrored.__getitem__))
        # Direction 0 reads from the back, over the words as they are; direction 1 from the front, over the mirrored words.
        self.sides = [Direction(*coded([side[i] for i in at], alphabet), sigma) for side, at in zip((words, mirrored), self.back)]


def coded(words: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The delimited letters of ``words``, where each begins, and its length."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = np.fromiter((alphabet.get(c, 0) for c in chain.from_iterable(w + "\0" for w in words)), dtype=np.int64, count=int(lengths.sum()) + len(words))
    return letters, np.cumsum(lengths + 1) - lengths - 1, lengths


def _search(side: Direction, queries: list[str], exact: np.ndarray, alphabet: dict[str, int], last_of_run_ahead: bool):
    """``(query, rank of the word)`` of all words that differ from a query in one replaced or deleted letter after its first ``exact``
    letters, in the order in which this direction reads (``queries`` are given in that order).

    ``last_of_run_ahead`` says which end of a run of equal letters counts as its last place: the one that is read last, or first.
    """
    letters, starts, lengths = coded(queries, alphabet)
    n = len(queries)
    # Searches without and with the error: query, interval. All begin at the delimiters.
    words = int(side.first[1]) if len(side.first) > 1 else side.size
    whole = (np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, words, dtype=np.int64))
    spent = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    answers = []
    for t in range(int(lengths.max()) + 1 if n else 0):
        # The searches with an error that have read their whole query, and now must stand at the beginning of a word.
        q, low, high = spent
        done = lengths[q] == t
        if done.any():
            found = side.rank(0, low[done])
            hit = side.rank(0, high[done]) > found
            answers.append((q[done][hit], found[hit]))
            q, low, high = (x[~done] for x in (q, low, high))
        going = lengths[whole[0]] > t
        wq, wlow, whigh = (x[going] for x in whole)
        letter = letters[starts[wq] + t]
        may = t >= exact[wq]
        fresh = []
        if may.any():
            eq, elow, ehigh, own = wq[may], wlow[may], whigh[may], letter[may]
            # Replaced: every other letter of the interval, listed once for all queries that share it.
            nodes, at = np.unique(elow * (side.size + 1) + ehigh, return_inverse=True)
            nlow, nhigh = nodes // (side.size + 1), nodes % (side.size + 1)
            node, other = side.letters(nlow, nhigh)
            clow, chigh = side.extend(other, nlow[node], nhigh[node])
            first = np.searchsorted(node, np.arange(len(nodes) + 1))
            sizes = (first[1:] - first[:-1])[at]
            mine = np.repeat(np.arange(len(eq)), sizes)
            child = np.arange(len(mine)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[:-1][at][mine]
            differs = other[child] != own[mine]
            fresh.append((eq[mine][differs], clow[child][differs], chigh[child][differs]))
            # Deleted: the same interval, one letter further on.
            place = starts[eq] + t
            if last_of_run_ahead:
                last = letters[place + 1] != own
            else:
                last = (letters[place - 1] != own) if t else np.ones(len(eq), dtype=bool)
            fresh.append((eq[last], elow[last], ehigh[last]))
        wlow, whigh = side.extend(letter, wlow, whigh)
        alive = whigh > wlow
        whole = (wq[alive], wlow[alive], whigh[alive])
        if len(q):
            low, high = side.extend(letters[starts[q] + t], low, high)
            alive = high > low
            q, low, high = q[alive], low[alive], high[alive]
        spent = tuple(np.concatenate(parts) for parts in zip((q, low, high), *fresh))
        if not len(spent[0]) and not len(whole[0]):
            break
    if not answers:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(parts) for parts in zip(*answers))


def near_pairs(words: list[str], left: list[str], right: list[str]) -> tuple[list[str], list[str], np.ndarray]:
    """``(query, word, deleted)`` of all words of ``words`` that are a query with one letter replaced or deleted: behind its left half for the
    queries of ``left``, in its left half for those of ``right``."""
    alphabet = {c: i for i, c in enumerate(sorted(set().union(*words)), 1)}
    index = Index(words, alphabet)
    found: tuple[list[str], list[str]] = ([], [])
    for direction, queries in ((1, left), (0, right)):
        read = queries if direction else [q[::-1] for q in queries]
        exact = np.array([len(q) // 2 if direction else len(q) - len(q) // 2 for q in queries], dtype=np.int64)
        # A run's last place is its last from the front: behind the half when it reaches over the middle.
        at, rank = _search(index.sides[direction], read, exact, alphabet, bool(direction))
        found[0].extend(queries[i] for i in at.tolist())
        found[1].extend(words[i] for i in index.back[direction][rank].tolist())
    deleted = np.fromiter(map(len, found[0]), dtype=np.int64) != np.fromiter(map(len, found[1]), dtype=np.int64)
    return *found, deleted


_NEAR = "word string, near string, near_n long"


def _share(rows: pd.DataFrame) -> pd.DataFrame:
    kept = rows[rows["role"] == 0].drop_duplicates("word")
    counts = dict(zip(rows["word"], rows["n"]))
    sides = [rows[rows["role"] == r].drop_duplicates("word")["word"].tolist() for r in (1, 2)]
    a, b, deleted = near_pairs(kept["word"].tolist(), *sides) if len(kept) and any(sides) else ([], [], np.zeros(0, dtype=bool))
    at = np.flatnonzero(deleted).tolist()
    words, near = a + [b[i] for i in at], b + [a[i] for i in at]
    as_text = lambda values: pd.Series(values, dtype=object)
    return pd.DataFrame({"word": as_text(words), "near": as_text(near), "near_n": pd.Series(map(counts.__getitem__, near), dtype="int64")})


def near_words(words: DataFrame, share: int = SHARE, share_words: int = SHARE_WORDS) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words of ``words`` (``word, n``, distinct) that are near, once."""
    size = F.length("word")
    # What partners of the same length, or of one more, look up: the first half // 2 code points, the last half - half // 2.
    lengths = F.array_distinct(F.array(size, size + 1))
    fronts = F.transform(lengths, lambda x: F.concat(F.lit("<"), F.substring("word", F.lit(1), F.floor(x / 2).cast("int"))))
    backs = F.transform(lengths, lambda x: F.concat(F.lit(">"), F.right("word", F.ceil(x / 2).cast("int"))))
    kept = words.select("word", "n", F.explode(F.array_distinct(F.concat(fronts, backs))).alias("half")).withColumn("role", F.lit(0))
    asked = words.select(
        "word",
        "n",
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("<"), F.substring("word", F.lit(1), F.floor(size / 2).cast("int"))).alias("half"), F.lit(1).alias("role")),
                F.struct(F.concat(F.lit(">"), F.right("word", F.ceil(size / 2).cast("int"))).alias("half"), F.lit(2).alias("role")),
            )
        ).alias("x"),
    ).select("word", "n", "x.half", "x.role")
    sizes = keep(kept.groupBy("half").agg(F.count(F.lit(1)).alias("kept")))
    total = sizes.agg(F.sum("kept")).first()[0] or 0
    shares = max(1, -(-total // share_words))
    hot = sizes.where(F.col("kept") > share).select("half", F.ceil(F.col("kept") / share).cast("int").alias("parts"))

    def dealt(rows: DataFrame, part) -> DataFrame:
        """The share of each row by the hash of its half; the parts of a large half are shares of their own."""
        parts = rows.join(hot, "half", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
        large = F.col("parts") > 1
        return parts.select(
            F.when(large, F.concat_ws(":", "half", "part")).alias("large"),
            F.when(large, F.lit(0)).otherwise(F.pmod(F.xxhash64("half"), F.lit(shares))).alias("share"),
            "word",
            "n",
            "role",
        )

    own = dealt(kept, F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    visits = dealt(asked, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return own.unionByName(visits).groupBy("large", "share").applyInPandas(_share, _NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``forms`` (``word, form``): the last word when forms are followed. A form is several times as frequent as its word, so
    chains end; each round doubles the steps made."""
    at = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = at.join(step, "root", "left")
        new = keep(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per word of ``docs`` (``doc_id, text``): ``word, form, root, n, n_near, form_n``."""
    words = keep(vocabulary(docs, least_count))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= TIMES * F.col("n")
    found = keep(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        )
    )
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
