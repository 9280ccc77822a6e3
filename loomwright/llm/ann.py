"""Approximate nearest neighbours by inner product, from balanced posting lists.

*Space.* With one more coordinate, sqrt(M^2 - |x|^2) for vectors and 0 for queries (M: the largest norm), the largest inner product is the smallest
distance, so lists and pruning work with distances.

*Lists.* A sample bounded by ``SAMPLE`` vectors is halved again and again at the median of its main direction, then the centres are moved to the
means of what lies nearest, with a surcharge for lists that are too long. Every vector is indexed: it goes to its nearest list and, if it lies
near a boundary, also to others that are at most ``SPREAD`` times as far, up to ``COPIES`` in all.

*Search.* Each query walks a graph of the centres, kept in memory by every task, and takes all lists that are at most ``reach`` times as far as the
nearest one. ``reach`` is the least of ``REACHES`` that finds ``WANTED`` of the true neighbours inside the sample: vectors in clusters need few lists,
vectors without any structure most of them. Lists are packed in groups of about ``GROUP_ROWS`` rows, longer lists are dealt over several groups; a
task scans the chosen lists of one group for a block of queries and gives the best of each query. Scores are computed in double precision on
the original vectors.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, neither do vectors whose length is not the
most frequent one; a null id takes no part; rows with one id and one vector are one candidate, with several vectors the best counts; with fewer
candidates than asked for all that are found come; ties go to the smaller id; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import keep, shuffle_key

NEAREST = 20
SAMPLE = 40_000
MOST_LISTS = 8_192
SPREAD = 1.02
COPIES = 3
REACHES = (1.02, 1.05, 1.08, 1.1, 1.12, 1.14, 1.16, 1.18, 1.2, 1.25, 1.3, 1.4, 1.6, 2.0)
WANTED = 0.96
PROBES = 200
LINKS = 16
BEAM = 32
GROUP_ROWS = 32_768
QUERY_ROWS = 16_384
SEED = 5


def halved(points: np.ndarray, lists: int) -> np.ndarray:
    """Centres of about ``lists`` parts of equal size."""
    parts = [points]
    while len(parts) < lists:
        parts.sort(key=len, reverse=True)
        widest = parts[0]
        if len(widest) < 2:
            break
        middle = widest - widest.mean(axis=0)
        way = np.linalg.eigh(middle.T @ middle)[1][:, -1]
        order = np.argsort(middle @ way, kind="stable")
        parts[0] = widest[order[: len(order) // 2]]
        parts.append(widest[order[len(order) // 2 :]])
    return np.stack([p.mean(axis=0) for p in parts])


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None]
    return np.maximum(d, 0)


def blocks(n: int, size: int) -> Iterator[slice]:
    return (slice(a, a + size) for a in range(0, n, size))


def by_lists(n: int, lists: int) -> Iterator[slice]:
    """Blocks of so many rows that their distances to all lists take 16 MB."""
    return blocks(n, max(16, (1 << 21) // max(lists, 1)))


def balanced(points: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Centres whose lists have nearly equal lengths."""
    centres = halved(points, lists)
    wanted = len(points) / len(centres)
    surcharge = np.zeros(len(centres))
    for _ in range(rounds):
        parts = by_lists(len(points), len(centres))
        nearest = np.concatenate([(distances(points[b], centres) + surcharge).argmin(axis=1) for b in parts])
        sizes = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        surcharge += 0.05 * points.var(axis=0).sum() * np.clip(np.log((sizes + 1) / (wanted + 1)), -1, 1)
    return centres


@dataclass
class Index:
    """Centres of the lists, the graph that joins each with its nearest ones (rows filled up with the list itself), the largest
    norm, the usual distance of a vector from its list, how much farther than the nearest list a query looks, and how many ids are
    counted for each list: every id once, in one of the lists that are the nearest one of a vector of it."""

    centres: np.ndarray
    links: np.ndarray
    largest: float
    usual: float = 0.0
    reach: float = REACHES[-1]
    sizes: np.ndarray | None = None

    def extended(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - (x**2).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """The lists of each vector, nearest first, -1 where there are fewer than ``COPIES``."""
        d = distances(self.extended(x), self.centres)
        order = np.argsort(d, axis=1, kind="stable")[:, :COPIES]
        near = np.take_along_axis(d, order, axis=1)
        return np.where(near <= SPREAD**2 * near[:, :1], order, -1)

    def search(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists and their distances that a walk of the graph from list 0 meets: it goes on from all lists that are within reach or
        among the ``BEAM`` nearest ones so far. Distances are in units of the nearest one, or of the usual one if that is larger,
        since a query can lie on a centre."""
        q = np.append(query, 0.0)
        d = np.full(len(self.centres), np.inf)
        passed = np.zeros(len(self.centres), dtype=bool)
        at = np.zeros(1, dtype=int)
        d[0] = np.sqrt(((self.centres[0] - q) ** 2).sum())
        while len(at):
            passed[at] = True
            new = np.unique(self.links[at])
            new = new[np.isinf(d[new])]
            d[new] = np.sqrt(((self.centres[new] - q) ** 2).sum(axis=1))
            beam = np.partition(d, BEAM - 1)[BEAM - 1] if len(d) > BEAM else np.inf
            unit = max(d.min(), self.usual, 1e-300)
            at = np.flatnonzero((d <= max(beam, self.reach * unit)) & ~passed & np.isfinite(d))
        met = np.flatnonzero(np.isfinite(d))
        return met, d[met] / unit

    def chosen(self, query: np.ndarray, least: int) -> np.ndarray:
        """The lists to scan: all within reach, and further ones in order of distance as long as they hold fewer than ``least``
        ids together."""
        met, ratio = self.search(query)
        order = met[np.argsort(ratio, kind="stable")]
        enough = int(np.searchsorted(np.cumsum(self.sizes[order]), least)) + 1
        if enough > len(order):
            return np.arange(len(self.centres))
        return order[: max(enough, int((ratio <= self.reach).sum()))]


def fit(sample: np.ndarray, rows: int, largest: float) -> Index:
    """The index of ``rows`` vectors, of which ``sample`` is a random part: about as many lists as the root of the rows."""
    lists = int(max(1, min(MOST_LISTS, np.sqrt(rows), len(sample))))
    index = Index(np.zeros((0, 0)), np.zeros((0, 0), dtype=int), largest)
    points = index.extended(sample)
    index.centres = balanced(points, lists)
    parts = by_lists(len(points), len(index.centres))
    index.usual = float(np.median(np.concatenate([np.sqrt(distances(points[b], index.centres).min(axis=1)) for b in parts])))
    nearest = np.argsort(distances(index.centres, index.centres), axis=1, kind="stable")[:, : LINKS + 1]
    # Both ways, and along the numbers, so that every list can be reached.
    both = [{a, max(a - 1, 0), min(a + 1, len(nearest) - 1), *row} for a, row in enumerate(nearest.tolist())]
    for a, row in enumerate(nearest.tolist()):
        for b in row:
            both[b].add(a)
    index.links = np.array([sorted(b) + [a] * (max(map(len, both)) - len(b)) for a, b in enumerate(both)], dtype=int)
    index.reach = calibrated(index, sample)
    return index


def calibrated(index: Index, sample: np.ndarray) -> float:
    """The least reach with which the first vectors of the sample find ``WANTED`` of their true neighbours in it."""
    own = np.concatenate([index.lists_of(sample[b]) for b in by_lists(len(sample), len(index.centres))])
    needed = []
    for i, q in enumerate(sample[:PROBES]):
        met, ratio = index.search(q)
        far = np.append(np.full(len(index.centres), np.inf), np.inf)
        far[met] = ratio
        scores = sample @ q
        scores[i] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(NEAREST, len(sample) - 1)]
        needed.append(far[own[best]].min(axis=1))
    if not needed or not len(needed[0]):
        return REACHES[0]
    needed = np.concatenate(needed)
    return next((r for r in REACHES if (needed <= r).mean() >= WANTED), REACHES[-1])


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(list(vectors)).astype(float)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector`` of the rows that take part, each pair once, written to the shared folder."""
    found = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = found.where("id is not null and vector is not null").where(~odd & F.exists("vector", lambda v: v != 0))
    good = keep(sound.groupBy("id", "vector").agg(F.count(F.lit(1)).alias("copies")))
    width = good.groupBy(F.size("vector").alias("w")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), "w").first()
    return good.where(F.size("vector") == (width["w"] if width else 0)).select("id", "vector")


def neighbours(rows: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", n: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``n`` nearest rows found for each row that meets the condition ``queries`` (over ``id``)."""
    spark = rows.sparkSession
    good = usable(rows, key, vector)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    count, largest = good.agg(F.count(F.lit(1)), F.max(norm)).first()
    place = F.conv(F.substring(shuffle_key(SEED, F.col("id")), 1, 8), 16, 10).cast("double") / 2**32
    schema = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], schema)
    sample = good.where(place * count < SAMPLE).orderBy(place, "id").select("vector").toPandas()["vector"]
    if not len(sample):  # one row per thousands of others with one id
        sample = good.limit(SAMPLE).toPandas()["vector"]
    fitted = fit(_stacked(sample), count, largest)
    index = spark.sparkContext.broadcast(fitted)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[b] for b in by_lists(len(batch), len(index.value.centres))):
                lists = index.value.lists_of(_stacked(part["vector"]))
                for c in range(lists.shape[1]):
                    at = lists[:, c] >= 0
                    yield part[at].assign(list=lists[at, c], nth=c)

    posted = keep(good.mapInPandas(post, "id long, vector array<double>, list int, nth int"))
    # One row per list comes to the driver, at most MOST_LISTS.
    sizes = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}
    once = posted.where("nth = 0").groupBy("id").agg(F.min("list").alias("list"))
    fitted.sizes = np.zeros(len(fitted.centres), dtype=int)
    for r in once.groupBy("list").count().collect():
        fitted.sizes[r["list"]] = r["count"]
    searched = spark.sparkContext.broadcast(fitted)
    first, pieces, filled, group = {}, {}, 0, 0
    for at in range(len(fitted.centres)):
        size = sizes.get(at, 0)
        if filled and filled + size > GROUP_ROWS:
            filled, group = 0, group + 1
        first[at], pieces[at] = group, max(1, -(-size // GROUP_ROWS))
        filled += size
        group += pieces[at] - 1
    packed = spark.createDataFrame(
        [(at, first[at], pieces[at]) for at in first], "list int, first int, pieces int"
    )
    asked = good.where(queries)
    rounds = max(1, -(-asked.count() // QUERY_ROWS))
    rows_of = posted.join(F.broadcast(packed), "list").select(
        "id", "vector", "list", (F.col("first") + F.pmod(F.xxhash64("id"), "pieces")).cast("int").alias("group"),
        F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"),
    )

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, q in zip(batch["id"], batch["vector"]):
                where: dict[int, list[int]] = {}
                for x in searched.value.chosen(np.asarray(q, dtype=float), n + 1).tolist():
                    for piece in range(pieces[x]):
                        where.setdefault(first[x] + piece, []).append(x)
                out += [(at, q, lists, g) for g, lists in where.items()]
            yield pd.DataFrame(out, columns=["id", "vector", "lists", "group"])

    chosen = asked.mapInPandas(choose, "id long, vector array<double>, lists array<int>, group int")
    chosen = chosen.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int"))

    def scan(candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(asking):
            candidates = candidates.sort_values("id", kind="stable")
            ids, lists, x = candidates["id"].to_numpy(), candidates["list"].to_numpy(), _stacked(candidates["vector"])
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            open_lists = np.zeros(int(lists.max()) + 1, dtype=bool)
            for b in blocks(len(asking), 64):
                part = asking.iloc[b]
                rough = _stacked(part["vector"]) @ x.T
                for row, at, q, wanted in zip(rough, part["id"], part["vector"], part["lists"]):
                    open_lists[:] = False
                    open_lists[[v for v in wanted if v < len(open_lists)]] = True
                    row[~open_lists[lists] | (ids == at)] = -np.inf
                    # An id counts with its best score, however often it is here. Rounding aside, nothing below the limit can be among the best.
                    tops = np.maximum.reduceat(row, starts)
                    last = max(len(tops) - n, 0)
                    limit = np.partition(tops, last)[last]
                    best = np.flatnonzero((row >= limit - 1e-9 * abs(limit)) & (row > -np.inf))
                    if not len(best):
                        continue
                    score = (x[best] * np.asarray(q, dtype=float)).sum(axis=1)
                    order = np.lexsort((ids[best], -score))
                    _, once = np.unique(ids[best][order], return_index=True)
                    order = order[np.sort(once)][:n]
                    out.append(pd.DataFrame({"query_id": at, "vec_id": ids[best][order], "score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    key_columns = ["group", "round"]
    found = rows_of.groupBy(*key_columns).cogroup(chosen.groupBy(*key_columns)).applyInPandas(
        scan, "query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")
