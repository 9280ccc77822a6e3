"""Near duplicates by circulant MinHash with exact verification.

*Signatures.* Every shingle hash is dealt to one of ``PLACES`` places by a first permutation. A second permutation gives the places values; coordinate k
of a signature is the least value found at the places shifted circularly by k. So the values of a shingle for all coordinates lie side by
side in one table, and a signature is the column-wise minimum of a few table rows. ``BANDS`` bands of ``ROWS`` coordinates make two texts with
similarity 0.8 candidates with a probability of 1 - (1 - 0.8^5)^40, that is all but one in 8 million.

*Classes.* Texts with one set of shingles are one class and travel as one row from there on.

*Links.* Each bucket of a band has a leader, the member that shares most buckets with others. All members are compared with it (as many pairs as rows),
and confirmed pairs are joined to groups. What is left are classes of one leader that are in different groups. Up to ``FEW`` members they are
compared with each other. For more, let D(x) be what x and the leader L do not share. Then |x - y| + |y - x| = |D(x)| + |D(y)| - 2 |D(x) and D(y)|, so
a pair can be similar enough only if D(x) and D(y) have so many shingles in common (one at least, as one of them is not linked to L) that they share one among the
first of each, in any fixed order; pairs are looked up by these, rare ones first, and only those whose places leave room for enough common ones are
compared. No link is lost, and a large group of texts that share a passage, or are all nearly alike, never gives all its pairs.
A pair is confirmed on the full sets.

Sets hold 64-bit hashes of shingles; two shingles share one with a probability of 2^-64.

Defined cases: a text that is null, empty or blank has no shingles and is linked with nothing; a text of fewer than four words is one shingle;
a null id is larger than any id; rows with one id get one row each; no rows give no rows; other columns are ignored by
``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import keep, linked_groups, map_in_arrow, text_or_empty

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 40, 5
PLACES = 1 << 22
SEED = 8
# Members of a leader that are simply compared with each other.
FEW = 16
# Places that are looked up at a time, and documents per block of results.
CHUNK, BLOCK = 2_048, 512

_SIGNATURE = "doc_id long, text_md5 string, n_shingles long, set_digest binary, bands array<long>"
_SET = "node long, shingles array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles. Letters A to Z are lower-cased, words are split at ASCII blanks."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(words) - size + 1 + i]
    return np.unique(_mixed(total))


@cache
def _values() -> np.ndarray:
    """The second permutation, continued at its end, as one row of values for all coordinates per place."""
    order = np.random.default_rng(SEED).permutation(PLACES).astype(np.uint32)
    ring = np.concatenate([order, order[: BANDS * ROWS]])
    return np.lib.stride_tricks.sliding_window_view(ring, BANDS * ROWS)


def signature(shingles: np.ndarray) -> np.ndarray:
    places = (_mixed(shingles + np.uint64(SEED)) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
    least = np.full(BANDS * ROWS, PLACES, dtype=np.uint32)
    for at in range(0, len(places), CHUNK):
        np.minimum(least, _values()[places[at : at + CHUNK]].min(axis=0), out=least)
    return least


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """One number per signature and band, different from band to band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(signatures), axis=0)
    for i in range(ROWS):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return total.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, text_md5, n_shingles, set_digest, bands`` of each row of ``docs`` (``doc_id, text``); the last two are null
    without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                sets = [shingle_set(t.as_py()) for t in part.column(2)]
                hashes = band_hashes(np.stack([signature(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([h if len(s) else None for h, s in zip(hashes, sets)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_md5", "n_shingles", "set_digest", "bands"],
                )

    md5 = F.md5(text_or_empty("text").cast("binary"))
    return map_in_arrow(docs.select(F.col("doc_id").cast("long"), md5.alias("text_md5"), "text"), run, _SIGNATURE)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` of the classes in ``nodes`` (``node, first_id, set_digest``), computed again from one of their texts: sets
    of all documents would take more room than the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = []
                for node, digest, text in zip(*(c.to_pylist() for c in part.columns)):
                    s = shingle_set(text)
                    # Another text with the same id is not what is looked for.
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                        found.append((node, s.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    same = F.col("id").eqNullSafe(F.col("first_id"))
    return map_in_arrow(texts.join(nodes, same).select("node", "set_digest", "text"), run, _SET).dropDuplicates(["node"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a, b`` and more) with their sets ``sa`` and ``sb``."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(first, "a").join(second, "b")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a, b``) with ``linked``: whether their sets are similar enough."""
    sized = _with_sets(pairs, sets).select(
        "a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("sum")
    )
    return sized.select("a", "b", (F.col("both") * 100 >= (F.col("sum") - F.col("both")) * PERCENT).alias("linked"))


def _can_reach(x: str, y: str) -> Column:
    """Sets whose sizes differ too much cannot be similar enough."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def _stars(classes: DataFrame) -> DataFrame:
    """``a, b``: every class that shares a bucket, with the leaders of its buckets."""
    members = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = keep(members.join(sizes, "bucket"))
    known = shared.groupBy("node").agg(F.sum("size").alias("known"))
    leaders = shared.join(known, "node").groupBy("bucket").agg(F.max_by("node", F.struct("known", "node")).alias("a"))
    return shared.join(leaders, "bucket").select("a", F.col("node").alias("b")).where("a <> b").distinct()


def _few(members: DataFrame) -> DataFrame:
    """All pairs of the members (``leader, node, n, group``) of leaders with few members; the leader has been compared."""
    members = members.where("node <> leader")
    x = members.select("leader", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "group")))
    y = members.select("leader", *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "group")))
    apart = (F.col("x_node") < F.col("y_node")) & (F.col("x_group") != F.col("y_group")) & _can_reach("x_n", "y_n")
    return x.join(y, "leader").where(apart).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def _many(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of the members (``leader, node, n, group, linked``) of leaders with many members that can be similar enough, by
    what they do not share with the leader."""
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"), "n", "group", "linked")
    # Of two sets of n and m shingles at most (n + m) * apart are in one of them only.
    apart = (100 - PERCENT) / (100 + PERCENT)
    n, size, other = F.col("n"), F.col("size"), F.size("sa")
    differing = _with_sets(pairs, sets).select(
        F.col("a").alias("leader"), F.col("b").alias("node"), "n", "group", "linked",
        F.array_except("sb", "sa").alias("own"), F.array_except("sa", "sb").alias("lacking"),
        other.alias("leaders"),
    ).withColumn("size", F.size("own") + F.size("lacking"))
    # The least number that must be common with any partner; partners of linked members are not linked themselves.
    least = F.greatest(
        F.lit(1.0),
        size - n * (1 + 100 / PERCENT) * apart,
        F.when(F.col("linked"), (size + (F.col("leaders") - n) * apart) / 2).otherwise(F.lit(1.0)),
    )
    differing = differing.withColumn("first", (size - F.ceil(least - 1e-6) + 1).cast("int")).where("first > 0")
    differing = keep(differing)
    key = ["leader", "node"]
    tokens = differing.select(*key, F.explode(F.concat("own", "lacking")).alias("shingle"))
    seen = tokens.groupBy("leader", "shingle").agg(F.count(F.lit(1)).alias("seen"))
    by_rarity = F.row_number().over(Window.partitionBy(*key).orderBy("seen", "shingle"))
    ranked = tokens.join(seen, ["leader", "shingle"]).select(*key, "shingle", by_rarity.alias("place"))
    columns = ["leader", "shingle", "node", "n", "group", "linked", "size", "place"]
    listed = keep(ranked.join(differing.drop("own", "lacking"), key).where("place <= first").select(*columns))
    x = listed.where(~F.col("linked")).select("leader", "shingle", *(F.col(c).alias(f"x_{c}") for c in columns[2:]))
    y = listed.select("leader", "shingle", *(F.col(c).alias(f"y_{c}") for c in columns[2:]))
    once = F.col("y_linked") | (F.col("x_node") < F.col("y_node"))
    common = (F.col("x_size") + F.col("y_size") - (F.col("x_n") + F.col("y_n")) * apart) / 2
    room = F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place")) + 1
    possible = once & (F.col("x_group") != F.col("y_group")) & _can_reach("x_n", "y_n") & (room >= common - 1e-6)
    return x.join(y, ["leader", "shingle"]).where(possible).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))


def _groups(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, group`` of the classes that are linked to another one."""
    stars = keep(_stars(classes))
    in_doubt = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    sets = keep(_sets(docs, classes.select("node", "first_id", "set_digest").join(in_doubt, "node")))
    compared = keep(_compared(stars, sets))
    links = compared.where("linked").select("a", "b")
    groups = linked_groups(links)
    # What is left: classes of one leader in different groups.
    members = compared.select(F.col("a").alias("leader"), F.col("b").alias("node"), "linked").unionByName(
        stars.select(F.col("a").alias("leader"), F.col("a").alias("node"), F.lit(True).alias("linked")).distinct()
    )
    sizes = classes.select("node", F.col("n_shingles").alias("n"))
    members = members.join(sizes, "node").join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    members = keep(members)
    mixed = members.groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.min("group").alias("low"), F.max("group").alias("high"))
    mixed = keep(mixed.where("low <> high").select("leader", "members"))
    few = _few(members.join(mixed.where(F.col("members") <= FEW), "leader"))
    many = _many(members.join(mixed.where(F.col("members") > FEW), "leader"), sets)
    left = few.unionByName(many).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = keep(_compared(left, sets).where("linked").select("a", "b"))
    if more.isEmpty():
        return groups
    return linked_groups(links.unionByName(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept`` and ``text_md5``."""
    signed = keep(signatures(docs))
    classes = (
        signed.where("n_shingles > 0")
        .groupBy("set_digest", "n_shingles")
        .agg(F.min("doc_id").alias("first_id"), F.any_value("bands").alias("bands"))
    )
    # Numbered as they are written, and read with these numbers.
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()))
    groups = keep(_groups(docs, classes))
    group = F.coalesce("group", "node")
    labelled = keep(classes.join(groups, "node", "left").select("set_digest", "first_id", group.alias("group"), "node"))
    least = labelled.groupBy("group").agg(F.min("first_id").alias("component_id"))
    of_class = labelled.join(least, "group").select("set_digest", "component_id")
    whole = signed.drop("bands").join(of_class, "set_digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return whole.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_md5"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which ``near_duplicates`` keeps the text."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5")).distinct()
    md5 = F.md5(text_or_empty("text").cast("binary"))
    return docs.join(kept, (F.col("doc_id").eqNullSafe(F.col("__id"))) & (md5 == F.col("__md5")), "left_semi")
