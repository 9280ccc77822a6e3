"""BM25 index of texts, and search through it.

Scores use ``ln(1 + (N − df + 0.5)/(df + 0.5)) · tf/(tf + k1·(1 − b + b·dl/avgdl))``. Terms are lower-cased runs of letters
and digits of any script; there is no stemming and no stopword list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomwright.session import cut_lineage

K1 = 0.9
B = 0.4
TERM_PATTERN = r"[\p{L}\p{N}]+"
# Characters of text in one partition of the postings: its terms are sorted in memory by the task that gathers their positions.
TASK_CHARS = 4_000_000
# Query terms are broadcast up to so many rows; with more of them the join is Spark's choice.
BROADCAST_ROWS = 200_000
# Postings of query terms in one partition of a read index: with a query for every few of them, their scores fit a task's memory.
TASK_POSTINGS = 500_000


def terms(text: Column | str) -> Column:
    """The terms of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


@dataclass(frozen=True)
class Index:
    """``postings(db_id, doc_id, dl, term, tf, positions)``, ``documents(db_id, doc_id, dl, raw)``,
    ``term_stats(db_id, term, df)``, ``stats(db_id, n_docs, avgdl)``.

    Postings are partitioned by document, and carry the document length: scoring needs no join with the documents, all
    terms of a document meet in one task, and a hot term is spread over all tasks. Files do not tell that they hold whole documents:
    the postings of a read index are ``scattered``, and a search partitions those of its own terms again.
    """

    postings: DataFrame
    documents: DataFrame
    term_stats: DataFrame
    stats: DataFrame
    scattered: bool = False


def bm25_index(docs: DataFrame) -> Index:
    """Index ``docs(db_id, doc_id, contents)``; ``(db_id, doc_id)`` identifies a row."""
    texts = docs.select("db_id", "doc_id", "contents")
    length = F.size("_terms").cast("bigint").alias("dl")
    analysed = texts.withColumn("_terms", terms("contents"))
    documents = analysed.select("db_id", "doc_id", length, F.col("contents").alias("raw"))
    size = texts.agg(F.sum(F.length("contents")).alias("chars"), F.count_distinct("db_id").alias("dbs")).first()
    # The name of a single database may be a constant, which Spark drops from the keys: then it would deal the postings out again.
    keys = ["db_id", "doc_id"] if size.dbs > 1 else ["doc_id"]
    postings = (
        texts.repartition((size.chars or 0) // TASK_CHARS + 1, *keys)  # moves the plain text, which is smaller than its terms
        .select("db_id", "doc_id", terms("contents").alias("_terms"))
        # outer, as Spark would otherwise ask for the terms once more where it reads the texts, to leave out those without
        .select("db_id", "doc_id", length, F.posexplode_outer("_terms").alias("_pos", "term"))
        .where("term IS NOT NULL")
        .groupBy("db_id", "doc_id", "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("_pos")).alias("positions"))
    )
    term_stats = document_frequencies(postings)
    stats = documents.groupBy("db_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return Index(postings, documents, term_stats, stats)


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("db_id", "term").agg(F.count(F.lit(1)).alias("df"))


def write_index(index: Index, folder: str) -> None:
    """Write the index, one folder per database. Databases present in ``index`` are replaced, others are kept. Document frequencies are
    counted in the written postings, which would have to be made once more otherwise."""

    def write(df: DataFrame, name: str) -> None:
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("db_id")
        out.parquet(f"{folder}/{name}")

    for name in ("postings", "documents", "stats"):
        write(getattr(index, name), name)
    written = index.postings.sparkSession.read.schema(index.postings.schema).parquet(f"{folder}/postings")
    here = index.documents.select(F.col("db_id").alias("_db")).distinct()  # one row per database
    counted = document_frequencies(written.join(F.broadcast(here), F.col("db_id").eqNullSafe(F.col("_db")), "left_semi"))
    write(counted, "term_stats")


def read_index(spark, folder: str) -> Index:
    def part(name: str) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{name}")
        return df.withColumn("db_id", F.col("db_id").cast("string"))

    return Index(part("postings"), part("documents"), part("term_stats"), part("stats"), scattered=True)


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    return F.ln(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms per query with ``qtf``, how often the query holds them, from ``queries(query_id, db_id, text)``."""
    return (
        queries.select("query_id", "db_id", F.explode(terms("text")).alias("term"))
        .groupBy("query_id", "db_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def query_weights(index: Index, queries: DataFrame) -> DataFrame:
    """Per query term its weight ``qw`` (times asked, times inverse frequency) and its database's average length."""
    return (
        query_terms(queries)
        .join(index.term_stats, ["db_id", "term"])
        .join(index.stats, "db_id")
        .select(
            "query_id",
            "db_id",
            "term",
            (F.col("qtf") * inverse_frequency(F.col("n_docs"), F.col("df"))).alias("qw"),
            "avgdl",
        )
    )


def _few(df: DataFrame) -> DataFrame:
    """A written ``df`` that joins as a broadcast if it has at most ``BROADCAST_ROWS`` rows: then the postings stay where they are, however
    many of them a frequent term has."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def asked(index: Index, queries: DataFrame) -> Index:
    """The index as far as the queries ask for it: postings and document frequencies of their terms. Terms are few beside their
    postings, so what no query asks for is left where it is read."""
    wanted = cut_lineage(query_terms(queries).select("db_id", "term").distinct())
    if wanted.count() > BROADCAST_ROWS:
        return index
    known = index.term_stats.join(F.broadcast(wanted), ["db_id", "term"], "left_semi")
    postings = index.postings.join(F.broadcast(wanted), ["db_id", "term"], "left_semi")
    return replace(index, postings=postings, term_stats=cut_lineage(known))


def _together(index: Index) -> DataFrame:
    """The postings without their positions, partitioned by document."""
    postings = index.postings.select("db_id", "doc_id", "dl", "term", "tf")
    if not index.scattered:
        return postings
    rows = index.term_stats.agg(F.sum("df")).first()[0] or 0
    return postings.repartition(rows // TASK_POSTINGS + 1, "db_id", "doc_id")


def bm25_scores(index: Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """The score of every document that shares a term with a query. A repeated query term counts as often as it occurs."""
    index = asked(index, queries)
    weights = _few(cut_lineage(query_weights(index, queries)))
    return (
        _together(index).select("db_id", "doc_id", "dl", "term", "tf")
        .join(weights, ["db_id", "term"])
        .groupBy("query_id", "db_id", "doc_id")
        .agg(F.sum(F.col("qw") * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)).alias("score"))
    )


def bm25_search(index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """The ``k`` best documents per query, with ``rank``; ties go to the lower document id."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return (
        bm25_scores(index, queries, k1, b).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    )


# ---------------------------------------------------------------------------------------------------------------------
# Score-bounded search

# Scores are compared with this slack, since sums in another order may differ in their last digits.
_SLACK = 1e-7
# The rarest terms of a query, up to so many times ``k`` postings, find the documents that give the floor; so many times ``k`` of them are scored in
# full for it.
SEED = 64
LEADERS = 8
# In so many steps the other terms are looked up, rarer ones first.
TIERS = 3


_BY_TERM, _BY_ROW = ("db_id", "term", "block"), ("db_id", "doc_id", "term", "block")


def _least() -> Column:
    """What a score has to reach. Without ``k`` documents there is no floor, and every term is essential."""
    return F.coalesce("floor", F.lit(float("-inf"))) - _SLACK


def _blocked(index: Index) -> DataFrame:
    return index.postings.select("db_id", "doc_id", "dl", "term", "tf", block_of(F.col("dl")).alias("block"))


def block_of(dl: Column) -> Column:
    """The block of a document: lengths of one power of two. What a term can weigh in a long document is far less than in a short one."""
    return F.floor(F.log2(F.greatest(dl, F.lit(1)))).cast("int")


def block_stats(index: Index, k1: float = K1, b: float = B) -> DataFrame:
    """``db_id, term, block, max_weight``: the most that a term weighs in a document of each block, for these parameters."""
    weight = term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    postings = index.postings.join(index.stats.select("db_id", "avgdl"), "db_id")
    return postings.groupBy("db_id", "term", block_of(F.col("dl")).alias("block")).agg(F.max(weight).alias("max_weight"))


def bounded_weights(index: Index, blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query, term and block: ``qw``, ``avgdl``, the postings of rarer terms ``before``, and ``rest``, the most that this term and all
    more frequent ones of the query can add to a document of the block."""
    weights = query_weights(index, queries).join(index.term_stats, ["db_id", "term"])
    rarer = Window.partitionBy("query_id", "db_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    placed = weights.withColumn("before", F.coalesce(F.sum("df").over(rarer), F.lit(0)))
    most = F.col("qw") * F.col("max_weight")
    onward = Window.partitionBy("query_id", "db_id", "block").orderBy("df", "term").rowsBetween(0, Window.unboundedFollowing)
    return (
        placed.join(blocks, ["db_id", "term"])
        .withColumn("rest", F.sum(most).over(onward))
        .select("query_id", "db_id", "term", "block", "qw", "avgdl", "df", "before", "rest")
    )


def _scored(postings: DataFrame, weights: DataFrame, on: Sequence[str], k1: float, b: float) -> DataFrame:
    """Summed scores per query and document of the postings that ``weights`` asks for."""
    part = F.col("qw") * term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    found = postings.join(weights, list(on))
    return found.groupBy("query_id", "db_id", "doc_id", "block").agg(F.sum(part).alias("score"))


def judged_terms(
    index: Index, blocks: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, seed: int = SEED, leaders: int = LEADERS
) -> tuple[DataFrame, DataFrame]:
    """``bounded_weights`` with ``essential``, and the floor of each query that has one (``query_id, db_id, floor``).

    The best documents by the rarest terms give a floor: the ``k``-th best of their full scores. A term is essential in a block if it and all
    more frequent terms together can reach the floor there; a document without an essential term cannot.
    """
    postings = _blocked(index)
    weights = cut_lineage(bounded_weights(index, blocks, queries))
    first = _scored(postings, _few(weights.where(F.col("before") < seed * k)), _BY_TERM, k1, b)
    best = Window.partitionBy("query_id", "db_id").orderBy(F.desc("score"), "doc_id")
    ahead = cut_lineage(first.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= leaders * k))
    theirs = postings.join(_few(cut_lineage(ahead.select("db_id", "doc_id").distinct())), ["db_id", "doc_id"], "left_semi")
    terms_of = ahead.select("query_id", "db_id", "doc_id", "block").join(weights, ["query_id", "db_id", "block"])
    full = _scored(theirs, terms_of, _BY_ROW, k1, b).withColumn("_n", F.row_number().over(best))
    floors = cut_lineage(full.where(F.col("_n") == k).select("query_id", "db_id", F.col("score").alias("floor")))
    judged = weights.join(floors, ["query_id", "db_id"], "left").withColumn("essential", F.col("rest") >= _least())
    return judged.drop("floor"), floors


def bounded_scores(index: Index, blocks: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """Exact scores of all documents that can be among the ``k`` best of a query.

    Only essential terms meet all their postings. The others are looked up, rarer ones first, for those documents alone whose score so far can
    still reach the floor.
    """
    judged, floors = judged_terms(index, blocks, queries, k, k1, b)
    tier = Window.partitionBy("query_id", "db_id", "block").orderBy("df", "term")
    others = judged.where("not essential").withColumn("tier", F.ntile(TIERS).over(tier))
    placed = cut_lineage(judged.where("essential").withColumn("tier", F.lit(0)).unionByName(others))
    if placed.count() <= BROADCAST_ROWS:
        return _scored_in_place(index, placed, floors, k1, b)
    return _scored_in_steps(index, placed, floors, k1, b)


def _scored_in_steps(index: Index, placed: DataFrame, floors: DataFrame, k1: float, b: float) -> DataFrame:
    """For many queries: documents and the terms looked up for them meet the postings in joins, tier by tier."""
    postings = _together(index).withColumn("block", block_of(F.col("dl")))
    others = placed.where("tier > 0")
    scores = _scored(postings, _few(placed.where("tier = 0")), _BY_TERM, k1, b)
    for n in range(1, TIERS + 1):
        # The most that the terms from this tier on can add; documents that cannot reach the floor with it are done.
        rest = others.where(F.col("tier") >= n).groupBy("query_id", "db_id", "block").agg(F.max("rest").alias("most"))
        bound = scores.join(rest, ["query_id", "db_id", "block"], "left").join(floors, ["query_id", "db_id"], "left")
        able = cut_lineage(bound.where(F.col("score") + F.coalesce("most", F.lit(0.0)) >= _least()).drop("most", "floor"))
        terms_of = able.select("query_id", "db_id", "doc_id", "block").join(others.where(F.col("tier") == n), ["query_id", "db_id", "block"])
        both = able.unionByName(_scored(postings, terms_of, _BY_ROW, k1, b))
        scores = both.groupBy("query_id", "db_id", "doc_id", "block").agg(F.sum("score").alias("score"))
    return scores.drop("block")


# Weights that meet postings in one step of a task.
STEP_ROWS = 1_000_000
# Terms hold letters and digits only.
_SEPARATOR = "\x1f"


def _ranges(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges of places: to which range each place belongs, and the places."""
    n = end - first
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - first, n)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (in ``wanted``, in the sorted ``keys``) that hold the same."""
    return _ranges(np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right"))


class _Weights:
    """The rows of ``bounded_weights``, with ``tier`` (0: essential) and ``least``, as arrays for lookups; held in memory by each worker."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        pairs = rows.select(["query_id", "db_id"]).append_column("_row", pa.array(np.arange(len(rows))))
        queries = pairs.group_by(["query_id", "db_id"]).aggregate([("_row", "min"), ("_row", "list")])
        self.query_ids = rows["query_id"].take(queries["_row_min"]).combine_chunks()
        lists = queries["_row_list"].combine_chunks()
        query = np.empty(len(rows), dtype=np.int64)
        query[lists.flatten().to_numpy()] = np.repeat(np.arange(len(queries)), lists.value_lengths().to_numpy())
        self.least = rows["least"].take(queries["_row_min"]).to_numpy()
        coded = self.term_keys(rows["term"], rows["db_id"]).combine_chunks().dictionary_encode()
        term, self.terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        block, tier = rows["block"].to_numpy().astype(np.int64), rows["tier"].to_numpy()
        qw, avgdl, rest = (rows[c].to_numpy() for c in ("qw", "avgdl", "rest"))
        self.blocks = int(block.max(initial=0)) + 1
        self.tiers = []  # per tier: sorted keys, and beside them query or term, weight, average length
        self.most = []  # per tier and (query, block): the most that terms from it on can add
        for n in range(TIERS + 1):
            at = np.flatnonzero(tier == n)
            key = (query if n else term)[at] * self.blocks + block[at]
            at, key = at[order := np.argsort(key, kind="stable")], np.sort(key, kind="stable")
            self.tiers.append((key, (term if n else query)[at], qw[at], avgdl[at]))
            most, later = np.zeros(len(queries) * self.blocks), tier >= max(n, 1)
            np.maximum.at(most, (query * self.blocks + block)[later], rest[later])
            self.most.append(most)

    @staticmethod
    def term_keys(term, db_id):
        return pc.binary_join_element_wise(term, db_id, _SEPARATOR)

    def scores(self, documents: pa.RecordBatch, k1: float, b: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query, document (places) and score of all documents that can reach the floor, from rows ``db_id, block, postings``."""
        lists = documents.column("postings")
        lengths = lists.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(documents)), lengths)
        flat = lists.flatten()
        keys = self.term_keys(flat.field("term"), documents.column("db_id").take(pa.array(owner)))
        term = pc.fill_null(pc.index_in(keys, value_set=self.terms.cast(keys.type)), -1).to_numpy().astype(np.int64)
        order = np.lexsort((term, owner))
        order = order[term[order] >= 0]
        owner, term = owner[order], term[order]
        tf, dl = (flat.field(c).to_numpy()[order] for c in ("tf", "dl"))
        place, block = owner * len(self.terms) + term, documents.column("block").to_numpy().astype(np.int64)

        def part(posting: np.ndarray, qw: np.ndarray, avgdl: np.ndarray) -> np.ndarray:
            return qw * (tf[posting] / (tf[posting] + k1 * (1 - b + b * dl[posting] / avgdl)))

        key, query, qw, avgdl = self.tiers[0]
        # a block without weights is beyond the last one
        asked_for = np.where(block[owner] < self.blocks, term * self.blocks + block[owner], -1)
        first, end = np.searchsorted(key, asked_for, "left"), np.searchsorted(key, asked_for, "right")
        done = np.cumsum(end - first)
        start = 0
        while start < len(order):
            before = done[start - 1] if start else 0
            stop = max(int(np.searchsorted(done, before + STEP_ROWS, "right")), start + 1)
            stop = int(np.searchsorted(owner, owner[stop - 1], "right"))  # whole documents
            posting, at = _ranges(first[start:stop], end[start:stop])
            pairs, row = np.unique(owner[posting + start] * len(self.query_ids) + query[at], return_inverse=True)
            score = np.bincount(row, part(posting + start, qw[at], avgdl[at]), minlength=len(pairs))
            doc, asker = np.divmod(pairs, len(self.query_ids))
            for n in range(1, TIERS + 1):
                of = asker * self.blocks + block[doc]
                able = score + self.most[n][of] >= self.least[asker]
                doc, asker, score, of = doc[able], asker[able], score[able], of[able]
                keys_n, term_n, qw_n, avgdl_n = self.tiers[n]
                pair, entry = _found(keys_n, of)
                wanted, posting = _found(place, doc[pair] * len(self.terms) + term_n[entry])
                pair, entry = pair[wanted], entry[wanted]
                score = score + np.bincount(pair, part(posting, qw_n[entry], avgdl_n[entry]), minlength=len(doc))
            yield asker, doc, score
            start = stop


def _scored_in_place(index: Index, placed: DataFrame, floors: DataFrame, k1: float, b: float) -> DataFrame:
    """For queries whose weights may be broadcast: a document's postings of query terms stand in one row, where its scores are made. Nothing
    is moved for each pair of query and document."""
    least = placed.join(floors, ["query_id", "db_id"], "left").withColumn("least", _least())
    columns = ("query_id", "db_id", "term", "block", "qw", "avgdl", "rest", "tier", "least")
    weights = placed.sparkSession.sparkContext.broadcast(_Weights(least.select(*columns).toArrow()))
    documents = (
        _together(index)
        .groupBy("db_id", "doc_id", block_of(F.col("dl")).alias("block"))
        .agg(F.collect_list(F.struct("term", "tf", "dl")).alias("postings"))
    )
    fields = [placed.schema["query_id"], documents.schema["db_id"], documents.schema["doc_id"], StructField("score", DoubleType())]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "db_id", "doc_id", "score"]
        for batch in batches:
            for query, doc, score in weights.value.scores(batch, k1, b):
                at = pa.array(doc)
                ids = (batch.column(c).take(at) for c in ("db_id", "doc_id"))
                yield pa.RecordBatch.from_arrays([weights.value.query_ids.take(pa.array(query)), *ids, pa.array(score)], names)

    return documents.mapInArrow(scored, StructType(fields))


def bounded_search(
    index: Index, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, blocks: DataFrame | None = None
) -> DataFrame:
    """The same rows as :func:`bm25_search`, without scoring every document that shares a frequent term with a query."""
    index = asked(index, queries)
    blocks = block_stats(index, k1, b) if blocks is None else blocks
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    scores = bounded_scores(index, blocks, queries, k, k1, b)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
