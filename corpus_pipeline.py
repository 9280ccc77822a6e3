"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing to target weights, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next stage's ``docs``.
All but the last return the columns of ``documents``. Stages with Python workers shorten the session's Arrow batches (``common.short_batches``), as
idle workers, batches and the heap of the other stages lie in one executor's memory.

The tokenizer cannot be written in SQL, so there is no SQL for the whole; a test compares the pipeline with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, exact_dedup, langid, minhash, mixing
from loomwright.llm.common import documents, keep, short_batches

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters and those with a doubtful language go."""
    short_batches(spark)
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near duplicates the one with the smallest id stays."""
    short_batches(spark)
    return minhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus with its sources at their target shares: documents repeated, left out, or cut where a budget ends."""
    return mixing.mixture(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hash of the text they decode to."""
    short_batches(spark)
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), TOKENIZER, ids="ids")
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
