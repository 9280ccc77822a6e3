"""The registered queries of this package: each operator on the whole of its table, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from loomwright.llm import ann, bpe, chat, divergence, exact_dedup, langid, minhash, mixing, pages, quality, secrets, sharding, spelling
from loomwright.llm.common import documents
from loomwright.llm.sql import SQL


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(documents(spark, sf_dir, "doc_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return chat.preferences(*chat.with_other_replies(turns))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return ann.neighbours(rows, "id % 20 = 0")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(documents(spark, sf_dir, "doc_id", "text"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text")).drop("text_md5")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.qualities(documents(spark, sf_dir, "doc_id", "text"), labels)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir, "doc_id", "text", "source")).drop("source")


def op11_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir, "doc_id", "text"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir, "text", "lang", "source"))


_ALL = (
    op1_secrets, op2_bpe, op3_chat, op4_language, op5_neighbours, op6_mix, op7_exact_dedup, op8_near_dedup, op9_quality, op10_shards,
    op11_pages, op12_spelling, op13_divergence,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {name: SQL[name] for name in QUERIES if name in SQL}
