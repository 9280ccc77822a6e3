"""A live view of the append-only metrics log; the other operators are batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.operators.monitor import step_loss_average
from loomwright.sources.files import METRICS_SCHEMA


def watch_step_losses(spark: SparkSession, path: str, accumulation_steps: int, tag: str = "train-loss") -> DataFrame:
    """The step averages of a growing metrics folder, as a streaming DataFrame for output mode ``update`` or ``complete``."""
    log = spark.readStream.schema(METRICS_SCHEMA).parquet(path)
    return step_loss_average(log.where(log.tag == tag), accumulation_steps)
