"""Training metrics: step averages, wide view, convergence, step times, checkpoints, resuming.

``metrics(run_id, gpu, tag, step, value)`` is an append-only log. A run may hold most of it, so windows that look back work on
bounded chunks of a run (:func:`loomwright.operators.ordering.overlapping_chunks`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.ordering import ordered_index, overlapping_chunks

# The logged series, and the factor by which losses of kind "mse" are shown.
TAGS = ("train-loss", "learning-rate", "mix-in", "clm_beta", "imp-weight")
MSE_DISPLAY_FACTOR = 1e5
CHUNK_ROWS = 100_000


def step_loss_average(
    losses: DataFrame, accumulation_steps: int, keys: Sequence[str] = ("run_id", "gpu", "step"), kind: str | None = None
) -> DataFrame:
    """Per step the sum of its micro-batch losses over ``accumulation_steps``, as logged and as shown."""
    shown = MSE_DISPLAY_FACTOR if kind == "mse" else 1.0
    mean = F.sum("value") / accumulation_steps
    return losses.groupBy(*keys).agg(mean.alias("loss"), (mean * shown).alias("shown_loss"))


def metrics_wide(metrics: DataFrame, tags: Sequence[str] = TAGS, keys: Sequence[str] = ("run_id", "gpu", "step")) -> DataFrame:
    """One column per tag. The tags are given, so no pass over the data is needed to find them."""
    return metrics.groupBy(*keys).pivot("tag", list(tags)).agg(F.first("value", ignorenulls=True))


def convergence(
    losses: DataFrame,
    patience: int,
    threshold: float,
    run: str = "run_id",
    step: str = "step",
    value: str = "value",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``converged``: the last ``patience`` changes of the loss are all smaller than ``threshold``.

    False until ``patience + 1`` losses have been seen. Distillation runs use a threshold of 1e-27 and as many steps as epochs,
    others 1e-4 and 2.
    """
    chunks, part = overlapping_chunks(losses, [step], [run], patience, chunk_rows)
    order = Window.partitionBy(*part).orderBy("_pos")
    change = F.abs(F.col(value) - F.lag(value).over(order))
    recent = order.rowsBetween(-(patience - 1), 0)
    marked = (
        chunks.withColumn("_change", change)
        .withColumn("_largest", F.max("_change").over(recent))
        .withColumn("_seen", F.count("_change").over(recent))
    )
    done = F.coalesce((F.col("_seen") == patience) & (F.col("_largest") < threshold), F.lit(False))
    return marked.where(~F.col("_lead")).select(*losses.columns, done.alias("converged"))


def step_time(
    steps: DataFrame, run: str = "run_id", step: str = "step", ts: str = "ts", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``seconds``: time since the run's step before; NULL at its first."""
    chunks, part = overlapping_chunks(steps, [step], [run], 1, chunk_rows)
    order = Window.partitionBy(*part).orderBy("_pos")
    gap = _seconds(F.col(ts)) - _seconds(F.lag(ts).over(order))
    marked = chunks.withColumn("seconds", gap)
    return marked.where(~F.col("_lead")).select(*steps.columns, "seconds")


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def exact_quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per ``group`` the values of ``value`` that stand at the given shares of their order (no value in between is made); NULLs do not count,
    a group of NULLs only has NULL.

    Every value gets its place by :func:`ordered_index`, so a group with most of the rows is spread over many partitions; then the values at the
    wanted places are picked, one row per group and share.
    """
    known = df.where(F.col(value).isNotNull()).select(group, value)
    placed = ordered_index(known, [value], [group], name="_at")
    sizes = df.groupBy(group).agg(F.count(value).alias("_n"))

    def place(share: float) -> Column:
        return F.greatest(F.col("_n") - F.floor(F.col("_n") - F.lit(share) * F.col("_n")), F.lit(1)) - 1

    wanted = sizes.select(group, F.explode(F.array_distinct(F.array(*[place(q) for q in shares.values()]))).alias("_at"))
    found = sizes.join(placed.join(wanted, [group, "_at"]), group, "left")
    picked = [F.max(F.when(F.col("_at") == place(q), F.col(value))).alias(name) for name, q in shares.items()]
    return found.groupBy(group).agg(*picked)


def step_time_summary(times: DataFrame, run: str = "run_id") -> DataFrame:
    """Median and 95th percentile of the step times per run, exact."""
    return exact_quantiles(times, run, "seconds", {"p50": 0.5, "p95": 0.95})


def checkpoint_steps(steps: DataFrame, every: int, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Steps at which a checkpoint is written: every ``every`` steps, and the last step of each epoch."""
    keys = list(keys)
    regular = steps.where(F.col("step") % every == 0).select(*keys, "epoch", "step")
    last = steps.groupBy(*keys, "epoch").agg(F.max("step").alias("step"))
    return regular.unionByName(last).distinct()


def resume_filter(
    batches: DataFrame, done_steps: int, accumulation_steps: int, batches_per_epoch: int, skip_every_epoch: bool = False
) -> DataFrame:
    """Batches still to be done after ``done_steps``. With ``skip_every_epoch`` the batches skipped in the resumed epoch
    are left out of all later epochs too."""
    epoch, batch = divmod(done_steps * accumulation_steps, batches_per_epoch)
    in_epoch = F.col("batch_id") >= batch
    if skip_every_epoch:
        return batches.where((F.col("epoch") >= epoch) & in_epoch)
    return batches.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & in_epoch))
