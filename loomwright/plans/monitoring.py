"""Queries: training metrics. A run is a user, a logged value an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import monitor
from loomwright.plans import inputs
from loomwright.plans.profiling import scratch_path
from loomwright.plans.registry import query
from loomwright.sources import files

_LOG_SQL = "(SELECT user_id AS run_id, user_id % 4 AS gpu, event_type AS tag, event_id AS step, value, ts FROM events)"
_TAGS = ("view", "click", "purchase", "error", "signup")
_WIDE_SQL = "SELECT run_id, gpu, step, " + ", ".join(f"max(CASE WHEN tag = '{t}' THEN value END) AS {t}" for t in _TAGS)
_STEP = 100  # events per optimizer step


@query(
    "step_loss_average",
    f"""SELECT run_id, gpu, step // {_STEP} AS step, round(sum(value) / 4, 6) AS loss, round(sum(value) / 4 * 1e5, 3) AS shown_loss
    FROM {_LOG_SQL} GROUP BY run_id, gpu, step // {_STEP}""",
)
def step_loss_average(spark, sf):
    losses = inputs.loss_log(spark, sf).withColumn("step", F.expr(f"step div {_STEP}"))
    mean = monitor.step_loss_average(losses, 4, kind="mse")
    return mean.select("run_id", "gpu", "step", F.round("loss", 6).alias("loss"), F.round("shown_loss", 3).alias("shown_loss"))


@query("metrics_wide", f"{_WIDE_SQL} FROM {_LOG_SQL} GROUP BY run_id, gpu, step")
def metrics_wide(spark, sf):
    return monitor.metrics_wide(inputs.loss_log(spark, sf), _TAGS)


@query("write_metrics", f"{_WIDE_SQL.replace('run_id, gpu', 'CAST(run_id AS VARCHAR) AS run_id, CAST(gpu AS INT) AS gpu')} FROM {_LOG_SQL} GROUP BY ALL")
def write_metrics(spark, sf):
    """Appends the log twice over, half of the tags each time, and reads it back."""
    path = scratch_path(spark, "metrics")
    log = inputs.loss_log(spark, sf).select(
        F.col("run_id").cast("string").alias("run_id"), F.col("gpu").cast("int").alias("gpu"), "tag", "step", "value"
    )
    files.write_metrics(log.where(F.col("tag").isin(*_TAGS[:2])), path)
    files.write_metrics(log.where(~F.col("tag").isin(*_TAGS[:2])), path)
    return monitor.metrics_wide(files.read_metrics(spark, path), _TAGS)


@query(
    "convergence",
    f"""SELECT run_id, step, coalesce(seen = 2 AND largest < 12.5, false) AS converged FROM (
        SELECT *, count(change) OVER r AS seen, max(change) OVER r AS largest FROM (
            SELECT *, abs(value - lag(value) OVER (PARTITION BY run_id ORDER BY step)) AS change FROM {_LOG_SQL})
        WINDOW r AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))""",
)
def convergence(spark, sf):
    log = inputs.loss_log(spark, sf).select("run_id", "step", "value")
    return monitor.convergence(log, patience=2, threshold=12.5).drop("value")


@query(
    "step_time",
    f"""SELECT run_id, step, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY run_id ORDER BY step), 6) AS seconds
    FROM {_LOG_SQL}""",
)
def step_time(spark, sf):
    times = monitor.step_time(inputs.loss_log(spark, sf).select("run_id", "step", "ts"))
    return times.select("run_id", "step", F.round("seconds", 6).alias("seconds"))


@query(
    "step_time_summary",
    f"""SELECT run_id, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95 FROM (
        SELECT run_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY run_id ORDER BY step), 6) AS seconds
        FROM {_LOG_SQL}) GROUP BY run_id""",
)
def step_time_summary(spark, sf):
    times = monitor.step_time(inputs.loss_log(spark, sf).select("run_id", "step", "ts"))
    return monitor.step_time_summary(times.withColumn("seconds", F.round("seconds", 6)))


@query(
    "checkpoint_steps",
    f"""SELECT run_id, step // 1000 AS epoch, step FROM {_LOG_SQL} WHERE step % 250 = 0
    UNION SELECT run_id, step // 1000, max(step) FROM {_LOG_SQL} GROUP BY run_id, step // 1000""",
)
def checkpoint_steps(spark, sf):
    steps = inputs.loss_log(spark, sf).select("run_id", F.expr("step div 1000").alias("epoch"), "step")
    return monitor.checkpoint_steps(steps, 250)
