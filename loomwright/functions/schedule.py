"""Step weights: how much teacher is mixed in, or how much plain loss is kept, at a training step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("linear", "exponential", "step", "cos", "const")


def step_weight(
    step: Column | str,
    total_steps: Column | float,
    kind: str = "cos",
    start: float = 0.2,
    step_size: float = 3,
    direction: str = "normal",
) -> Column:
    """The weight at ``step`` of ``total_steps``; ``direction='inverse'`` gives ``start`` minus it."""
    s = (F.col(step) if isinstance(step, str) else step).cast("double")
    total = (total_steps if isinstance(total_steps, Column) else F.lit(float(total_steps))).cast("double")
    left = total - s
    if kind == "linear":
        weight = start * (left / total)
    elif kind == "exponential":
        weight = start * F.exp(F.lit(math.log(0.01)) * s / total)
    elif kind == "step":
        # casting to bigint truncates toward zero, as int() does
        stairs = (total / step_size).cast("bigint")
        weight = start * ((left / step_size).cast("bigint") / stairs)
    elif kind == "cos":
        weight = (start / 2) * (1 + F.cos(F.lit(step_size * math.pi) * s / total))
    elif kind == "const":
        weight = F.lit(float(start))
    else:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    if direction == "inverse":
        weight = F.lit(float(start)) - weight
    elif direction != "normal":
        raise ValueError("direction must be 'normal' or 'inverse'")
    return weight
