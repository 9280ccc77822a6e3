"""Functions over logit arrays. Arrays stay arrays: a wide vocabulary is folded in place, never exploded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(logits: Column | str) -> Column:
    logits = F.col(logits) if isinstance(logits, str) else logits
    return logits.cast("array<double>")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression that a lambda body merely refers to is computed again for every element; bound as a lambda variable it
    is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_normaliser(z: Column) -> Column:
    """``ln Σ exp(z)``, shifted by the maximum so that it cannot overflow."""

    def shifted(values: Column) -> Column:
        return let(
            F.array_max(values),
            lambda top: top + F.ln(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))),
        )

    return let(z, shifted)


def tempered(logits: Column, temperature: float) -> Column:
    return logits if temperature == 1 else F.transform(logits, lambda x: x / F.lit(float(temperature)))


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    return let(
        tempered(logits, temperature),
        lambda z: let(log_normaliser(z), lambda norm: F.transform(z, lambda x: x - norm)),
    )


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    return let(
        tempered(logits, temperature),
        lambda z: let(log_normaliser(z), lambda norm: F.transform(z, lambda x: F.exp(x - norm))),
    )


def masked_softmax(logits: Column, mask: Column, mask_value: float = -3.4028234663852886e38) -> Column:
    """Softmax after replacing positions where ``mask`` is false by ``mask_value`` (default: the lowest float)."""
    return softmax(F.zip_with(logits, mask, lambda x, keep: F.when(keep, x).otherwise(F.lit(mask_value))))


def mix_logits(student: Column, teacher: Column, alpha: Column | float) -> Column:
    """``(1 − alpha)·student + alpha·teacher``, element by element."""
    a = F.lit(alpha)
    return F.zip_with(student, teacher, lambda s, t: (1 - a) * s + a * t)


