"""Array column functions: last elements, padding, shortest zip, position ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_elements(ids: Column, k: int) -> Column:
    """The last ``k`` elements; all of them when there are fewer (``slice`` with a negative start gives none then)."""
    return F.when(F.size(ids) >= k, F.slice(ids, -k, k)).otherwise(ids) if k > 0 else F.slice(ids, 1, 0)


def repeat(value: int, n: Column) -> Column:
    """An int array of ``n`` times ``value``; empty when ``n`` is zero or less."""
    return F.array_repeat(F.lit(value).cast("int"), F.greatest(n, F.lit(0)))


def pad_right(ids: Column, value: int, length: int) -> Column:
    return F.concat(ids, repeat(value, F.lit(length) - F.size(ids)))


def pad_left(ids: Column, value: int, length: int) -> Column:
    return F.concat(repeat(value, F.lit(length) - F.size(ids)), ids)


def zip_shortest(**arrays: Column) -> Column:
    """Parallel arrays as one array of structs, as long as the shortest (``arrays_zip`` would fill with NULL)."""
    sizes = [F.size(a) for a in arrays.values()]
    length = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    return F.arrays_zip(*[F.slice(a, F.lit(1), length).alias(name) for name, a in arrays.items()])


def running_sums(numbers: Column) -> Column:
    """Sums of an int array up to and with each place, by doubling: after the step for k every place holds the sum of the last 2k
    numbers. n * log2(n) additions, where a fold that appends would copy its array at every place."""

    def double(sums: Column, k: Column) -> Column:
        earlier = F.concat(F.array_repeat(F.lit(0), k), F.slice(sums, F.lit(1), F.size(sums) - k))
        return F.zip_with(sums, earlier, lambda x, y: x + y)

    def summed(n: Column) -> Column:
        return F.aggregate(F.filter(F.lit([1 << k for k in range(31)]), lambda k: k < F.size(n)), n, double)

    # bound by a lambda, the numbers are computed once; in the filter they would be for each step
    return F.get(F.transform(F.array(numbers), summed), F.lit(0))


def position_ids(mask: Column) -> Column:
    """Running count of attended positions minus one; 1 where the mask is 0."""
    counts = running_sums(mask.cast("array<int>"))
    return F.zip_with(mask, counts, lambda m, n: F.when(m == 0, F.lit(1)).otherwise(n - 1))


def next_token_pairs(ids: Column) -> Column:
    """Pairs ``(input, target)`` of every token and its successor."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.arrays_zip(F.slice(ids, F.lit(1), n).alias("input"), F.slice(ids, F.lit(2), n).alias("target"))
