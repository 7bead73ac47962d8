"""Functions on arrays of bounded length, as SQL over named columns: one row per clip, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(values: Column, limit: Column | int) -> Column:
    """Up to ``limit`` evenly spaced values: all if they are few, the middle one for one, ends included for more."""
    most = F.lit(limit) if isinstance(limit, int) else limit
    n = F.size(values)
    steps = F.greatest(most - 1, F.lit(1))
    picked = F.array_distinct(F.transform(F.sequence(F.lit(0), steps), lambda i: F.rint(i * (n - 1) / steps).cast("int")))
    return (
        F.when((most <= 0) | (n == 0), F.slice(values, 1, 0))
        .when(n <= most, values)
        .when(most == 1, F.slice(values, F.expr("1") + F.floor(n / 2).cast("int"), F.lit(1)))
        .otherwise(F.transform(picked, lambda i: F.get(values, i)))
    )


def spread_places(n: int, limit: int) -> list[int]:
    """Places that ``spread`` takes of n values, for use on a worker."""
    if limit <= 0 or n <= limit:
        return list(range(n if limit > 0 else 0))
    return [n // 2] if limit == 1 else sorted({round(i * (n - 1) / (limit - 1)) for i in range(limit)})


def min_gap(values: Column, gap: float) -> Column:
    """Distinct values in order, each at least ``gap`` after the last one kept (not the last one seen)."""
    start = F.array().cast("array<double>")
    return F.aggregate(
        F.array_sort(F.array_distinct(values)),
        start,
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= gap), F.concat(kept, F.array(x))).otherwise(kept),
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints, each an array of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bright_bits(values: Column) -> Column:
    """A fingerprint: for each value whether it reaches the mean, packed into 64-bit words, the first value lowest."""
    def packed(values: Column, mean: Column) -> Column:
        words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / 64).cast("int") - 1, F.lit(0)))

        def word(w: Column) -> Column:
            part = F.slice(values, w * 64 + 1, F.lit(64))
            bits = F.transform(part, lambda v, i: F.when(v >= mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
            return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

        return F.transform(words, word)

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)

    # Both are computed once, and not again for every value.
    return bound(values, lambda v: bound(mean(v), lambda m: packed(v, m)))
