"""Array and hash measures used for near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgraph.functions.rows import bind


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def centered_unit(values: Column) -> Column:
    """Centre and scale an array so that a correlation is one dot product.

    Constant or empty arrays become NULL.
    """

    def centered(v: Column) -> Column:
        mean = F.when(F.size(v) > 0, _sum(v) / F.size(v))
        return bind(mean, lambda m: F.transform(v, lambda x: x - m))

    def scaled(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x))
        return bind(norm, lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)))

    return bind(bind(values.cast("array<double>"), centered), scaled)


def dot(left: Column, right: Column) -> Column:
    """Dot product clamped to [-1, 1]; 0 for NULL or unequal lengths."""
    same = F.size(left) == F.size(right)
    value = _sum(F.zip_with(left, right, lambda a, b: a * b))
    return F.coalesce(
        F.when(same, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))), F.lit(0.0)
    )


def correlation(left: Column, right: Column) -> Column:
    return dot(centered_unit(left), centered_unit(right))


def hamming64(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def pack64(block: Column) -> Column:
    """64-bit hash of an 8x8 block: bit i set where value i exceeds the median
    of values 1..63 (the first, constant term is left out of the median)."""
    doubles = block.cast("array<double>")
    median = F.element_at(F.array_sort(F.slice(doubles, 2, 63)), 32)

    def pack(m: Column) -> Column:
        return F.aggregate(
            F.transform(
                doubles,
                lambda x, i: F.when(
                    x > m, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
                ).otherwise(F.lit(0).cast("bigint")),
            ),
            F.lit(0).cast("bigint"),
            lambda acc, bit: acc.bitwiseOR(bit),
        )

    return bind(median, pack)
