"""Array Columns that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries that a fold copies at most in one step.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once: a one-element array binds it."""
    return F.transform(F.array(value), use)[0]


def sums_before(values: Column) -> Column:
    """For each whole number the sum of those before it; block by block, as a fold copies its result at every step."""

    def plain(own: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(own, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def blocks(every: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), lambda b: F.slice(every, b * BLOCK + 1, BLOCK))
        return bound(cut, lambda parts: F.flatten(F.zip_with(parts, plain(F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)), F.lit(0)), plain)))

    return bound(values, lambda v: F.when(F.size(v) <= BLOCK, plain(v, F.lit(0))).otherwise(blocks(v)))
