"""Array expressions that cost time in proportion to an array's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body (and functions inside of it) name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(values: Column, first: Column) -> Column:
    step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    start = F.struct(first.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(values, start, step, lambda a: a["out"])


def sums_before(values: Column) -> Column:
    """The sum of the values (long) before each place.

    A fold copies the array that it grows, so it runs over chunks of CHUNK values
    and over the chunks' sums.
    """

    def of(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(CHUNK))
        parts = F.transform(places, lambda i: F.slice(v, i + 1, F.lit(CHUNK)))
        total = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)
        return let(parts, lambda p: F.flatten(F.zip_with(p, _fold(F.transform(p, total), F.lit(0)), _fold)))

    return let(values, lambda v: F.when(F.size(v) <= CHUNK, _fold(v, F.lit(0))).otherwise(of(v)))
