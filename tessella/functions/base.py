"""What the function modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also where use reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def _size(n: Column) -> Column:
    """Length of the blocks that an array of n elements is cut into."""
    return F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))


def running_sums(xs: Column) -> Column:
    """Sum of the elements before each element of an array of bigint.

    Sums of blocks first, then within blocks: the work grows with n**1.5, while appending to an
    array in aggregate() copies it for every element.
    """
    zero = F.lit(0).cast("long")
    add = lambda s, x: s + x

    def run(v: Column) -> Column:
        n, step = F.size(v["x"]), v["step"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda b: F.aggregate(F.slice(v["x"], b * step + 1, step), zero, add))
        starts = let(blocks, lambda bs: F.transform(bs, lambda _, b: F.aggregate(F.slice(bs, F.lit(1), b), zero, add)))
        within = lambda st: F.transform(v["x"], lambda _, i: F.get(st, F.floor(i / step).cast("int")) + F.aggregate(F.slice(v["x"], F.floor(i / step).cast("int") * step + 1, i % step), zero, add))
        return F.when(n > 0, let(starts, within)).otherwise(F.array().cast("array<bigint>"))

    return let(F.struct(xs.alias("x"), _size(F.size(xs)).alias("step")), run)


def places_below(ascending: Column, values: Column) -> Column:
    """For each value, how many elements of an ascending array are smaller: by blocks, then within one."""

    def run(v: Column) -> Column:
        a, step = v["a"], v["step"]
        lasts = F.transform(F.sequence(F.lit(1), F.ceil(F.size(a) / step).cast("int")), lambda b: F.get(a, F.least(b * step, F.size(a)) - 1))

        def place(x: Column, tops: Column) -> Column:
            block = F.size(F.filter(tops, lambda t: t < x))
            return block * step + F.size(F.filter(F.slice(a, block * step + 1, step), lambda t: t < x))

        found = lambda tops: F.transform(values, lambda x: F.least(place(x, tops), F.size(a)))
        return F.when(F.size(a) > 0, let(lasts, found)).otherwise(F.transform(values, lambda x: F.lit(0)))

    return let(F.struct(ascending.alias("a"), _size(F.size(ascending)).alias("step")), run)
