"""Running sums and maxima over arrays, in steps that grow with the array and not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumeline.functions.scoped import let

#: Elements taken together: an array that grows inside `aggregate` is copied at each step, so none grows longer than this
#: or than one number for each lot.
LOT = 64


def before(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element what `combine` (associative) makes of `zero` and all before it; one element more, for all of them.

    Null for a null array; an empty one gives `zero` alone. The values must be of `zero`'s type and not null.
    """

    def lots(v: Column) -> Column:
        n = F.size(v["x"])
        return F.sequence(F.lit(0), F.floor((n - 1) / LOT).cast("int"))

    def places(v: Column, lot: Column) -> Column:
        return F.sequence(lot * LOT, F.least(lot * LOT + LOT, F.size(v["x"])) - 1)

    def grown(items: Column, start: Column, value: Callable[[Column], Column]) -> Column:
        first = F.struct(start.alias("at"), F.filter(F.array(start), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(items, first, lambda a, i: F.struct(combine(a["at"], value(i)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def whole(v: Column) -> Column:
        totals = F.transform(lots(v), lambda lot: F.aggregate(places(v, lot), zero, lambda a, i: combine(a, F.get(v["x"], i))))
        return let(lambda s: F.concat(F.flatten(F.transform(s["starts"]["out"], lambda at, lot: grown(places(v, lot), at, lambda i: F.get(v["x"], i))["out"])), F.array(s["starts"]["at"])), starts=grown(totals, zero, lambda t: t))

    return let(lambda v: F.when(F.size(v["x"]) > 0, whole(v)).when(F.size(v["x"]) == 0, F.array(zero)), x=values)


def sums_before(values: Column) -> Column:
    """For each of an array of integers the sum of those before it, then the sum of all."""
    return before(F.transform(values, lambda x: x.cast("bigint")), lambda a, x: a + x, F.lit(0).cast("bigint"))


def largest_before(values: Column, least: int = 0) -> Column:
    """For each of an array of integers the largest before it, `least` where none is larger, then the largest of all."""
    return before(F.transform(values, lambda x: x.cast("bigint")), lambda a, x: F.greatest(a, x), F.lit(least).cast("bigint"))
