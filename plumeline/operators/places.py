"""Global places, running totals and exact order statistics, without a task that holds all rows of a table or of a key.

Rows are range-sorted and numbered in their partitions; a number for each partition, a count or a sum, is added up before it
and sent back. Order statistics come from repeated histograms: each pass counts the bins of the interval that
holds the wanted rank and goes on with that bin's least and largest value, until they are equal. What several passes
read is written down first: a sum of doubles that is made anew may differ in its last digits, and then no longer lies in the interval.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.sources.staged import stage, unstage

#: Rows that monotonically_increasing_id numbers in a partition.
_ROWS = 33
#: Bins of a pass; a key has at most so many rows in any window here.
BINS = 4096
#: Up to so many rows of (key, interval) are broadcast; more are joined by sort and merge.
FEW = 200_000


def _sorted(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with `_id`: their partition, in the order given, and their number in it."""
    return stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "placed")


def _offsets(placed: DataFrame, value: Column) -> DataFrame:
    """(_part, _before): the sum of `value` over all earlier partitions, a row for each partition."""
    sums = placed.groupBy(F.shiftright("_id", _ROWS).alias("_part")).agg(F.sum(value).alias("_sum"))
    return sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"))


def with_places(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """`rows` with their place from 0 in a total order. Rows that the order ties may take either place."""
    placed = _sorted(rows, order).withColumn("_part", F.shiftright("_id", _ROWS))
    at = F.col("_id").bitwiseAND(F.lit((1 << _ROWS) - 1)) + F.col("_before")
    return placed.join(F.broadcast(_offsets(placed, F.lit(1))), "_part").select(*rows.columns, at.alias(name))


def with_running_total(rows: DataFrame, order: list[Column], value: str, name: str = "offset") -> DataFrame:
    """`rows` with the sum of `value` over all rows before them in a total order."""
    placed = _sorted(rows, order).withColumn("_part", F.shiftright("_id", _ROWS))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_in", inside).join(F.broadcast(_offsets(placed, F.col(value))), "_part").select(*rows.columns, (F.col("_in") + F.col("_before")).alias(name))


def with_average_rank(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """`rows` with the average rank, from 1, of `value` among its key's rows: equal values share one. A null value has no rank."""
    rows = stage(rows, "ranked")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    running = stage(with_running_total(counts, [*map(F.col, keys), F.col(value)], "_n", "_to"), "ranks")
    first = running.groupBy(*keys).agg(F.min("_to").alias("_first"))
    ranks = running.join(first, keys).select(*keys, value, (F.col("_to") - F.col("_first") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, value], "left")


def _bin(value: Column, low: Column, high: Column) -> Column:
    """A bin from 0 to BINS - 1 that never falls as the value grows."""
    share = (value / 2 - low / 2) / F.greatest(high / 2 - low / 2, F.lit(5e-324))  # halves: the difference of two doubles may have no double
    return F.least(F.greatest(F.floor(share * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _logged(value: Column) -> Column:
    """The value on a scale where all magnitudes of doubles are alike: so the first pass tells 1e-300 from 1e-290."""
    return F.signum(value) * F.when(value == 0, 0.0).otherwise(F.log(F.abs(value)) + 746)


def at_ranks(rows: DataFrame, key: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """`ranks` (key, rank, from 0) with `value`, the key's value of that rank; null values count as absent, NaN as the largest.

    The rows are computed once and written as (key, value); every pass reads that, counts in the map tasks and sends at most
    BINS rows for each key and interval.
    """
    number = F.col(value).cast("double")
    clean = stage(rows.filter(F.col(value).isNotNull()).select(*key, F.when(F.isnan(number), float("inf")).otherwise(number).alias("_v"), F.isnan(number).alias("_nan")), "values")
    # Infinities and NaN have no bin of their own width: they stand at the ends and are told apart by count.
    ends = clean.groupBy(*key).agg(F.count_if(F.col("_v") == float("-inf")).alias("_low"), F.count_if((F.col("_v") == float("inf")) & ~F.col("_nan")).alias("_high"), F.count_if(~F.col("_nan")).alias("_n"), F.min(F.when(F.abs("_v") < float("inf"), F.col("_v"))).alias("lo"), F.max(F.when(F.abs("_v") < float("inf"), F.col("_v"))).alias("hi"))
    finite = clean.filter(F.abs("_v") < float("inf")).select(*key, "_v")
    state = ranks.select(*key, "rank").join(ends, key)
    fixed = F.when(F.col("rank") >= F.col("_n"), F.lit(float("nan"))).when(F.col("rank") < F.col("_low"), F.lit(float("-inf"))).when(F.col("rank") >= F.col("_n") - F.col("_high"), F.lit(float("inf")))
    state = stage(state.select(*key, "rank", (F.col("rank") - F.col("_low")).alias("left"), F.coalesce(fixed, F.col("lo")).alias("lo"), F.coalesce(fixed, F.col("hi")).alias("hi")), "selection")
    same = (F.col("lo") == F.col("hi")) | (F.isnan("lo") & F.isnan("hi"))
    found, first = [], True
    while True:
        found.append(state.filter(same).select(*key, "rank", F.col("lo").alias(value)))
        open_ = state.filter(~same)
        n = open_.count()
        if not n:
            unstage(clean)
            return reduce(DataFrame.unionByName, found)
        spans = open_.select(*key, "lo", "hi").distinct()
        spans = F.broadcast(spans) if n <= FEW else spans.hint("merge")
        inside = finite.join(spans, key).filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        bin_ = _bin(_logged(F.col("_v")), _logged(F.col("lo")), _logged(F.col("hi"))) if first else _bin(F.col("_v"), F.col("lo"), F.col("hi"))
        bins = inside.groupBy(*key, "lo", "hi", bin_.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        w = Window.partitionBy(*key, "lo", "hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("_to", F.sum("_n").over(w))
        hit = open_.join(bins, [*key, "lo", "hi"]).filter((F.col("left") < F.col("_to")) & (F.col("left") >= F.col("_to") - F.col("_n")))
        state = stage(hit.select(*key, "rank", (F.col("left") - F.col("_to") + F.col("_n")).alias("left"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")), "selection")
        first = False


def _picked(rows: DataFrame, key: list[str], value: str, ranks: Column) -> tuple[DataFrame, DataFrame]:
    """(counts, values by rank as a map) of each key; `ranks` is an array over `_n`, a key's rows that are not null."""
    counts = stage(rows.groupBy(*key).agg(F.count(value).alias("_n")), "counts")
    wanted = counts.filter("_n > 0").select(*key, F.explode(F.array_distinct(ranks)).alias("rank"))
    values = at_ranks(rows, key, value, wanted)
    return counts, values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", value))).alias("_at"))


def floor_quantiles(rows: DataFrame, key: list[str], value: str, shares: dict[str, float], count: str = "n") -> DataFrame:
    """`count` and, by name, the element int(share (n - 1)) of each key's sorted values; null for a key of nulls."""
    place = {name: F.floor(F.lit(q) * (F.col("_n") - 1)).cast("bigint") for name, q in shares.items()}
    counts, picked = _picked(rows, key, value, F.array(*place.values()))
    return counts.join(picked, key, "left").select(*key, F.col("_n").alias(count), *[F.try_element_at("_at", at).alias(name) for name, at in place.items()])


def percentiles(rows: DataFrame, key: list[str], value: str, shares: dict[str, float], count: str = "n") -> DataFrame:
    """`count` and, by name, the interpolated percentile of each key's values, as SQL's percentile: exact."""
    at = {name: F.lit(q) * (F.col("_n") - 1) for name, q in shares.items()}
    low = {name: F.floor(x).cast("bigint") for name, x in at.items()}
    counts, picked = _picked(rows, key, value, F.array(*[y for x in low.values() for y in (x, F.least(x + 1, F.col("_n") - 1))]))

    def between(name: str) -> Column:
        a, b = F.try_element_at("_at", low[name]), F.try_element_at("_at", F.least(low[name] + 1, F.col("_n") - 1))
        part = at[name] - low[name]
        return F.when(part == 0, a).otherwise((low[name] + 1 - at[name]) * a + part * b).alias(name)

    return counts.join(picked, key, "left").select(*key, F.col("_n").alias(count), *[between(name) for name in shares])
