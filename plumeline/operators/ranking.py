"""Ranks and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 20)


def hit_columns(rank: Column, ks: tuple[int, ...] = KS, round_to: int | None = 6) -> list[Column]:
    """Reciprocal rank and hits at k; a null or negative rank is a miss."""
    found = rank.isNotNull() & (rank >= 1)
    rr = F.when(found, 1.0 / rank).otherwise(F.lit(0.0))
    return [(F.round(rr, round_to) if round_to else rr).alias("rr"), *[F.coalesce((found & (rank <= k)).cast("int"), F.lit(0)).alias(f"hit{k}") for k in ks]]


def flip_rate(hits: Column, n: Column) -> Column:
    """Share of the pairs of n queries of which one hits and one misses: a closed form, no pair is made."""
    return 2 * hits * (n - hits) / (n * (n - 1))


def average_rank(partition: list[str], order: Column) -> Column:
    """Ranks from 1, ties sharing their mean."""
    w = Window.partitionBy(*partition)
    ties = F.count("*").over(w.orderBy(order).rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w.orderBy(order)) + (ties - 1) / 2


def kendall_and_spearman(rows: DataFrame, query: str, one: str, other: str) -> DataFrame:
    """Kendall's tau-a and Spearman's rho of two rankings of each query's candidates (lists of bounded length)."""
    lists = rows.groupBy(query).agg(F.collect_list(F.struct(F.col(one).cast("double").alias("x"), F.col(other).cast("double").alias("y"))).alias("c"), F.corr(one, other).alias("rho"))
    n = F.size("c")
    signs = F.aggregate("c", F.lit(0.0), lambda a, p: a + F.aggregate("c", F.lit(0.0), lambda b, q: b + F.signum((p["x"] - q["x"]) * (p["y"] - q["y"]))))
    tau = F.when(n > 1, signs / (n * (n - 1))).otherwise(F.lit(0.0))
    return lists.select(query, n.cast("long").alias("n"), tau.alias("tau"), F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)).alias("rho"))
