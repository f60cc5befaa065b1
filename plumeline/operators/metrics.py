"""Robustness metrics over ranks: headline, volatility, paired degradation, rerank fusion and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.functions.vectors import dot
from plumeline.operators.ranking import KS, flip_rate


def rounded(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def volatility(queries: DataFrame, threshold: float = 0.9, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row over all products: mean flip rates among similar query pairs and the spread of reciprocal ranks.

    `queries` has (asin, query_id, rank, vector) with unit vectors. Products with a missing rank or one query are left
    out. Pairs are made inside a product, which has a handful of queries; only their hit bits and vectors are joined.
    """
    w = Window.partitionBy("asin")
    usable = queries.withColumn("_n", F.count("*").over(w)).withColumn("_ranked", F.count("rank").over(w)).filter("_n >= 2 and _n = _ranked")
    one = usable.select("asin", F.col("query_id").alias("i"), F.col("rank").alias("ri"), F.col("vector").alias("vi"))
    other = usable.select("asin", F.col("query_id").alias("j"), F.col("rank").alias("rj"), F.col("vector").alias("vj"))
    pairs = one.join(other, "asin").filter("i < j").filter(dot(F.col("vi"), F.col("vj")) >= threshold)
    flips = pairs.groupBy("asin").agg(*[F.avg(((F.col("ri") <= k) != (F.col("rj") <= k)).cast("double")).alias(f"flip{k}") for k in ks])
    spread = usable.groupBy("asin").agg(F.stddev_pop(1.0 / F.col("rank")).alias("rr_std"))
    per_product = spread.join(flips, "asin", "left")
    return per_product.agg(F.count("*").alias("n_products"), *[rounded(F.avg(f"flip{k}"), f"flip{k}_mean") for k in ks], rounded(F.avg("rr_std"), "rr_std_mean"), rounded(F.percentile("rr_std", F.lit(0.5)), "rr_std_median"), rounded(F.stddev_pop("rr_std"), "rr_std_std"))


def paired_degradation(pairs: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Clean minus noisy, over (rank_clean, rank_noisy) rows: mean and median changes, and how many are hurt or helped."""

    def rr(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), 1.0 / F.col(c)).otherwise(F.lit(0.0))

    def hit(c: str, k: int) -> Column:
        return F.coalesce((F.col(c) <= k).cast("int"), F.lit(0))

    delta = rr("rank_clean") - rr("rank_noisy")
    changes = [rounded(F.avg(hit("rank_clean", k) - hit("rank_noisy", k)), f"hit{k}_drop") for k in ks]
    counts = [F.count_if(delta > 0).alias("n_hurt"), F.count_if(delta < 0).alias("n_helped"), F.count_if(delta == 0).alias("n_same")]
    return pairs.agg(F.count("*").alias("n_pairs"), *changes, rounded(F.avg(delta), "rr_drop_mean"), rounded(F.percentile(delta, F.lit(0.5)), "rr_drop_median"), *counts)


def stage_delta(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on `keys`; differences are null where a side is missing."""
    a = before.select(*keys, *[F.col(v).alias(f"{v}_before") for v in values])
    b = after.select(*keys, *[F.col(v).alias(f"{v}_after") for v in values])
    return a.join(b, keys, "full_outer").select(*keys, *[rounded(F.col(f"{v}_after") - F.col(f"{v}_before"), f"{v}_delta") for v in values])


def fuse(candidates: DataFrame, limit: int = 25, prior_weight: float = 0.1) -> DataFrame:
    """(query_id, doc_id, original_rank, score) -> final score and position: score + 0.1 x rank prior, within the first `limit`."""
    kept = candidates.filter(F.col("original_rank") <= limit)
    n = F.count("*").over(Window.partitionBy("query_id"))
    prior = F.when(n > 1, (n - F.col("original_rank")) / (n - 1)).otherwise(F.lit(1.0))
    fused = kept.withColumn("rank_prior", F.round(prior, 6)).withColumn("final", F.round(F.col("score") + prior_weight * prior, 6))
    return fused.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("final").desc(), "original_rank")))


def rerank_flip(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 25)) -> DataFrame:
    """(asin, rank) rows -> mean flip rates over all query pairs of a product, and the spread of found reciprocal ranks."""
    n = F.count("*")
    per_product = ranks.groupBy("asin").agg(n.alias("n"), *[flip_rate(F.count_if(F.col("rank") <= k), n).alias(f"flip{k}") for k in ks], F.when(F.count("rank") >= 2, F.stddev_pop(1.0 / F.col("rank"))).alias("rr_std")).filter("n >= 2")
    return per_product.agg(F.count("*").alias("n_products"), *[rounded(F.coalesce(F.avg(f"flip{k}"), F.lit(0.0)), f"flip{k}_mean") for k in ks], rounded(F.coalesce(F.avg("rr_std"), F.lit(0.0)), "rr_std_mean"), rounded(F.coalesce(F.percentile("rr_std", F.lit(0.5)), F.lit(0.0)), "rr_std_median"), rounded(F.coalesce(F.stddev_samp("rr_std"), F.lit(0.0)), "rr_std_std"))


def rerank_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 25)) -> DataFrame:
    """(rank, is_candidate) rows, rank null for a miss -> hit rates, mean reciprocal rank, recall of the scored candidates."""
    hits = [rounded(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))), f"hit{k}") for k in ks]
    return ranks.agg(F.count("*").alias("n_queries"), *hits, rounded(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), "mrr"), rounded(F.avg(F.col("is_candidate").cast("int")), "recall_at_candidates"))
