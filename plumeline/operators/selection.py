"""Who and what takes part: eligibility rules, cohorts, asserted joins. An assertion fails the job when its rows are computed."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.operators.places import with_places


def gaussian_eligible(vectors: DataFrame, trained: DataFrame, least_profile: int, least_val: int) -> DataFrame:
    """(user_id, n_profile, n_val) of users with enough rows of both splits who are in `trained` (user_id)."""
    n = vectors.groupBy("user_id").agg(F.count_if(F.col("split") == "profile").alias("n_profile"), F.count_if(F.col("split") == "val").alias("n_val"))
    return n.filter((F.col("n_profile") >= least_profile) & (F.col("n_val") >= least_val)).join(trained.select("user_id"), "user_id", "left_semi")


def top_users(rows: DataFrame, k: int) -> DataFrame:
    """The k users of each product with the largest n, then by id."""
    w = Window.partitionBy("asin").orderBy(F.col("n").desc(), "user_id")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def modelling_users(counts: DataFrame, least: int = 30, seed: int = 42) -> DataFrame:
    """(user_id, n, place): users with enough sentences in hash order; the order is by digest, so a user's place moves only with new users."""
    kept = counts.filter(F.col("n") >= least)
    return with_places(kept, [F.sha2(F.concat_ws("|", F.lit(seed), "user_id"), 256)]).withColumn("place", F.col("place").cast("int"))


def first_sentences(sentences: DataFrame, users: DataFrame, least: int = 30, first: int = 50) -> DataFrame:
    """The first `first` sentences in file order of those `users` (user_id) who have at least `least`."""
    chosen = sentences.join(users.select("user_id").distinct(), "user_id", "left_semi")
    enough = chosen.groupBy("user_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("user_id")
    w = Window.partitionBy("user_id").orderBy("review_pos", "sent_pos")
    return chosen.join(enough, "user_id", "left_semi").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= first)


def pool_products(cohort: DataFrame, attrs: DataFrame, valid: DataFrame, training: DataFrame, least_users: int = 2, least_attrs: int = 5) -> DataFrame:
    """(asin, n_users): products of the gate's cohort (asin, user_id) with enough attributes (asin, n) and an audited user, not in `training`.

    A product of the cohort with fewer than `least_users` users is an error.
    """
    users = cohort.groupBy("asin").agg(F.countDistinct("user_id").alias("n_users"))
    message = F.concat(F.lit("too few users of product "), "asin")
    users = users.select("asin", F.when(F.col("n_users") >= least_users, F.col("n_users")).otherwise(F.raise_error(message).cast("bigint")).alias("n_users"))
    audited = cohort.join(valid.select("user_id"), "user_id", "left_semi").select("asin")
    return users.join(attrs.filter(F.col("n") >= least_attrs).select("asin"), "asin", "left_semi").join(audited, "asin", "left_semi").join(training.select("asin"), "asin", "left_anti")


def held_out_products(attrs: DataFrame, excluded: DataFrame, n: int = 10, least_attrs: int = 5, seed: int = 42) -> DataFrame:
    """n products in hash order with enough attributes that are not excluded."""
    rest = attrs.filter(F.col("n") >= least_attrs).join(excluded.select("asin"), "asin", "left_anti")
    return rest.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "asin"), 256)).limit(n)


def by_density(products: DataFrame, seed: int = 42) -> DataFrame:
    """Products with their place by falling n, those of equal n in hash order."""
    placed = with_places(products, [F.col("n").desc(), F.sha2(F.concat_ws("|", F.lit(seed), "asin"), 256)])
    return placed.withColumn("place", (F.col("place") + 1).cast("int"))


def covered(pool: DataFrame, fitted: DataFrame) -> DataFrame:
    """`pool` (asin, ...); a product without a fitted user (asin, user_id) is an error."""
    marked = pool.join(fitted.select("asin").distinct().withColumn("_known", F.lit(True)), "asin", "left")
    known = F.coalesce("_known", F.raise_error(F.concat(F.lit("no fitted user of product "), "asin")).cast("boolean"))
    return marked.filter(known).drop("_known")


def _matches(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with `_n`, how many rows of `table` have their keys, and `_row`, one of them."""
    values = [c for c in table.columns if c not in keys]
    found = table.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(F.lit(True).alias("_there"), *values)).alias("_row"))
    return rows.join(found, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))


def joined_one_to_one(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the one row of `table` that has its keys; none, or more than one, is an error."""
    values = [c for c in table.columns if c not in keys]
    m = _matches(rows, table, keys)
    message = F.concat(F.col("_n"), F.lit(" rows for "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    one = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return m.filter(one).select(*rows.columns, *[F.col(f"_row.{v}").alias(v) for v in values])


def unmatched(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, missing, ambiguous): how a one-to-one join would fail, as counts."""
    return _matches(rows, table, keys).agg(F.count("*").alias("rows"), F.count_if(F.col("_n") == 0).alias("missing"), F.count_if(F.col("_n") > 1).alias("ambiguous"))


def key_differences(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """(only_first, only_second): how many distinct keys one side has alone; both 0 where the sets are equal."""
    a, b = one.select(*keys).distinct().withColumn("_a", F.lit(True)), other.select(*keys).distinct().withColumn("_b", F.lit(True))
    same = reduce(and_, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    both = a.alias("x").join(b.alias("y"), same, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))


def require_equal_keys(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """`one`; a key that only one side has is an error."""
    d = key_differences(one, other, keys)  # one row
    message = F.concat(F.lit("keys differ: "), "only_first", F.lit(" and "), "only_second")
    fine = F.when((F.col("only_first") == 0) & (F.col("only_second") == 0), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return one.crossJoin(F.broadcast(d.select(fine.alias("_fine")))).filter("_fine").drop("_fine")


def current_candidates(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates (asin, local_idx, text) whose text is what the pool holds at that place; a stale or repeated one is an error."""
    texts = pool.select("asin", "local_idx", F.trim("text").alias("_text"))
    joined = candidates.join(texts, ["asin", "local_idx"], "left").withColumn("_times", F.count("*").over(Window.partitionBy("asin", "local_idx")))
    message = F.concat(F.lit("stale candidate "), "asin", F.lit("/"), "local_idx")
    fine = F.coalesce((F.trim("text") == F.col("_text")) & (F.col("_times") == 1), F.lit(False))
    return joined.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_text", "_times")


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def with_clean_rows(noisy: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """The noisy rows and, for selected cells without one, their clean rows."""
    rest = selected.join(noisy.select(*keys).distinct(), keys, "left_anti")
    return noisy.unionByName(rest.select(*[F.col(c) if c in rest.columns else F.lit(None).alias(c) for c in noisy.columns]))
