"""Error profiles: smoothed probabilities by user and context, lifts, hierarchical rates."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.functions.noise import MECHANISMS
from plumeline.operators.blocked import cosine_scores, score_histogram
from plumeline.operators.places import with_places
from plumeline.sources.staged import stage

#: The signature levels at which misspellings are remembered: full, d3 and coarse.
HISTORY_LEVELS = (0, 2, 6)


def context_profile(records: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(user_id, ctx, err) rows, read once -> c, p_user = (c + a) / (sum + a n_e), p_global and lift = ln(p_user / p_global)."""
    counts = stage(records.groupBy("user_id", "ctx", "err").agg(F.count("*").alias("c")), "profile-counts")  # read three times and more
    overall = counts.groupBy("ctx", "err").agg(F.sum("c").alias("g"))
    kinds = overall.agg(F.countDistinct("err").alias("n_e"))  # one row
    p_global = (F.col("g") + alpha) / (F.sum("g").over(Window.partitionBy("ctx")) + alpha * F.col("n_e"))
    overall = overall.crossJoin(F.broadcast(kinds)).withColumn("p_global", p_global).select("ctx", "err", "n_e", "p_global")
    p_user = (F.col("c") + alpha) / (F.sum("c").over(Window.partitionBy("user_id", "ctx")) + alpha * F.col("n_e"))
    return counts.join(overall, ["ctx", "err"]).withColumn("p_user", p_user).withColumn("lift", F.log(F.col("p_user") / F.col("p_global"))).select("user_id", "ctx", "err", "c", "p_user", "p_global", "lift")


def lift_cosine(profile: DataFrame) -> DataFrame:
    """Cosine of users' lift vectors by a join on their coordinates; users without a common coordinate are left out."""
    norms = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("lift") * F.col("lift"))).alias("n"))
    a = profile.select(F.col("user_id").alias("u1"), "ctx", "err", F.col("lift").alias("l1"))
    b = profile.select(F.col("user_id").alias("u2"), "ctx", "err", F.col("lift").alias("l2"))
    dots = a.join(b, ["ctx", "err"]).filter("u1 < u2").groupBy("u1", "u2").agg(F.sum(F.col("l1") * F.col("l2")).alias("d"))
    return dots.join(norms.toDF("u1", "n1"), "u1").join(norms.toDF("u2", "n2"), "u2").select("u1", "u2", (F.col("d") / (F.col("n1") * F.col("n2"))).alias("cosine"))


def cosine_summary(profile: DataFrame) -> DataFrame:
    """(n_users, mean, median, std) of the cosines of all pairs of users' lift vectors; null under two users.

    Mean and population deviation follow from the sum of the unit vectors and of their products, a matrix as wide as there are
    coordinates; the median from a histogram of the cosines in millionths. A missing coordinate is 0, a zero vector's cosines are 0.
    """
    coordinates = [(r.ctx, r.err) for r in profile.select("ctx", "err").distinct().orderBy("ctx", "err").collect()]  # contexts x kinds of errors
    cells = [F.coalesce(F.sum(F.when((F.col("ctx") == c) & (F.col("err") == e), F.col("lift"))), F.lit(0.0)) for c, e in coordinates]
    users = stage(with_places(profile.groupBy("user_id").agg(F.array(*cells).alias("v")), [F.col("user_id")], "id"), "users")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = users.withColumn("_n", norm).select(F.transform("v", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)).alias("u"))
    d = range(len(coordinates))
    sums = unit.agg(F.count("*").alias("n"), F.count_if(F.exists("u", lambda x: x != 0)).alias("own"), *[F.sum(F.col("u")[i]).alias(f"s{i}") for i in d], *[F.sum(F.col("u")[i] * F.col("u")[j]).alias(f"p{i}_{j}") for i in d for j in d if j >= i])
    pairs = F.col("n") * (F.col("n") - 1)
    total = reduce(add, [F.col(f"s{i}") * F.col(f"s{i}") for i in d], F.lit(0.0)) - F.col("own")
    squares = reduce(add, [F.col(f"p{i}_{j}") * F.col(f"p{i}_{j}") * (1 if i == j else 2) for i in d for j in d if j >= i], F.lit(0.0)) - F.col("own")
    mean = total / F.when(pairs > 0, pairs)
    moments = sums.select(F.col("n").alias("n_users"), mean.alias("mean"), F.sqrt(F.greatest(squares / F.when(pairs > 0, pairs) - mean * mean, F.lit(0.0))).alias("std"))
    bins = score_histogram(users.select("id", "v"), cosine_scores)
    running = bins.withColumn("_to", F.sum("n").over(Window.orderBy("micro").rowsBetween(Window.unboundedPreceding, 0)))  # at most two million bins
    count = bins.agg(F.sum("n").alias("_pairs"))
    middle = running.crossJoin(F.broadcast(count)).filter(((F.col("_to") > F.floor((F.col("_pairs") - 1) / 2)) & (F.col("_to") - F.col("n") <= F.floor((F.col("_pairs") - 1) / 2))) | ((F.col("_to") > F.floor(F.col("_pairs") / 2)) & (F.col("_to") - F.col("n") <= F.floor(F.col("_pairs") / 2))))
    return moments.crossJoin(middle.agg((F.avg("micro") / 1_000_000).alias("median"))).select("n_users", "mean", "median", "std")


def error_model(signed: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(user_id, level, sig, mech or null) rows, one for each word and level or counted in `n` -> totals, errors by kind and both rates, (n + a) / (total + 2 a)."""
    n = _weight(signed)
    total, errors, letters = F.sum(n), F.sum(F.when(F.col("mech").isNotNull(), n).otherwise(0)), F.sum(F.when(F.col("mech").isin(*MECHANISMS), n).otherwise(0))
    rate = lambda n: (n + alpha) / (total + 2 * alpha)
    return signed.groupBy("user_id", "level", "sig").agg(total.alias("total"), errors.alias("errors"), letters.alias("char_level"), (errors - letters).alias("surface"), rate(errors).alias("rate"), rate(letters).alias("char_rate"))


def mechanism_histogram(signed: DataFrame) -> DataFrame:
    """(user_id, level, sig, mech) counts of the words that are errors."""
    return signed.filter("mech is not null").groupBy("user_id", "level", "sig", "mech").agg(F.sum(_weight(signed)).alias("n"))


def _weight(signed: DataFrame) -> Column:
    return F.col("n") if "n" in signed.columns else F.lit(1).cast("bigint")


def user_totals(model: DataFrame) -> DataFrame:
    """(user_id, n_tokens, n_edits, n_char, p_err, p_char) over all levels."""
    t = model.groupBy("user_id").agg(F.sum("total").alias("n_tokens"), F.sum("errors").alias("n_edits"), F.sum("char_level").alias("n_char"))
    return t.withColumns({"p_err": F.col("n_edits") / F.col("n_tokens"), "p_char": F.col("n_char") / F.col("n_tokens")})


def mechanism_weights(histogram: DataFrame) -> DataFrame:
    """(user_id, weights): how often each letter mechanism occurs, in the order of MECHANISMS."""
    counts = [F.coalesce(F.sum(F.when(F.col("mech") == m, F.col("n"))), F.lit(0)) for m in MECHANISMS]
    return histogram.groupBy("user_id").agg(F.array(*counts).alias("weights"))


def typo_history(signed: DataFrame) -> DataFrame:
    """(user_id, word, level, sig, typo, mech, n): letter misspellings of lower-case words at the levels full, d3 and coarse."""
    kept = signed.filter(F.col("mech").isin(*MECHANISMS) & F.col("level").isin(*HISTORY_LEVELS) & (F.col("typo") != ""))
    return kept.groupBy("user_id", F.lower("word").alias("word"), "level", "sig", "typo", "mech").agg(F.count("*").alias("n"))


def history_form(asked: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """The user's commonest misspelling of a word in its finest known context: full, d3, coarse, then any.

    `asked` (keys, user_id, word, sigs: all seven) -> keys, typo, mech and source of those that have one.
    """
    h = history.withColumnsRenamed({"word": "_word"})
    joined = asked.join(h, (asked["user_id"] == h["user_id"]) & (F.lower(asked["word"]) == h["_word"]))
    tier = F.lit(len(HISTORY_LEVELS))
    for k, level in reversed(list(enumerate(HISTORY_LEVELS))):
        tier = F.when((F.col("level") == level) & (F.col("sig") == F.col("sigs")[level]), k).otherwise(tier)
    rows = joined.withColumn("_tier", tier)
    best = F.min_by(F.struct("typo", "mech", "_tier"), F.struct("_tier", -F.col("n"), "typo", "mech"))
    names = F.array(*[F.lit(f"user_historical_{x}") for x in ("full", "d3", "coarse", "any")])
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.typo", "b.mech", names[F.col("b._tier")].alias("source"))


def hierarchical_rate(asked: DataFrame, rates: DataFrame, keys: list[str], rate: str = "rate") -> DataFrame:
    """The rate of the finest level known, null for none. `asked` (keys, user_id, sigs: finest first)."""
    wide = asked.select(*keys, "user_id", F.posexplode("sigs").alias("level", "sig"))
    found = wide.join(rates.select("user_id", "level", "sig", F.col(rate).alias("rate")), ["user_id", "level", "sig"]).groupBy(*keys).agg(F.min_by(F.struct("level", "rate"), "level").alias("m"))
    return asked.select(*keys).join(found, keys, "left").select(*keys, "m.level", "m.rate")
