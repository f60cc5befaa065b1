"""Per-user Gaussian style profiles: fit, distances, gates and their audit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.functions.vectors import dot, minus, total
from plumeline.operators import places
from plumeline.operators.places import with_average_rank
from plumeline.sources.staged import stage

#: Chi-squared quantiles with 16 degrees of freedom.
CHI2_16 = {0.95: 26.2962, 0.75: 19.3689, 0.55: 16.0425, 0.35: 13.3096, 0.15: 10.3090, 0.05: 7.9616, 0.005: 5.1422}
PSD_FLOOR, DIAG_FLOOR = 1e-6, 1e-6

FIT_SCHEMA = "user_id string, mu array<double>, lambda double, v array<double>, s array<double>, n long, n_val long, d2_q50 double, d2_q75 double, d2_q95 double, d2_max double"


def moments(vectors: DataFrame) -> DataFrame:
    """(user_id, i, n, mean, var) by dimension of the profile rows, in one aggregation without gathering a user's rows."""
    return vectors.filter("split = 'profile'").select("user_id", F.posexplode("z").alias("i", "x")).groupBy("user_id", "i").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))


def covariance(vectors: DataFrame, dims: int) -> DataFrame:
    """user_id, n, mean vector and upper covariance triangle of the profile rows: sums of products, partially aggregated."""
    rows = vectors.filter("split = 'profile'")
    cells = [F.covar_samp(F.col("z")[i], F.col("z")[j]).alias(f"c{i}_{j}") for i in range(dims) for j in range(i, dims)]
    means = [F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(dims)]
    out = rows.groupBy("user_id").agg(F.count("*").alias("n"), *means, *cells)
    return out.select("user_id", "n", F.array(*[f"m{i}" for i in range(dims)]).alias("mu"), F.array(*[f"c{i}_{j}" for i in range(dims) for j in range(i, dims)]).alias("cov"))


def fit(vectors: DataFrame, dims: int = 16) -> DataFrame:
    """Rank one plus diagonal for every user with at least dims + 2 profile rows, and floor-index quantiles of D2 over the rest.

    The moments are aggregated in Spark; the eigenvectors come from one small matrix for each user, so no user's
    rows meet in a task.
    """

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(dims)
        for pdf in batches:
            out = []
            for user, n, mu, cov in zip(pdf["user_id"], pdf["n"], pdf["mu"], pdf["cov"], strict=True):
                m = np.zeros((dims, dims))
                m[upper] = cov
                m = m + np.triu(m, 1).T
                values, vectors_ = np.linalg.eigh(m)
                lam, v = max(values[-1], PSD_FLOOR), vectors_[:, -1]
                v = v * (1.0 if v[np.abs(v).argmax()] > 0 else -1.0)
                out.append((user, list(mu), float(lam), v.tolist(), np.maximum(np.diag(m) - lam * v * v, DIAG_FLOOR).tolist(), int(n)))
            yield pd.DataFrame(out, columns=["user_id", "mu", "lambda", "v", "s", "n"])

    params = covariance(vectors, dims).filter(F.col("n") >= dims + 2).mapInPandas(decompose, "user_id string, mu array<double>, lambda double, v array<double>, s array<double>, n long")
    val = vectors.filter("split = 'val'").join(params.select("user_id", "mu", "lambda", "v", "s"), "user_id").select("user_id", d2(F.col("z"), F.col("mu"), F.col("lambda"), F.col("v"), F.col("s")).alias("d2"))
    return params.join(floor_quantiles(val, "user_id", "d2"), "user_id", "left")


def floor_quantiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """n_val, d2_q50/75/95 and d2_max: elements int(q (n - 1)) of the sorted values, however many rows a key has."""
    return places.floor_quantiles(rows, [key], value, {**{f"d2_q{round(100 * q)}": q for q in (0.5, 0.75, 0.95)}, "d2_max": 1.0}, "n_val")


def d2(z: Column, mu: Column, lam: Column, v: Column, s: Column) -> Column:
    """Squared distance: the projection on v over lambda, and the residual over the diagonal. Not the exact inverse; see d2_exact."""
    diff = minus(z, mu)
    low = dot(diff, v)
    residual = F.zip_with(F.zip_with(diff, v, lambda x, y: x - low * y), s, lambda r, t: r * r / t)
    return F.greatest(low * low / lam + total(residual), F.lit(0.0))


def d2_exact(z: Column, mu: Column, lam: Column, v: Column, s: Column) -> Column:
    """Mahalanobis distance of lambda v v' + diag(s) by Sherman and Morrison."""
    diff = minus(z, mu)
    scaled = F.zip_with(diff, s, lambda x, t: x / t)
    vs = dot(F.zip_with(v, s, lambda x, t: x / t), v)
    across = dot(scaled, v)
    return F.greatest(dot(scaled, diff) - lam * across * across / (1 + lam * vs), F.lit(0.0))


def log_norm(lam: Column, v: Column, s: Column, dims: int) -> Column:
    """Half of sum ln s + ln(1 + lambda v' S^-1 v) + d ln 2 pi."""
    vs = total(F.zip_with(v, s, lambda x, t: x * x / t))
    return 0.5 * (total(F.transform(s, lambda t: F.log(t))) + F.log(1 + lam * vs) + dims * F.log(2 * F.pi()))


def log_density(distance: Column, norm: Column, legacy: bool = True) -> Column:
    """-0.5 D2 - norm; with `legacy`, the norm is halved a second time, as the scores in use were made."""
    return -0.5 * (distance + norm) if legacy else -0.5 * distance - norm


def score_candidates(candidates: DataFrame, users: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Best user, margin and inside counts of every candidate.

    `candidates` (asin, cand_id, z) meets `users` (asin, user_id, mu, lambda, v, s) on the product; margin is the gap to
    the second-best log density, infinite with a single user.
    """
    pairs = candidates.join(users, "asin")
    distance = d2(F.col("z"), F.col("mu"), F.col("lambda"), F.col("v"), F.col("s"))
    scored = pairs.withColumn("d2", distance).withColumn("logp", log_density(F.col("d2"), log_norm(F.col("lambda"), F.col("v"), F.col("s"), 16)))
    inside = [F.count_if(F.col("d2") <= t).cast("int").alias(f"in_{name}") for name, t in thresholds.items()]
    best = F.max_by(F.struct("user_id", "logp", "d2"), F.struct(F.col("logp"), F.col("user_id")))
    top = F.slice(F.sort_array(F.collect_list("logp"), asc=False), 1, 2)  # a product's fitted users: a handful
    out = scored.groupBy("asin", "cand_id").agg(best.alias("best"), top.alias("top"), *inside)
    margin = F.when(F.size("top") > 1, F.col("top")[0] - F.col("top")[1]).otherwise(F.lit(float("inf")))
    return out.select("asin", "cand_id", "best.user_id", "best.logp", "best.d2", margin.alias("margin"), *[f"in_{name}" for name in thresholds])


def gate(scored: DataFrame, thresholds: dict[str, float], overlap: int = 2, least_margin: float = 0.0) -> DataFrame:
    """(threshold, reason) of every candidate: distance, overlap and margin in that order, `kept` when none drops it.

    Thresholds that `scored` has no inside count for, the observed ones, have no overlap rule.
    """
    options = F.array(*[F.struct(F.lit(name).alias("threshold"), F.lit(t).alias("limit"), (F.col(f"in_{name}") if f"in_{name}" in scored.columns else F.lit(0)).alias("inside")) for name, t in thresholds.items()])
    rows = scored.withColumn("_o", F.explode(options)).withColumns({c: F.col(f"_o.{c}") for c in ("threshold", "limit", "inside")}).drop("_o")
    reason = F.when(F.col("d2") > F.col("limit"), "above_d2").when(F.col("inside") > overlap, "multi_user_inside").when(F.col("margin") < least_margin, "below_margin").otherwise("kept")
    return rows.withColumn("reason", reason)


def calibration(distances: DataFrame, threshold: float = CHI2_16[0.95], coverage: float = 0.8) -> DataFrame:
    """(user_id, d2) -> coverage, median and whether both hold."""
    shares = distances.groupBy("user_id").agg(F.count("*").alias("n_val"), F.avg((F.col("d2") <= threshold).cast("double")).alias("coverage"))
    out = shares.join(places.percentiles(distances, ["user_id"], "d2", {"median_d2": 0.5}).drop("n"), "user_id")
    return out.withColumn("a2_pass", (F.col("coverage") >= coverage) & (F.col("median_d2") <= threshold))


def stability(vectors: DataFrame, dims: int = 16, rounds: int = 20, share: float = 0.8, threshold: float = CHI2_16[0.95]) -> DataFrame:
    """Refits on `rounds` hash-chosen subsamples: fit rate, median Spearman correlation and gate agreement by user.

    Every subsample is a user of its own, (user, round), so the refits are one aggregation over `rounds` x rows.
    """
    full = fit(vectors, dims).select("user_id", "mu", "lambda", "v", "s")
    replicas = vectors.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    chosen = (F.col("split") == "val") | (F.pmod(F.xxhash64(F.lit(42), "round", "vec_id"), F.lit(1000)) < int(1000 * share))
    subs = fit(replicas.filter(chosen).withColumn("user_id", F.concat_ws("#", "user_id", "round")), dims).select("user_id", "mu", "lambda", "v", "s")
    subs = subs.select(F.substring_index("user_id", "#", 1).alias("user_id"), F.substring_index("user_id", "#", -1).alias("round"), *[F.col(c).alias(f"{c}_sub") for c in ("mu", "lambda", "v", "s")])
    rows = vectors.filter("split = 'val'").join(full, "user_id").join(subs, "user_id")
    rows = rows.select("user_id", "round", d2(*map(F.col, ("z", "mu", "lambda", "v", "s"))).alias("a"), d2(*map(F.col, ("z", "mu_sub", "lambda_sub", "v_sub", "s_sub"))).alias("b"))
    rows = stage(rows, "refitted")
    ranked = with_average_rank(with_average_rank(rows, ["user_id", "round"], "a", "ra"), ["user_id", "round"], "b", "rb")
    each = ranked.groupBy("user_id", "round").agg(F.coalesce(F.nanvl(F.corr("ra", "rb"), F.lit(0.0)), F.lit(0.0)).alias("rho"), F.avg(((F.col("a") <= threshold) == (F.col("b") <= threshold)).cast("double")).alias("agree"))
    return each.groupBy("user_id").agg((F.count("*") / rounds).alias("fit_rate"), F.percentile("rho", F.lit(0.5)).alias("rho_median"), F.percentile("agree", F.lit(0.5)).alias("agreement_median"))


def verdict(fits: DataFrame, calibrated: DataFrame, stable: DataFrame, least_val: int = 10, fit_rate: float = 0.9, rho: float = 0.8, agreement: float = 0.8) -> DataFrame:
    """(user_id, a1_pass, a2_pass, a3_pass, valid) of every fitted user.

    A1: lambda and all of s over 0, a finite log-determinant, enough held-out rows, all their distances finite. A2: coverage
    and median. A3: how often subsamples can be fitted, and how they agree. A user without held-out rows or refits fails.
    """
    log_det = F.log(F.greatest(F.col("lambda"), F.lit(1e-30))) + total(F.transform("s", lambda t: F.log(F.greatest(t, F.lit(1e-30)))))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    a1 = (F.col("lambda") > 0) & F.forall("s", lambda t: t > 0) & finite(log_det) & (F.coalesce("n_val", F.lit(0)) >= least_val) & (F.col("d2_max").isNull() | finite(F.col("d2_max")))
    a3 = (F.col("fit_rate") >= fit_rate) & (F.col("rho_median") >= rho) & (F.col("agreement_median") >= agreement)
    rows = fits.join(calibrated.select("user_id", "coverage", "median_d2", "a2_pass"), "user_id", "left").join(stable, "user_id", "left")
    rows = rows.withColumns({"a1_pass": F.coalesce(a1, F.lit(False)), "a2_pass": F.coalesce("a2_pass", F.lit(False)), "a3_pass": F.coalesce(a3, F.lit(False))})
    return rows.withColumn("valid", F.col("a1_pass") & F.col("a2_pass") & F.col("a3_pass"))


def audit_summary(verdicts: DataFrame) -> DataFrame:
    """One row: how many users pass or fail each rule, and percentiles of the finite coverages, medians and agreements."""
    shares = {"coverage": (0.25, 0.5, 0.75), "median_d2": (0.25, 0.5, 0.9), "fit_rate": (0.1, 0.5, 0.9), "rho_median": (0.1, 0.5, 0.9), "agreement_median": (0.1, 0.5, 0.9)}
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    verdicts = stage(verdicts, "verdicts")
    counts = [F.count("*").alias("n_users"), F.count_if("valid").alias("n_valid"), *[F.count_if(~F.col(f"{a}_pass")).alias(f"fail_{a}") for a in ("a1", "a2", "a3")]]
    figures = verdicts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), finite(c).cast("double").alias("value")) for c in shares])).alias("f")).select("f.*")
    every = sorted({q for qs in shares.values() for q in qs})
    found = places.percentiles(figures, ["name"], "value", {f"p{round(100 * q)}": q for q in every})  # a row for each figure
    wide = found.agg(*[F.max(F.when(F.col("name") == c, F.col(f"p{round(100 * q)}"))).alias(f"{c}_p{round(100 * q)}") for c, qs in shares.items() for q in qs])
    return verdicts.agg(*counts).crossJoin(wide)  # one row beside one row


def observed_thresholds(scored: DataFrame, shares: tuple[float, ...]) -> dict[str, float]:
    """Interpolated percentiles of the candidates' best distances, by name: one number for each share."""
    row = places.percentiles(scored.select(F.lit(0).alias("all"), "d2"), ["all"], "d2", {f"obs{round(100 * q)}": q for q in shares}).drop("all", "n").first()
    return {k: v for k, v in row.asDict().items() if v is not None}


def kept_users(gated: DataFrame) -> DataFrame:
    """By threshold: kept candidates and their users' picks, products, products with at least 1, 2, 3 and 5 kept users, and drops by reason."""
    kept = gated.filter("reason = 'kept'").groupBy("threshold", "asin").agg(F.countDistinct("user_id").alias("users"))
    products = kept.groupBy("threshold").agg(F.sum("users").alias("n_kept"), *[F.count_if(F.col("users") >= k).alias(f"asins_ge{k}") for k in (1, 2, 3, 5)])
    drops = gated.groupBy("threshold").agg(*[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("above_d2", "multi_user_inside", "below_margin")])
    return drops.join(products, "threshold", "left").fillna(0)


def prototype_ranks(rows: DataFrame) -> DataFrame:
    """Held-out rows ranked against their product's users: how many other users' prototypes score as high as the own one.

    `rows` (vec_id, asin, user_id, split, z). A prototype is the unit mean of a pair's profile rows; ties count against the row.
    """
    mean = rows.filter("split = 'profile'").select("asin", "user_id", F.posexplode("z").alias("i", "x")).groupBy("asin", "user_id", "i").agg(F.avg("x").alias("m"))
    proto = mean.groupBy("asin", "user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("proto"))
    proto = proto.withColumn("proto", F.transform("proto", lambda x: x / F.sqrt(dot(F.col("proto"), F.col("proto")))))
    peers = proto.groupBy("asin").agg(F.collect_list(F.struct(F.col("user_id").alias("peer"), "proto")).alias("peers"))  # a product's fitted users
    own = rows.filter("split = 'val'").join(proto, ["asin", "user_id"]).join(peers, "asin")
    score = F.round(dot(F.col("z"), F.col("proto")), 9)
    rank = F.size(F.filter("peers", lambda p: (p["peer"] != F.col("user_id")) & (F.round(dot(F.col("z"), p["proto"]), 9) >= score)))
    return own.select("vec_id", "asin", "user_id", rank.alias("rank"))


def select_pairs(candidates: DataFrame, users: DataFrame, threshold: float = CHI2_16[0.95], least_margin: float = 0.0) -> DataFrame:
    """For each product the most distant pair of users for whom both can be served, and the text chosen for each.

    `candidates` (asin, cand_id, text, z), `users` (asin, user_id, mu, lambda, v, s). Within a pair, a candidate is one
    user's if it lies in their region by exact distance, not in the other's, and their density is higher by the margin. A
    pair is feasible if both users have a candidate, with different texts; each takes the one of highest density.
    """
    p = candidates.join(users, "asin")
    exact = d2_exact(*map(F.col, ("z", "mu", "lambda", "v", "s")))
    scored = p.select("asin", "cand_id", "text", "user_id", exact.alias("d2"), log_norm(F.col("lambda"), F.col("v"), F.col("s"), 16).alias("_n")).withColumn("logp", log_density(F.col("d2"), F.col("_n"), legacy=False)).drop("_n")
    one, two = (scored.select("asin", "cand_id", "text", *[F.col(c).alias(f"{c}{k}") for c in ("user_id", "d2", "logp")]) for k in (1, 2))
    both = one.join(two.drop("text"), ["asin", "cand_id"]).filter("user_id1 <> user_id2")
    own = both.filter((F.col("d21") <= threshold) & (F.col("d22") > threshold) & (F.col("logp1") - F.col("logp2") >= least_margin))
    order = F.struct(F.round("logp1", 9), -F.col("cand_id"))
    best = own.groupBy("asin", "user_id1", "user_id2").agg(F.max_by(F.struct("cand_id", "text", F.col("logp1").alias("logp"), F.col("d21").alias("d2"), (F.col("logp1") - F.col("logp2")).alias("margin")), order).alias("pick"))
    pairs = best.filter("user_id1 < user_id2").select("asin", F.col("user_id1").alias("u1"), F.col("user_id2").alias("u2"), F.col("pick").alias("p1"))
    back = best.filter("user_id1 > user_id2").select("asin", F.col("user_id2").alias("u1"), F.col("user_id1").alias("u2"), F.col("pick").alias("p2"))
    feasible = pairs.join(back, ["asin", "u1", "u2"]).filter("p1.text <> p2.text")
    distances = pair_distances(users.select("asin", "user_id", "mu", "s"))
    w = Window.partitionBy("asin").orderBy(F.col("distance").desc(), "u1", "u2")
    return feasible.join(distances, ["asin", "u1", "u2"]).withColumn("_p", F.row_number().over(w)).filter("_p = 1").drop("_p")


def pair_distances(users: DataFrame) -> DataFrame:
    """(asin, u1, u2, distance): Bhattacharyya distances of the diagonal Gaussians of a product's fitted users."""
    a = users.select("asin", F.col("user_id").alias("u1"), F.col("mu").alias("m1"), F.col("s").alias("s1"))
    b = users.select("asin", F.col("user_id").alias("u2"), F.col("mu").alias("m2"), F.col("s").alias("s2"))
    mean = F.zip_with("s1", "s2", lambda x, y: (x + y) / 2)
    apart = total(F.zip_with(F.zip_with("m1", "m2", lambda x, y: (x - y) * (x - y)), mean, lambda q, t: q / t)) / 8
    shape = 0.5 * total(F.zip_with(mean, F.zip_with("s1", "s2", lambda x, y: F.sqrt(x * y)), lambda t, g: F.log(t / g)))
    return a.join(b, "asin").filter("u1 < u2").select("asin", "u1", "u2", F.round(apart + shape, 6).alias("distance"))


def most_distant_pairs(users: DataFrame) -> DataFrame:
    """For each product, the pair of users whose diagonal Gaussians have the largest Bhattacharyya distance.

    `users` (asin, user_id, mu, s). Pairs are made inside a product, of its fitted users only.
    """
    order = Window.partitionBy("asin").orderBy(F.col("distance").desc(), "u1", "u2")
    return pair_distances(users).withColumn("_p", F.row_number().over(order)).filter("_p = 1").drop("_p")
