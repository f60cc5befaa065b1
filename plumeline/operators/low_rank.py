"""Gaussians of covariance V diag(lambda) V' + diag(s) with any number of directions, by identities that never form the matrix.

Rows come as arrays: `lambdas` (k), `v` (k directions of as many numbers as there are dimensions) and `s`. Inverses and
determinants go through a k x k matrix for each row (Woodbury and the determinant lemma), for a whole Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeline.operators.gaussian import DIAG_FLOOR, PSD_FLOOR, covariance


def fit_rank(vectors: DataFrame, dims: int = 16, k: int = 1) -> DataFrame:
    """(user_id, mu, lambdas, v, s, n) of every user with at least dims + k + 1 profile rows: the k largest eigenpairs of the
    covariance, floored, and what they leave of its diagonal. A direction's largest number by magnitude is positive."""
    upper = np.triu_indices(dims)

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for user, n, mu, cov in zip(pdf["user_id"], pdf["n"], pdf["mu"], pdf["cov"], strict=True):
                m = np.zeros((dims, dims))
                m[upper] = cov
                m = m + np.triu(m, 1).T
                values, axes = np.linalg.eigh(m)
                lam, v = np.maximum(values[::-1][:k], PSD_FLOOR), axes[:, ::-1][:, :k].T
                v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] > 0, 1.0, -1.0)[:, None]
                out.append((user, list(mu), lam.tolist(), v.tolist(), np.maximum(np.diag(m) - (lam[:, None] * v * v).sum(axis=0), DIAG_FLOOR).tolist(), int(n)))
            yield pd.DataFrame(out, columns=["user_id", "mu", "lambdas", "v", "s", "n"])

    schema = "user_id string, mu array<double>, lambdas array<double>, v array<array<double>>, s array<double>, n long"
    return covariance(vectors, dims).filter(F.col("n") >= dims + k + 1).mapInPandas(decompose, schema)


def woodbury(diff: np.ndarray, lam: np.ndarray, v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared Mahalanobis distances, log determinants) of rows: diff (n, d), lam (n, k), v (n, k, d), s (n, d)."""
    scaled = v / s[:, None, :]
    inner = np.einsum("nkd,njd->nkj", scaled, v)
    small = inner + np.einsum("nk,kj->nkj", 1 / lam, np.eye(lam.shape[1]))
    across = np.einsum("nkd,nd->nk", scaled, diff)
    solved = np.linalg.solve(small, across[:, :, None])[:, :, 0]
    d2 = (diff * diff / s).sum(axis=1) - (across * solved).sum(axis=1)
    return np.maximum(d2, 0.0), np.log(s).sum(axis=1) + np.log(lam).sum(axis=1) + np.linalg.slogdet(small)[1]


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array([np.stack(x) if isinstance(x[0], np.ndarray) else x for x in column], float)


def with_density(rows: DataFrame, exact: bool = True) -> DataFrame:
    """`rows` (z, mu, lambdas, v, s) with d2 and logp, the exact log density; with `exact` false d2 is the projection form, which adds the
    directions' own distances to that of the residual. All rows have as many directions."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], "d2 double", "logp double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            lam, v, s = (_stacked(pdf[c]) for c in ("lambdas", "v", "s"))
            diff = _stacked(pdf["z"]) - _stacked(pdf["mu"])
            d2, log_det = woodbury(diff, lam, v, s)
            if not exact:
                low = np.einsum("nkd,nd->nk", v, diff)
                d2 = (low * low / lam).sum(axis=1) + ((diff - np.einsum("nk,nkd->nd", low, v)) ** 2 / s).sum(axis=1)
            yield pdf.assign(d2=d2, logp=-0.5 * (d2 + log_det + s.shape[1] * np.log(2 * np.pi)))

    return rows.mapInPandas(run, schema)


def pair_distances_exact(users: DataFrame) -> DataFrame:
    """(asin, u1, u2, distance): Bhattacharyya distances of the whole covariances of a product's fitted users (asin, user_id, mu, lambdas, v, s).

    The mean of two covariances has both users' directions, at half their weight, over the mean of their diagonals. A distance that
    is not finite is an error.
    """
    one, two = (users.select("asin", *[F.col(c).alias(f"{c}{i}") for c in ("user_id", "mu", "lambdas", "v", "s")]) for i in (1, 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            lam, v, s, mu = ([_stacked(pdf[f"{c}{i}"]) for i in (1, 2)] for c in ("lambdas", "v", "s", "mu"))
            apart, middle = woodbury(mu[0] - mu[1], np.concatenate(lam, axis=1) / 2, np.concatenate(v, axis=1), (s[0] + s[1]) / 2)
            each = [woodbury(np.zeros_like(mu[0]), lam[i], v[i], s[i])[1] for i in (0, 1)]
            distance = apart / 8 + 0.5 * (middle - (each[0] + each[1]) / 2)
            if not np.isfinite(distance).all():
                raise ValueError(f"the distance of users of product {pdf['asin'][~np.isfinite(distance)].iat[0]} is not finite")
            yield pd.DataFrame({"asin": pdf["asin"], "u1": pdf["user_id1"], "u2": pdf["user_id2"], "distance": distance})

    pairs = one.join(two, "asin").filter("user_id1 < user_id2")
    return pairs.mapInPandas(run, "asin string, u1 string, u2 string, distance double").withColumn("distance", F.round("distance", 6))


def most_distant_exact(users: DataFrame) -> DataFrame:
    """For each product the pair of users farthest apart, by the whole covariances."""
    order = Window.partitionBy("asin").orderBy(F.col("distance").desc(), "u1", "u2")  # the pairs of a product's fitted users
    return pair_distances_exact(users).withColumn("_p", F.row_number().over(order)).filter("_p = 1").drop("_p")


def require_products(selected: DataFrame, expected: int) -> DataFrame:
    """`selected` (asin, ...); a number of products other than the one expected is an error, before anything is written."""
    found = selected.agg(F.countDistinct("asin").alias("_n"))  # one row
    message = F.concat(F.lit(f"{expected} products expected, got "), "_n")
    fine = F.when(F.col("_n") == expected, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return selected.crossJoin(F.broadcast(found.select(fine.alias("_fine")))).filter("_fine").drop("_fine")
