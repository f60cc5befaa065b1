"""Low-rank-plus-diagonal Gaussians of any rank against whole matrices."""

import numpy as np
import pytest

from plumeline.operators import low_rank as L


def matrix(lam, v, s):
    return np.diag(s) + (np.array(v).T * lam) @ np.array(v)


@pytest.mark.parametrize("k", [1, 3])
def test_fit_density_and_distances(spark, k):
    rng = np.random.default_rng(k)
    rows = [(f"u{u}", "profile" if i % 5 else "val", (rng.standard_normal(4) * [3, 2, 1, 0.5] + u).tolist()) for u in range(3) for i in range(40)] + [("few", "profile", [1.0, 2.0, 3.0, 4.0])] * (4 + k)
    v = spark.createDataFrame(rows, "user_id string, split string, z array<double>")
    fits = {r.user_id: r for r in L.fit_rank(v, 4, k).collect()}
    assert set(fits) == {"u0", "u1", "u2"}
    whole = {u: matrix(r.lambdas, r.v, r.s) for u, r in fits.items()}
    for u, r in fits.items():
        x = np.array([z for user, split, z in rows if user == u and split == "profile"])
        cov = np.cov(x.T)
        values = np.linalg.eigvalsh(cov)[::-1]
        assert np.allclose(r.lambdas, values[:k]) and np.allclose(np.diag(whole[u]), np.maximum(np.diag(cov), np.diag(cov))) and r.n == len(x)
    scored = L.with_density(v.filter("split = 'val'").join(L.fit_rank(v, 4, k), "user_id")).collect()
    projected = L.with_density(v.filter("split = 'val'").join(L.fit_rank(v, 4, k), "user_id"), exact=False).collect()
    for r in scored:
        d = np.array(r.z) - fits[r.user_id].mu
        assert r.d2 == pytest.approx(d @ np.linalg.solve(whole[r.user_id], d))
        assert r.logp == pytest.approx(-0.5 * (r.d2 + np.linalg.slogdet(whole[r.user_id])[1] + 4 * np.log(2 * np.pi)))
    for r in projected:
        d, f = np.array(r.z) - fits[r.user_id].mu, fits[r.user_id]
        low = np.array(f.v) @ d
        assert r.d2 == pytest.approx((low**2 / f.lambdas).sum() + ((d - low @ np.array(f.v)) ** 2 / f.s).sum())
    users = L.fit_rank(v, 4, k).selectExpr("'A' AS asin", "user_id", "mu", "lambdas", "v", "s")
    for r in L.pair_distances_exact(users).collect():
        mean, d = (whole[r.u1] + whole[r.u2]) / 2, np.array(fits[r.u1].mu) - fits[r.u2].mu
        dets = [np.linalg.slogdet(m)[1] for m in (mean, whole[r.u1], whole[r.u2])]
        assert r.distance == pytest.approx(d @ np.linalg.solve(mean, d) / 8 + 0.5 * (dets[0] - (dets[1] + dets[2]) / 2), abs=2e-6)
    best = L.most_distant_exact(users)
    assert L.require_products(best, 1).count() == 1
    with pytest.raises(Exception, match="2 products expected, got 1"):
        L.require_products(best, 2).collect()
    assert L.pair_distances_exact(users.limit(0)).count() == 0 == L.with_density(v.limit(0).join(L.fit_rank(v, 4, k), "user_id")).count()
