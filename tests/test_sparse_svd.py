"""Truncated SVD of a sparse table against NumPy, and projections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumeline.operators import sparse_svd
from plumeline.plans import style


def entries(spark, x, parts=6):
    rows, cols = np.nonzero(x)
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(rows, cols, strict=True)], "row long, col int, value double").repartition(parts)


def same_up_to_sign(a, b, tolerance):
    return all(min(np.abs(x - y).max(), np.abs(x + y).max()) < tolerance for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_agrees_with_numpy(spark, parts):
    rng = np.random.default_rng(parts)
    x = (rng.random((300, 40)) < 0.2) * rng.integers(1, 6, (300, 40)) * 3.0 ** -np.arange(40)[None, :] ** 0.5
    values, right = sparse_svd.truncated_svd(entries(spark, x, parts), 40, 6)
    _, s, vt = np.linalg.svd(x)
    assert np.allclose(values, s[:6], rtol=1e-10) and same_up_to_sign(right, vt[:6], 1e-6)
    assert (right[np.arange(6), np.abs(right).argmax(axis=1)] > 0).all()


def test_low_rank_repeated_and_odd_entries(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (60, 2)).astype(float) @ rng.integers(0, 3, (2, 12))
    df = entries(spark, x).select("row", "col", (F.col("value") / 2).alias("value"))
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, 1, 5.0), (3, None, 5.0), (4, 99, 5.0), (5, -1, 5.0), (7, 2, None)], df.schema))
    values, right = sparse_svd.truncated_svd(twice, 12, 5)
    _, s, vt = np.linalg.svd(x)
    assert len(values) == 2 and np.allclose(values, s[:2]) and same_up_to_sign(right, vt[:2], 1e-8)
    none, empty = sparse_svd.truncated_svd(df.limit(0), 12, 5)
    assert len(none) == len(empty) == 0
    with pytest.raises(ValueError, match="exceed"):
        sparse_svd.truncated_svd(df, 1 << 24, 5)


def test_projection_of_the_fitted_components(spark):
    rng = np.random.default_rng(6)
    x = (rng.random((80, 15)) < 0.3) * rng.integers(1, 4, (80, 15)).astype(float)
    df = entries(spark, x)
    _, right = sparse_svd.truncated_svd(df, 15, 4)
    components = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(right.T)], "col int, v array<double>")
    got = {r.row: r.z for r in sparse_svd.project(df, components, 4).collect()}
    assert set(got) == set(np.flatnonzero(x.any(axis=1)).tolist())
    assert all(np.allclose(got[i], x[i] @ right.T) for i in got)


def test_rule_components_agree_with_numpy(spark):
    sf = "/root/testdata/sf0.001"
    found, v = style._rule_entries(spark, sf)
    rows = found.collect()
    names = [r.rule for r in v.orderBy("rule_id").collect()]
    ids = {s: i for i, s in enumerate(sorted({r.row for r in rows}))}
    x = np.zeros((len(ids), len(names)))
    for r in rows:
        x[ids[r.row], r.col] += r.value
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    got = entry.queries()["rule_components"](spark, sf).collect()
    assert len(got) == 16 * len(names)
    for c in (0, 1, 2):  # the first are well apart
        mine = {r.rule: r.weight for r in got if r.component == c + 1}
        assert same_up_to_sign([np.array([mine[n] for n in names])], [vt[c]], 1e-5)
    assert np.allclose(sorted({r.singular for r in got}, reverse=True), s[:16], rtol=1e-6)
