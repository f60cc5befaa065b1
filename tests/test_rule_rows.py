"""Rules of sentences that stay in one row: components, projections and lists without a shuffle of entries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumeline.operators import sparse_svd

SF = "/root/testdata/sf0.001"


def whole_rows(spark, x):
    rows = [([int(c) for c in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r in x]
    return spark.createDataFrame(rows, "cols array<int>, values array<double>").repartition(5)


@pytest.mark.parametrize("pairs", [1, 1 << 17])
def test_few_columns_are_squared_once(spark, monkeypatch, pairs):
    rng = np.random.default_rng(4)
    x = (rng.random((400, 37)) < 0.2) * rng.integers(-3, 6, (400, 37)) * 3.0 ** -np.arange(37)[None, :] ** 0.5
    x[7] = 1.5
    monkeypatch.setattr(sparse_svd, "PAIRS", pairs)
    gram = sparse_svd._gram(whole_rows(spark, x), 37)
    assert np.allclose(gram, x.T @ x, rtol=1e-12)
    passes, real = [], sparse_svd._pass
    monkeypatch.setattr(sparse_svd, "_pass", lambda *a: passes.append(1) or real(*a))
    values, right = sparse_svd.truncated_svd_of_rows(whole_rows(spark, x), 37, 6)
    _, s, vt = np.linalg.svd(x)
    assert np.allclose(values, s[:6], rtol=1e-10) and all(min(abs(a - b).max(), abs(a + b).max()) < 1e-6 for a, b in zip(right, vt[:6], strict=True))
    assert len(passes) == 1


def test_many_columns_are_multiplied_pass_by_pass(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = (rng.random((200, 30)) < 0.3) * rng.integers(1, 6, (200, 30)) * 3.0 ** -np.arange(30)[None, :] ** 0.5
    monkeypatch.setattr(sparse_svd, "GRAM", 0)
    values, _ = sparse_svd.truncated_svd_of_rows(whole_rows(spark, x), 30, 4)
    assert np.allclose(values, np.linalg.svd(x)[1][:4], rtol=1e-10)


def test_rule_components_read_the_rows_few_times(spark, monkeypatch):
    passes, real = [], sparse_svd._pass
    monkeypatch.setattr(sparse_svd, "_pass", lambda *a: passes.append(1) or real(*a))
    assert entry.queries()["rule_components"](spark, SF).count() > 0
    assert len(passes) == 1


def test_projection_shuffles_nothing(spark):
    assert "Exchange" not in entry.queries()["rule_projection"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_rows_are_numbered_and_projected(spark, monkeypatch):
    rows = [("a", ["x", "y", "z"]), ("b", []), ("c", ["none"]), ("d", ["z", "none"]), ("e", ["y"]), (None, ["x"])]
    df = spark.createDataFrame(rows, "k string, rules array<string>").coalesce(1)
    cols = sparse_svd.numbered(df, "k", "rules", ["x", "y", "z"])
    assert [tuple(r) for r in cols.collect()] == [("a", [0, 1, 2]), ("d", [2]), ("e", [1]), (None, [0])]
    v = np.array([[1.0, 2.0], [4.0, 8.0], [16.0, 32.0]])
    for piece in (1, 1 << 20):
        monkeypatch.setattr(sparse_svd, "PIECE", piece)
        assert [tuple(r) for r in sparse_svd.project_rows(cols, "k", v).collect()] == [("a", [21.0, 42.0]), ("d", [16.0, 32.0]), ("e", [4.0, 8.0]), (None, [1.0, 2.0])]
    none = sparse_svd.numbered(df, "k", "rules", [])
    assert none.count() == sparse_svd.project_rows(none, "k", np.zeros((0, 2))).count() == 0


def test_struct_rules_are_those_of_the_expression(spark):
    from plumeline.operators.rules import struct_rules
    from plumeline.plans.style import parsed

    got = entry.queries()["struct_rules"](spark, SF)
    rules = F.sort_array("rules")
    want = parsed(spark, SF).select("sent_id", F.explode(F.array(struct_rules(F.col("tokens")))).alias("rules")).select("sent_id", F.size(rules).cast("long"), F.array_join(rules, " "))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # the batch form, over more tasks than the file has splits
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert parsed(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 10
