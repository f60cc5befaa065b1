"""Global places, running totals, ranks and exact quantiles against plain Python and NumPy."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import places


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.standard_normal(3000)] + [("wide", float(10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]))) for _ in range(500)]
    rows += [("ties", float(i % 3)) for i in range(100)] + [("one", 7.0), ("nulls", None), ("nulls", None), ("some", None), ("some", 2.0), (None, 1.0), (None, 3.0)]
    rows += [("odd", v) for v in (math.nan, math.inf, -math.inf, 0.0, -0.0, 1.7e308, -1.7e308, 5e-324)]
    return spark.createDataFrame(rows, "k string, v double").repartition(7), rows


def by_key(rows):
    out = {}
    for k, v in rows:
        out.setdefault(k, []).append(v)
    return {k: sorted((v for v in vs if v is not None), key=lambda v: (v != v, v)) for k, vs in out.items()}


def test_places(spark):
    df = spark.range(0, 5000, 1, 9).select(F.xxhash64("id").alias("h"), "id")
    got = places.with_places(df, [F.col("h").desc()]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(5000)) and [r.h for r in got] == sorted((r.h for r in got), reverse=True)
    assert places.with_places(df.limit(0), [F.col("h")]).count() == 0


def test_running_totals(spark):
    df = spark.range(0, 3000, 1, 5).select("id", (F.col("id") % 7).alias("n"))
    got = places.with_running_total(df, [F.col("id")], "n").orderBy("id").collect()
    assert [r.offset for r in got] == [sum(i % 7 for i in range(k)) for k in (0, 1, 2)] + [r.offset for r in got[3:]]
    assert got[-1].offset == sum(i % 7 for i in range(2999))


def test_no_task_holds_all_rows(spark):
    df = spark.range(0, 4000, 1, 4).select(F.xxhash64("id").alias("h"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a table as small as this is one partition
    try:
        placed = places._sorted(df, [F.col("h")])
        got = places.with_places(df, [F.col("h")]).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    largest = placed.groupBy(F.shiftright("_id", 33)).count().agg(F.max("count")).first()[0]
    assert [r.place for r in got] == list(range(4000)) and [r.h for r in got] == sorted(r.h for r in got)
    assert largest < 2500


def test_average_ranks(spark, numbers):
    df, rows = numbers
    kept = df.filter("k IN ('ties', 'some', 'hot')")
    got = places.with_average_rank(kept, ["k"], "v", "r").collect()
    for k, vs in by_key(rows).items():
        if k in ("ties", "some", "hot"):
            for r in (r for r in got if r.k == k):
                assert r.r == (None if r.v is None else sum(v < r.v for v in vs) + (vs.count(r.v) + 1) / 2)


def test_floor_quantiles(numbers):
    df, rows = numbers
    shares = {"a": 0.0, "b": 0.5, "c": 0.75, "d": 0.95, "e": 1.0}
    got = {r.k: r for r in places.floor_quantiles(df, ["k"], "v", shares).collect()}
    for k, vs in by_key(rows).items():
        if k is None:
            continue
        assert got[k].n == len(vs)
        for name, q in shares.items():
            want = vs[int(q * (len(vs) - 1))] if vs else None
            assert got[k][name] == want or (want != want and got[k][name] != got[k][name]), (k, name)


def test_percentiles(numbers):
    df, rows = numbers
    shares = {"a": 0.25, "b": 0.5, "c": 0.9}
    kept = df.filter("k NOT IN ('odd', 'wide')")
    got = {r.k: r for r in places.percentiles(kept, ["k"], "v", shares).collect()}
    want = {r.k: r for r in kept.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(name) for name, q in shares.items()]).collect()}
    for k in ("hot", "ties", "one", "some", "nulls"):
        assert [got[k][c] for c in shares] == [want[k][c] for c in shares], k
    assert len(by_key(rows)) and places.percentiles(kept.limit(0), ["k"], "v", shares).count() == 0


def test_values_made_anew_differ_in_their_last_digits(spark):
    @F.udf("double")
    def shaken(v):
        return v * (1 + int.from_bytes(os.urandom(2)) * 1e-14)

    rows = spark.range(0, 4000, 1, 4).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x"))
    rows = rows.select("k", shaken.asNondeterministic()(F.col("x") + 1).alias("v"))
    for r in places.floor_quantiles(rows, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect():
        assert r.n == 2000 and [round(r[c]) for c in "abcd"] == [1 + r.k, 1 + r.k + 2 * 999, 1 + r.k + 2 * 1899, 1 + r.k + 2 * 1999]
    ranked = places.with_average_rank(rows, ["k"], "v", "r").collect()
    assert sorted(r.r for r in ranked if r.k == 0) == list(range(1, 2001))
