"""The summary of users' cosines has every conversation as a user, and counts every pair."""

import numpy as np
from pyspark.sql import functions as F

from plumeline.operators.blocked import Blocks, of_equal_length, rounded, score_histogram
from plumeline.plans.noise import cosine_summary_query, error_profile
from plumeline.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_every_conversation_is_a_user(spark):
    n = table(spark, SF, "conversations").filter(F.col("text").rlike("[A-Za-z]{4}")).select("conv_id").distinct().count()
    assert cosine_summary_query(spark, SF).first().n_users == n > 10
    assert error_profile(spark, SF).select("user_id").distinct().count() == 10  # whose SQL has ten


def test_scores_of_any_size_are_counted(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(90, 3)).round(2)
    vectors[:5] = [[1, 0, 0], [1, 0, 0], [-1, 0, 0], [0, 0, 0], [1.000001, 0, 0]]  # products of 1, -1, 0 and just over 1
    product = of_equal_length(lambda q, d: rounded(q @ d.T, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(3)
    got = score_histogram(rows, product, Blocks(queries=16, documents=32)).collect()
    whole = np.rint(rounded(vectors @ vectors.T, 6)[np.triu_indices(90, 1)] * 1e6).astype(int)
    micro, n = np.unique(whole, return_counts=True)
    assert {r.micro: r.n for r in got} == dict(zip(micro.tolist(), n.tolist(), strict=True)) and len(got) == len(micro)
    assert micro.min() < -(10**6) and {-(10**6), 0, 10**6, 10**6 + 1} <= set(micro.tolist())
