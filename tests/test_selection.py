"""Assertions, blocks, the error model and the audit against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.functions.noise import MECHANISMS
from plumeline.functions.prompts import first_known, morph_diff, rerank_prompt
from plumeline.operators import blocked as B
from plumeline.operators import gaussian as G
from plumeline.operators import selection as S
from plumeline.operators.injection import inject_chain, replay, weighted_mechanism
from plumeline.operators.profiles import error_model, history_form, mechanism_histogram, typo_history, user_totals
from plumeline.operators.ranking import average_rank
from plumeline.plans.style import parse


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_one_to_one_joins_fail_loudly(spark):
    rows, table = frame(spark, [(1, "a"), (2, "b")], "k int, t string"), frame(spark, [(1, 0.5), (2, None)], "k int, v double")
    assert {tuple(r) for r in S.joined_one_to_one(rows, table, ["k"]).collect()} == {(1, "a", 0.5), (2, "b", None)}
    for bad, counts in ((table.filter("k = 1"), (2, 1, 0)), (table.unionByName(table.limit(1)), (2, 0, 1))):
        with pytest.raises(Exception, match="rows for"):
            S.joined_one_to_one(rows, bad, ["k"]).collect()
        assert tuple(S.unmatched(rows, bad, ["k"]).first()) == counts


def test_key_sets(spark):
    a, b = frame(spark, [(1,), (2,), (2,), (None,)], "k int"), frame(spark, [(2,), (3,), (None,)], "k int")
    assert tuple(S.key_differences(a, b, ["k"]).first()) == (1, 1)
    assert S.require_equal_keys(a, a, ["k"]).count() == 4
    with pytest.raises(Exception, match="keys differ"):
        S.require_equal_keys(a, b, ["k"]).collect()


def test_candidates_and_coverage_are_checked(spark):
    pool = frame(spark, [("A", 0, " x "), ("A", 1, "y")], "asin string, local_idx int, text string")
    assert S.current_candidates(pool, pool).count() == 2
    for stale in (frame(spark, [("A", 0, "z")], pool.schema), frame(spark, [("B", 0, "x")], pool.schema), pool.unionByName(pool)):
        with pytest.raises(Exception, match="stale candidate"):
            S.current_candidates(stale, pool).collect()
    with pytest.raises(Exception, match="no fitted user"):
        S.covered(pool, frame(spark, [("B",)], "asin string")).collect()


def test_pool_products_need_two_users(spark):
    one = lambda rows, schema: frame(spark, rows, schema)
    cohort, attrs = one([("A", "u"), ("A", "v"), ("B", "u"), ("B", "w"), ("C", "v"), ("C", "w")], "asin string, user_id string"), one([("A", 5), ("B", 4), ("C", 9)], "asin string, n int")
    got = S.pool_products(cohort, attrs, one([("v",)], "user_id string"), one([("C",)], "asin string"))
    assert [tuple(r) for r in got.collect()] == [("A", 2)]
    with pytest.raises(Exception, match="too few users"):
        S.pool_products(cohort.filter("asin = 'A' and user_id = 'u'"), attrs, one([("u",)], "user_id string"), one([], "asin string")).collect()


def test_blocks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 8)).round(1)
    docs = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, d array<double>")
    queries = docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), F.col("d").alias("q"))
    small = B.Blocks(queries=4, documents=9)
    for score in (B.cosine_scores, B.maxsim(2), B.sparse_products(0.05)):
        full = score(x, x)
        got = {}
        for r in B.blocked_top_k(queries, docs, score, 6, blocks=small).collect():
            got.setdefault(r.query_id, []).append((r.pos, r.doc_id, r.score))
        for q in range(0, 70, 5):
            best = sorted((-full[q, d], d) for d in range(70) if d != q and full[q, d] > -np.inf)[:6]
            assert sorted(got[q]) == [(k + 1, d, pytest.approx(-s)) for k, (s, d) in enumerate(best)]
    scores = {"dense": (B.cosine_scores, 1.0), "maxsim": (B.maxsim(2), 0.5)}
    fused = {(r.query_id, r.pos): r.score for r in B.blocked_fusion(queries, docs, scores, 3, blocks=small).collect()}
    for q in range(0, 70, 5):
        other = np.arange(70) != q
        total = sum(w * (s(x, x)[q] - s(x, x)[q][other].mean()) / s(x, x)[q][other].std(ddof=1) for s, w in scores.values())
        assert fused[q, 1] == pytest.approx(total[other].max(), abs=1e-5)


def test_blocks_take_uneven_vectors(spark):
    """Vectors of several lengths, empty, null, with nulls and not finite: only equal lengths meet, and nothing is cut anew."""
    made = [(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [0.0, 0.0])]
    docs = frame(spark, made, "doc_id long, d array<double>")
    queries = docs.filter("doc_id IN (0, 4, 5, 7)").select(F.col("doc_id").alias("query_id"), F.col("d").alias("q"))
    got = B.blocked_top_k(queries, docs, B.cosine_scores, 9).collect()
    assert sorted((r.query_id, r.pos, r.doc_id, r.score) for r in got) == [(0, 1, 8, 1.0), (0, 2, 3, 0.0), (0, 3, 9, 0.0)]
    m = B.score_moments(queries, docs, {"c": B.cosine_scores}).collect()
    assert {r.query_id: (r.mean_c, r.std_c) for r in m} == {0: (pytest.approx(1 / 3), pytest.approx(1 / 3**0.5)), 5: (0.0, 0.0)}
    assert B.blocked_top_k(queries.limit(0), docs, B.cosine_scores, 9).count() == B.blocked_top_k(queries, docs.limit(0), B.cosine_scores, 9).count() == 0


@pytest.mark.parametrize("padded", [True, False])
@pytest.mark.parametrize("product", [1 << 22, 40])
def test_token_vectors_of_varying_number(spark, padded, product, monkeypatch):
    monkeypatch.setattr(B, "PRODUCT", product)
    rng = np.random.default_rng(4)
    x = [rng.normal(size=3 * n).tolist() for n in [0, 1, 2, 5, 7, 3, 0, 4, 9, 1] * 3]
    docs = frame(spark, list(enumerate(x)), "doc_id long, d array<double>").repartition(3)
    queries = docs.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), F.col("d").alias("q"))

    def tokens(v, most):
        t = np.array(v).reshape(-1, 3)[:most]
        return t / np.linalg.norm(t, axis=1, keepdims=True)

    def score(q, d):
        total = 0.0
        for t in tokens(q, 4):
            best = max((t @ tokens(d, 5).T).tolist(), default=0.0)
            total += max(best, 0.0) if padded and len(d) // 3 < 5 else best
        return total

    got = {(r.query_id, r.pos): (r.doc_id, r.score) for r in B.blocked_top_k(queries, docs, B.token_maxsim(3, 4, 5, padded), 30, blocks=B.Blocks(queries=3, documents=4)).collect()}
    for q in range(0, 30, 4):
        best = sorted((-round(score(x[q], x[d]), 6) + 0.0, d) for d in range(30) if d != q)
        assert [got[q, k + 1] for k in range(29)] == [(d, pytest.approx(-s, abs=2e-6)) for s, d in best]


def test_rounds_of_queries(spark, monkeypatch):
    monkeypatch.setattr(B, "SENT", 400)
    x = np.random.default_rng(5).normal(size=(40, 4))
    docs = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, d array<double>")
    queries = docs.select(F.col("doc_id").alias("query_id"), F.col("d").alias("q"))
    full = B.cosine_scores(x, x)
    got = {(r.query_id, r.pos): r.doc_id for r in B.blocked_top_k(queries, docs, B.cosine_scores, 3).collect()}
    assert all([got[q, k] for k in (1, 2, 3)] == [d for _, d in sorted((-full[q, d], d) for d in range(40) if d != q)[:3]] for q in range(40))


SIGNED = "user_id string, level int, sig string, word string, mech string, typo string"


def test_error_model(spark):
    rows = [("u", 0, "s", "cat", "letter_swap", "cta"), ("u", 0, "s", "dog", None, "dog"), ("u", 0, "s", "Cat", "case_error", "cat"), ("u", 2, "t", "cat", "letter_swap", "act"), ("u", 2, "t", "cat", "letter_swap", "act"), ("v", 0, "s", "cat", "letter_deletion", "ct")]
    signed = frame(spark, rows, SIGNED)
    m = {(r.user_id, r.level): r for r in error_model(signed).collect()}
    r = m["u", 0]
    assert (r.total, r.errors, r.char_level, r.surface, r.rate, r.char_rate) == (3, 2, 1, 1, pytest.approx(2.1 / 3.2), pytest.approx(1.1 / 3.2))
    assert {(r.mech, r.n) for r in mechanism_histogram(signed).filter("level = 0 and user_id = 'u'").collect()} == {("letter_swap", 1), ("case_error", 1)}
    t = user_totals(error_model(signed)).filter("user_id = 'u'").first()
    assert (t.n_tokens, t.n_edits, t.n_char, t.p_char) == (5, 4, 3, pytest.approx(0.6))
    asked = frame(spark, [(1, "u", "CAT", ["s", "x", "t", "x", "x", "x", "x"]), (2, "u", "cat", ["x", "x", "t", "x", "x", "x", "x"]), (3, "u", "cat", ["x"] * 7), (4, "u", "dog", ["s"] * 7)], "k int, user_id string, word string, sigs array<string>")
    got = {r.k: (r.typo, r.source) for r in history_form(asked, typo_history(signed), ["k"]).collect()}
    assert got == {1: ("cta", "user_historical_full"), 2: ("act", "user_historical_d3"), 3: ("act", "user_historical_any")}


def test_mechanisms_are_drawn_by_weight(spark):
    weights = F.array(*[F.lit(w).cast("bigint") for w in (0, 1, 0, 3, 0, 0, 0)])
    drawn = spark.range(2000).select(weighted_mechanism(weights, F.col("id").cast("string")).alias("m")).groupBy("m").count().collect()
    seen = {r.m: r["count"] for r in drawn}
    assert set(seen) == {MECHANISMS[1], MECHANISMS[3]} and 420 < seen[MECHANISMS[1]] < 580
    assert spark.range(1).select(weighted_mechanism(F.array(F.lit(0).cast("bigint")), F.lit("x")).alias("m")).first().m is None


def test_injection_uses_history_and_replays(spark):
    signed = frame(spark, [("u", k, f"s{k}", "table", "letter_swap", "tbale") for k in range(7)] + [("v", k, f"s{k}", "x", None, "x") for k in range(7)], SIGNED)
    queries = frame(spark, [(1, "u", "a table, and more"), (2, "w", "chairs to sit"), (3, "u", "is it")], "query_id long, user_id string, query string")
    got = {r.query_id: r for r in inject_chain(queries, signed, parse).withColumn("again", replay(F.col("query"), F.col("edits"))).collect()}
    assert any((e.original, e.typo, e.source) == ("table", "tbale", "user_historical_any") for e in got[1].edits)
    assert 1 <= len(got[1].edits) <= 3 and len({e.position for e in got[1].edits}) == len(got[1].edits) and [e["index"] for e in got[1].edits] == list(range(len(got[1].edits)))
    assert all(r.again == r.noisy for r in got.values()) and got[3].edits == [] and got[3].noisy == "is it"
    assert all(e.mechanism == "letter_swap" for e in got[2].edits)  # an unknown user errs like everybody


def test_verdict_and_summary(spark):
    fit = "user_id string, lambda double, s array<double>, n_val long, d2_max double"
    rows = [("good", 1.0, [1.0, 2.0], 20, 5.0), ("flat", 1.0, [0.0, 2.0], 20, 5.0), ("few", 1.0, [1.0, 2.0], 3, 5.0), ("nan", 1.0, [1.0, 2.0], 20, float("nan")), ("bare", 1.0, [1.0, 1.0], None, None)]
    calibrated = frame(spark, [(u, 0.9, 10.0, True) for u in ("good", "flat", "few", "nan")], "user_id string, coverage double, median_d2 double, a2_pass boolean")
    stable = frame(spark, [(u, 1.0, 0.9, 0.9) for u in ("good", "flat", "few")] + [("nan", 0.5, 0.9, 0.9)], "user_id string, fit_rate double, rho_median double, agreement_median double")
    v = G.verdict(frame(spark, rows, fit), calibrated, stable)
    assert {r.user_id: (r.a1_pass, r.a2_pass, r.a3_pass, r.valid) for r in v.collect()} == {"good": (True, True, True, True), "flat": (False, True, True, False), "few": (False, True, True, False), "nan": (False, True, False, False), "bare": (False, False, False, False)}
    s = G.audit_summary(v).first()
    assert (s.n_users, s.n_valid, s.fail_a1, s.fail_a2, s.fail_a3, s.coverage_p50) == (5, 1, 4, 1, 2, 0.9)


def test_average_ranks_share_ties(spark):
    got = frame(spark, [("u", x) for x in (3.0, 1.0, 3.0, 2.0)], "k string, x double").withColumn("r", average_rank(["k"], F.col("x"))).collect()
    assert sorted((r.x, r.r) for r in got) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_prompts_and_features(spark):
    r = spark.range(1).select(rerank_prompt(F.lit("q"), F.lit("  " + "d" * 300), "judge").alias("p"), morph_diff(F.lit("Number=Sing|Tense=Past"), F.lit("Number=Plur|Case=Nom")).alias("m"), first_known(F.lit(None).cast("array<float>"), F.array(F.lit(1.0).cast("float"))).alias("v"), S.finite_or_null(F.lit(float("inf"))).alias("f")).first()
    assert "<Query>: q\n<Document>: " + "d" * 240 + "\nIs" in r.p
    assert (r.m, r.v, r.f) == ("Case:_→Nom;Number:Sing→Plur;Tense:Past→_", [1.0], None)
