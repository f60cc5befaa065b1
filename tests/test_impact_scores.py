"""Candidates of the impact-ordered index are scored without a row for each posting of each candidate."""

import pytest

from plumeline.operators import impact_index
from plumeline.operators.retrieval import Bm25, bm25_scores, top_k


@pytest.mark.parametrize("listed", [1, 3, 256])
def test_scores_of_candidates(spark, monkeypatch, listed):
    monkeypatch.setattr(impact_index, "LISTED", listed)
    words = "red green blue stone river cloud lamp table".split()
    docs = [(i, " ".join(words[(i * k) % 8] for k in range(1, 3 + i % 9))) for i in range(200)] + [(300, None), (7, "red lamp")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "red river"), (2, "lamp lamp the stone"), (3, "unknown"), (4, None), (5, " ".join(words)), (-6, "blue")], "query_id long, text string")
    index = impact_index.build(q, d, Bm25())
    pairs = spark.createDataFrame([(i, j) for i in (1, 2, 3, 5, -6) for j in range(0, 200, 3)] + [(1, 300), (2, 7)], "query_id long, doc_id long")
    got = {(r.query_id, r.doc_id): r.nano for r in impact_index._scores(index, pairs).collect()}
    want = {(r.query_id, r.doc_id): r.score for r in bm25_scores(q, d, Bm25()).join(pairs.distinct(), ["query_id", "doc_id"]).collect()}
    assert got.keys() == want.keys() and all(got[k] / 1e9 == pytest.approx(want[k], abs=1e-6) for k in want)
    assert sorted(impact_index.impact_top_k(index, 4).collect()) == sorted(top_k(bm25_scores(q, d, Bm25()), 4).collect())


def test_a_posting_is_not_repeated_for_each_candidate(spark):
    """Each of 2,000 postings meets its term's one query; a row for each posting of each of 2,000 pairs would be 100,000."""
    q = spark.createDataFrame([(i, f"w{i}") for i in range(50)], "query_id long, text string")
    d = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(50))) for i in range(40)], "doc_id long, text string")
    index = impact_index.build(q, d, Bm25())
    scores = impact_index._scores(index, q.select("query_id").crossJoin(d.select("doc_id")))
    assert scores.count() == 2000
    plan = scores._jdf.queryExecution()
    scores.collect()
    made, nodes = [], [plan.executedPlan()]
    while nodes:
        node = nodes.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert made and max(made) <= 2000
