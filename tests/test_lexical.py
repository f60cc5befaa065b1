"""Blocked BM25 against scores by joins, with odd rows."""

from plumeline.operators import lexical as X
from plumeline.operators.retrieval import Bm25, bm25_scores, target_ranks, top_k


def test_blocks_agree_with_joins_and_make_no_row_for_a_pair(spark, monkeypatch):
    words = "red green blue stone river cloud lamp table".split()
    docs = [(i, " ".join(words[(i * k) % 8] for k in range(1, 3 + i % 9))) for i in range(300)] + [(300, None), (301, ""), (302, "the of"), (7, "red lamp"), (303, "nothing known")]
    q = spark.createDataFrame([(1, "red river"), (2, "lamp lamp the stone"), (3, "unknown"), (4, None), (5, " ".join(words))], "query_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(1, 40), (2, 303), (3, 5), (5, 7)], "query_id long, target long")
    scores = bm25_scores(q, d, Bm25())
    monkeypatch.setattr(X, "PRODUCTS", 50)
    found = X.lexical(q, d, Bm25())
    assert sorted(X.lexical_top_k(found, 4).collect()) == sorted(top_k(scores, 4).collect())
    for limit in (3, 20_000):
        assert sorted(X.lexical_ranks(found, targets, limit).collect()) == sorted(target_ranks(scores, targets, limit).collect())
    assert X.lexical_top_k(X.lexical(q, d.limit(0), Bm25()), 4).count() == 0
    assert found.documents.count() <= 301 and found.queries.count() == 3
