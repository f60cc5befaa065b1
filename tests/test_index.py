"""The impact-ordered index against plain BM25, and the containment join against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from plumeline.operators import impact_index
from plumeline.operators.containment import _inner, containing
from plumeline.operators.retrieval import Bm25, bm25_scores, top_k


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    draw = lambda n: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(200)], k=n))
    docs = [(i, draw(rnd.randint(3, 60))) for i in range(900)] + [(900 + i, "w0 w1 w2 w150") for i in range(40)] + [(950, None), (951, ""), (952, "w0 " * 3000), (953, "!!")]
    queries = [(i, draw(rnd.randint(1, 12))) for i in range(25)] + [(30, "w150 w151"), (31, "absent"), (32, None), (33, ""), (34, "w0 w0 w0 w199"), (35, "the of and")]
    schema = "{} long, text string"
    return spark.createDataFrame(queries, schema.format("query_id")).repartition(3), spark.createDataFrame(docs, schema.format("doc_id")).repartition(5)


@pytest.mark.parametrize(("k", "block"), [(1, 128), (10, 128), (10, 4), (2000, 16)])
def test_same_rows_as_bm25(corpus, k, block, monkeypatch):
    monkeypatch.setattr(impact_index, "BLOCK", block)
    queries, docs = corpus
    want = sorted(map(tuple, top_k(bm25_scores(queries, docs, Bm25()), k).collect()))
    index = impact_index.build(queries, docs, Bm25())
    blocks = impact_index.opened(index, impact_index.thresholds(index, k))
    assert sorted(map(tuple, impact_index.impact_top_k(index, k, blocks).collect())) == want
    if k < 100:
        read = blocks.agg(F.sum(F.when(F.col("read"), F.col("n")).otherwise(0)) / F.sum("n")).first()[0]
        assert read < 0.8


def test_an_empty_index(corpus):
    queries, docs = corpus
    for q, d in ((queries.limit(0), docs), (queries, docs.limit(0))):
        assert impact_index.impact_top_k(impact_index.build(q, d, Bm25()), 5).count() == 0


def test_containment(spark):
    rnd = random.Random(4)
    words = ["red", "Red", "blue", "big blue", "x", "naïve", "漢字", "a_b", "can't", "end.", "\n"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 9)))) for i in range(300)] + [(400, None), (401, ""), (402, "reddish big blueberry"), (403, "x" * 50_000), (3, "again red blue x")]
    queries = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(60)] + [(70, None), (71, ""), (72, "dish big blue"), (73, "d"), (74, " red "), (75, "never there at all"), (76, "x" * 40_000), (77, ".*")]
    q, d = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = {(i, j) for i, t in queries for j, body in docs if t is not None and body is not None and t in body}
    got = [tuple(r) for r in containing(q, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert containing(q.limit(0), d).count() == containing(q, d.limit(0)).count() == 0


def test_inner_words_are_whole_words(spark):
    df = spark.createDataFrame([("ab cd ef",), (" ab cd",), ("ab",), ("ab cd",), ("",), ("'ab'",)], "t string")
    assert [r[0] for r in df.select(_inner(F.col("t"))).collect()] == [["cd"], ["ab"], [], [], [], ["ab"]]


def test_candidates_come_by_one_word(spark):
    """No nested loop in the plan for queries that have an inner word."""
    q = spark.createDataFrame([(1, "one two three")], "query_id long, text string")
    d = spark.createDataFrame([(1, "zero one two three four")], "doc_id long, text string")
    plan = containing(q, d)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
