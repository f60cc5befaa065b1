"""Work on a row that is done once, and over more tasks than a small file has splits."""

from plumeline.plans.corpus import corpus_docs
from plumeline.sources.tables import spread


def test_rows_are_dealt_by_their_number(spark):
    rows = spark.range(0, 4001, 1, 1)
    assert spread(rows, 2000).rdd.getNumPartitions() == 3 and spread(rows, 2000).count() == 4001
    assert spread(rows.limit(0), 2000).count() == 0


def test_a_product_is_cleaned_once(spark):
    docs = corpus_docs(spark, "/root/testdata/sf0.001")
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    # brand, category, size, weight, text and features: a chain of rules each, 44 where every reader had its own
    assert 1 <= plan.count("Makes? (?:a )?") <= 8


def test_batches_are_cut_by_words():
    import pyarrow as pa

    from plumeline.operators.rules import _by_words

    heads = [[0] * n for n in (3, 0, 4, 50, 2, 2, 2, 0)]
    batch = pa.RecordBatch.from_pydict({"head": pa.array(heads, pa.list_(pa.int32()))})
    got = list(_by_words(iter([batch.slice(1)]), 6))
    assert [h for b in got for h in b.column("head").to_pylist()] == heads[1:]
    assert all(len(b) == 1 or sum(map(len, b.column("head").to_pylist())) <= 6 for b in got) and len(got) > 2
