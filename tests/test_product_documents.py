"""Product documents: one for an asin, numbered over all of them, from lists as well as texts."""

import pytest

from plumeline.plans.corpus import corpus_docs, product_documents

SCHEMA = "asin string, line_no long, title string, brand string, categories array<string>, dimensions string, weight string, description array<string>, features array<string>"


def line(asin, line_no, title, categories=(), description=(), features=(), brand=None):
    return (asin, line_no, title, brand, list(categories), "3 x 4 inches", None, list(description), list(features))


def test_documents_are_numbered_over_all_asins(spark):
    docs = corpus_docs(spark, "/root/testdata/sf0.001")
    assert docs.columns == ["asin", "doc_idx", "doc"]
    got = docs.collect()
    assert [r.asin for r in sorted(got, key=lambda r: r.doc_idx)] == sorted(r.asin for r in got)
    assert sorted(r.doc_idx for r in got) == list(range(200))
    assert all(" / " in r.doc.split("\n")[2] for r in got)


def test_places_do_not_depend_on_partitions(spark):
    asins = [f"{'ABC'[i % 3]}{i * 7919 % 3001}" for i in range(3001)] + ["é", "Z", "a", "0"]
    got = product_documents(spark.createDataFrame([line(a, i, "t") for i, a in enumerate(asins)], SCHEMA).repartition(7)).collect()
    assert {r.asin: r.doc_idx for r in got} == {a: i for i, a in enumerate(sorted(asins))} and len(got) == len(asins)


def test_the_last_titled_line_of_an_asin_counts(spark):
    lines = [line("B2", 9, "new"), line("B2", 3, "old"), line(" B<b>2 ", 5, "between"), line("B2", 11, None), line("B2", 12, ""), line("B10", 1, "!"), line("none", 1, None)]
    got = product_documents(spark.createDataFrame(lines, SCHEMA).repartition(3)).orderBy("doc_idx").collect()
    # A title of which the cleaning leaves nothing is a title; `B 2` is an asin of its own.
    assert [tuple(r) for r in got] == [(a, i, f"product: {t}\ndimensions: 3 x 4 inches") for i, (a, t) in enumerate([("B 2", "between"), ("B10", ""), ("B2", "new")])]


def test_lists_are_joined(spark):
    categories = ["Baby &amp; Toddler", None, "See more", "Chairs"]
    description = ["Soft <b>seat</b>.", None, "It measures 3 x 4 inches.", "Makes a great gift.", "For two."]
    got = product_documents(spark.createDataFrame([line("A", 1, "Chair", categories, description, ["&quot;One&quot;", None, "See more.", "two"], "Br&amp;nd")], SCHEMA)).first()
    assert got.doc.split("\n") == ["product: Chair", "brand: Br&nd", "category: Baby & Toddler /  / Chairs", "dimensions: 3 x 4 inches", "description: Soft seat . For two.", "features:", '#1: "One"', "#2: two"]


def test_a_line_without_asin_is_an_error(spark):
    for asin in (None, " ", "<b>"):
        with pytest.raises(Exception, match="no asin"):
            product_documents(spark.createDataFrame([line("A", 1, "t"), line(asin, 2, "t")], SCHEMA)).collect()
    assert product_documents(spark.createDataFrame([], SCHEMA)).count() == 0
