"""BM25 over an impact-ordered index: exact top-k that leaves most postings of common terms unread.

A term's postings stand in falling order of what they add to a score, in blocks of `BLOCK`; a block's bound is its first posting's.
For each query a document's score is at least what the first blocks say of it, and the k-th largest of
such exact scores is a threshold. Terms are taken from the weakest upward: as long as the bounds of unread blocks add up to less than
the threshold, no document that is in unread blocks alone can be among the k. What the other blocks hold is
scored exactly. Nothing is approximate, and no row is made for a document that has only weak terms in common with a query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.operators.places import with_places
from plumeline.operators.retrieval import FEW_TERMS, Bm25, term_counts, top_k
from plumeline.sources.staged import stage
from plumeline.sources.tables import spread

BLOCK = 128
#: Queries of a list of a document's candidates.
LISTED = 256


@dataclass(frozen=True)
class ImpactIndex:
    """postings (term, block, doc_id, impact), blocks (term, block, bound, n) and the queries' terms (query_id, term, qtf)."""

    postings: DataFrame
    blocks: DataFrame
    queries: DataFrame


def build(queries: DataFrame, documents: DataFrame, params: Bm25) -> ImpactIndex:
    """The index of the terms that `queries` (query_id, text) ask for over `documents` (doc_id, text). A null text has no terms."""
    q = stage(term_counts(queries, "query_id", "text", params).withColumnRenamed("tf", "qtf"), "query-terms")
    wanted = q.select("term", F.col("term").alias("known")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_TERMS else wanted.hint("shuffle_hash")
    # Dealt by document, so that its counts need no shuffle of their own.
    words = spread(documents.select("doc_id", "text"), 1000, "doc_id").select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(params.token), F.lit(0))).alias("term")).filter(~F.col("term").isin(*params.stop_words))
    counts = stage(words.join(wanted, "term", "left").groupBy("doc_id", F.col("known").alias("term")).agg(F.count("*").alias("tf")), "term-counts")
    totals = documents.agg(F.count("*").alias("n")).crossJoin(counts.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))).first()  # one row each
    lengths = counts.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    found = counts.filter("term is not null")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(totals.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # Kept as it enters the score, so that query and document make the same product as one formula would.
    rows = found.join(lengths, "doc_id").join(df, "term").select("term", "doc_id", "tf", idf.alias("idf"), (F.col("tf") + params.k1 * (1 - params.b + params.b * F.col("dl") / F.lit(totals.total / max(1, totals.n)))).alias("under"))
    rows = rows.withColumn("impact", F.col("idf") * F.col("tf") / F.col("under"))
    placed = stage(with_places(rows, [F.col("term"), F.col("impact").desc(), F.col("doc_id")], "at"), "impacts")
    first = placed.groupBy("term").agg(F.min("at").alias("first"))
    postings = stage(placed.join(first, "term").select("term", ((F.col("at") - F.col("first")) / BLOCK).cast("int").alias("block"), "doc_id", "tf", "idf", "under"), "postings")
    blocks = postings.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(_part(F.lit(1))).alias("bound"))
    return ImpactIndex(postings, stage(blocks, "blocks"), q)


def _part(qtf: Column) -> Column:
    """What a posting adds to a score, in billionths."""
    return (F.round(qtf * F.col("idf") * F.col("tf") / F.col("under"), 9).cast("decimal(28,9)") * 1_000_000_000).cast("bigint")


def _scores(index: ImpactIndex, candidates: DataFrame) -> DataFrame:
    """Exact scores of (query_id, doc_id) pairs: their documents' postings meet the queries of their terms, and those pairs stay that are wanted.

    A document's candidates are lists of about LISTED queries, so that a posting is not repeated for each of them.
    """
    lists = max(1, -(-index.queries.select("query_id").distinct().count() // LISTED))
    of = F.pmod(F.hash("query_id"), F.lit(lists)).alias("_list")
    wanted = candidates.groupBy("doc_id", of).agg(F.collect_list("query_id").alias("_wanted"))
    asked = index.queries.select("query_id", "term", "qtf", of)
    met = index.postings.join(wanted, "doc_id").join(asked, ["term", "_list"]).filter(F.array_contains("_wanted", F.col("query_id")))
    return met.groupBy("query_id", "doc_id").agg(F.sum(_part(F.col("qtf"))).alias("nano"))


def thresholds(index: ImpactIndex, k: int) -> DataFrame:
    """(query_id, floor): what scores less is not among the k best, from the exact scores of documents that stand first for the query's terms; -1 if these are fewer than k."""
    first = index.postings.filter("block = 0").join(index.queries, "term").groupBy("query_id", "doc_id").agg(F.sum(_part(F.col("qtf"))).alias("_some"))
    w = Window.partitionBy("query_id")
    likely = first.withColumn("_r", F.row_number().over(w.orderBy(F.col("_some").desc(), "doc_id"))).filter(F.col("_r") <= 2 * k).select("query_id", "doc_id")
    best = _scores(index, stage(likely, "likely")).withColumn("_r", F.row_number().over(w.orderBy(F.col("nano").desc()))).filter(F.col("_r") == k).select("query_id", F.col("nano").alias("floor"))
    return index.queries.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce(F.col("floor") - 1000, F.lit(-1)).alias("floor"))  # scores are compared in millionths


def opened(index: ImpactIndex, floors: DataFrame) -> DataFrame:
    """(query_id, term, block, n, read) for every block of a query's terms: whether it must be read.

    A block's bound for a query is its bound times the term's count, and one billionth for each, for rounding.
    """
    bound = index.queries.join(index.blocks, "term").select("query_id", "term", "block", "n", (F.col("qtf") * (F.col("bound") + 1)).alias("bound"))
    bound = stage(bound, "bounds")
    w = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)  # a query's terms
    terms = bound.groupBy("query_id", "term").agg(F.max("bound").alias("most")).withColumn("upto", F.sum("most").over(w))
    known = terms.join(floors, "query_id")
    border = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, -1)
    # Terms whose bounds fit under the threshold are left; of the first that does not, the blocks that still fit; of the others none.
    known = known.withColumn("before", F.col("upto") - F.col("most")).withColumn("over", F.coalesce(F.max(F.col("upto") >= F.col("floor")).over(border), F.lit(False)))
    unread = F.when(F.col("over"), F.lit(False)).otherwise(F.col("before") + F.col("bound") < F.col("floor"))
    return bound.join(known.select("query_id", "term", "before", "over", "floor"), ["query_id", "term"]).select("query_id", "term", "block", "n", (~unread).alias("read"))


def impact_top_k(index: ImpactIndex, k: int, blocks: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query: (query_id, pos, doc_id, score). `blocks` is what `opened` gave, if it is known."""
    blocks = opened(index, thresholds(index, k)) if blocks is None else blocks
    some = index.postings.join(blocks.filter("read").select("query_id", "term", "block"), ["term", "block"]).select("query_id", "doc_id").distinct()
    nano = _scores(index, stage(some, "candidates"))
    return top_k(nano.select("query_id", "doc_id", F.round((F.col("nano").cast("decimal(28,0)") / 1_000_000_000).cast("decimal(28,9)"), 6).cast("double").alias("score")), k)
