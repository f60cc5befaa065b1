"""Retrieval operators: inverted-index scoring, dense and late-interaction similarity, fusion and top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.sources.staged import stage

#: The stop words of the lexical retriever.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    token: str = r"[\p{L}\p{N}_]{2,}"
    stop_words: tuple[str, ...] = STOP_WORDS


def term_counts(rows: DataFrame, key: str, text: str, params: Bm25) -> DataFrame:
    """(key, term, tf) without stop words."""
    terms = rows.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(params.token), F.lit(0))).alias("term"))
    return terms.filter(~F.col("term").isin(*params.stop_words)).groupBy(key, "term").agg(F.count("*").alias("tf"))


#: Up to so many distinct query terms are broadcast; more meet the documents' words by a shuffle.
FEW_TERMS = 1_000_000


def wanted_counts(documents: DataFrame, wanted: DataFrame, params: Bm25) -> DataFrame:
    """(doc_id, term, tf), staged: `known` of each term of `wanted` (term, known) that a document holds, and a null term for all its other words."""
    known = F.broadcast(wanted) if wanted.count() <= FEW_TERMS else wanted.hint("shuffle_hash")
    words = documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(params.token), F.lit(0))).alias("term")).filter(~F.col("term").isin(*params.stop_words))
    return stage(words.join(known, "term", "left").groupBy("doc_id", F.col("known").alias("term")).agg(F.count("*").alias("tf")), "postings")


def bm25_scores(queries: DataFrame, documents: DataFrame, params: Bm25) -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term with a query, idf in its Lucene form.

    Documents are split into words once: what is written down is a row for each query term of a document and one for all
    its other words, from which lengths, document frequencies and scores follow.
    """
    q = stage(term_counts(queries, "query_id", "text", params).withColumnRenamed("tf", "qtf"), "query-terms")
    counts = wanted_counts(documents, q.select("term", F.col("term").alias("known")).distinct(), params)
    lengths = counts.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    n = documents.count()
    total = counts.agg(F.sum("tf")).first()[0] or 0
    postings = counts.filter("term is not null").join(lengths, "doc_id")
    df = counts.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") / (F.col("tf") + params.k1 * (1 - params.b + params.b * F.col("dl") / F.lit(total / max(1, n))))
    return postings.join(q.join(df, "term"), "term").groupBy("query_id", "doc_id").agg(_exact_sum(part).alias("score"))


def target_ranks(scores: DataFrame, targets: DataFrame, limit: int = 20_000) -> DataFrame:
    """(query_id, target, rank): one more than the documents before the target by score, then doc_id; counted, not sorted. Beyond `limit`, or without a score, limit + 1."""
    own = scores.join(targets.select("query_id", F.col("target").alias("doc_id")), ["query_id", "doc_id"]).select("query_id", F.col("score").alias("_s"), F.col("doc_id").alias("_t"))
    before = scores.join(own, "query_id").groupBy("query_id").agg((1 + F.count_if((F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("doc_id") < F.col("_t"))))).alias("_rank"))
    return targets.join(before, "query_id", "left").select("query_id", "target", F.when(F.col("_rank") <= limit, F.col("_rank")).otherwise(F.lit(limit + 1)).cast("int").alias("rank"))


def term_coverage(candidates: DataFrame, queries: DataFrame, documents: DataFrame, params: Bm25) -> DataFrame:
    """`candidates` (query_id, doc_id, ...) with `score`, the share of the query's distinct terms that the document holds; only candidates' texts are read into words."""

    def terms(text: str) -> Column:
        words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(params.token), F.lit(0))
        return F.array_except(words, F.array(*map(F.lit, params.stop_words)))  # distinct words

    asked = queries.select("query_id", terms("text").alias("_asked"))
    rows = candidates.join(documents.select("doc_id", F.col("text").alias("_text")), "doc_id").join(asked, "query_id")
    share = F.size(F.array_intersect("_asked", terms("_text"))) / F.size("_asked")
    return rows.withColumn("score", F.round(share, 6)).drop("_asked", "_text")


def _exact_sum(part: Column) -> Column:
    """A sum in decimals, so that it does not depend on the order of rows."""
    return F.round(F.sum(F.round(part, 9).cast("decimal(28,9)")), 6).cast("double")


def top_k(scores: DataFrame, k: int, competition: bool = False) -> DataFrame:
    """The k best of each query by score, then doc_id; with `competition`, also 1 + the number of better scores."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = scores.withColumn("pos", F.row_number().over(w))
    if competition:
        ranked = ranked.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc())))
    return ranked.filter(F.col("pos") <= k).select("query_id", "pos", "doc_id", "score", *(["rank"] if competition else []))
