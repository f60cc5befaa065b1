"""Which documents hold a query's text: candidates by one rare word, then the texts themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.operators.retrieval import FEW_TERMS
from plumeline.sources.staged import stage

WORD = r"[\p{L}\p{N}_]+"


def _inner(text: Column) -> Column:
    """Distinct words with something that is no word on both sides: wherever the text stands, these are whole words there."""
    outer = F.regexp_replace(F.regexp_replace(text, rf"^{WORD}", ""), rf"(?<!{WORD[:-1]}){WORD}+\z", "")
    return F.array_distinct(F.regexp_extract_all(outer, F.lit(WORD), F.lit(0)))


def containing(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id) for every document (doc_id, text) that holds the text of a query (query_id, text), as one row each.

    Documents are read into words once and counted for the queries' words alone; each query goes by the one that fewest documents hold,
    and only those documents are compared. A query without an inner word, of a word or two or none, is compared with all documents. A
    null text holds nothing and is held by nothing; an empty one is held by every other.
    """
    asked = stage(queries.filter(F.col("text").isNotNull()).select("query_id", F.col("text").alias("_asked"), _inner(F.col("text")).alias("_words")), "asked")
    wanted = stage(asked.select(F.explode("_words").alias("word")).distinct(), "words")
    known = F.broadcast(wanted) if wanted.count() <= FEW_TERMS else wanted.hint("shuffle_hash")
    texts = documents.filter(F.col("text").isNotNull()).select("doc_id", "text")
    held = stage(texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word")).join(known, "word").distinct(), "held")
    df = held.groupBy("word").agg(F.count("*").alias("_df"))
    words = asked.select("query_id", F.explode("_words").alias("word")).join(df, "word", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    rarest = words.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("_df", "word"))).filter("_r = 1")
    pairs = held.join(rarest.select("query_id", "word"), "word").select("query_id", "doc_id").join(asked.select("query_id", "_asked"), "query_id")
    met = texts.join(pairs, "doc_id").filter(F.contains("text", "_asked")).select("query_id", "doc_id")
    short = asked.filter(F.size("_words") == 0).select("query_id", "_asked")
    if short.isEmpty():
        return met.distinct()
    return met.unionByName(texts.join(short, F.contains("text", "_asked")).select("query_id", "doc_id")).distinct()
