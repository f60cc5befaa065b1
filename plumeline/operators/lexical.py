"""BM25 of whole tables without a row for a pair: documents' term counts as vectors, scored block by block where they are.

A document is (length, term, count, term, count, ...) of the terms that some query asks for, a query (term, count, idf, ...). A
task scores its documents against a round of queries and emits, for each query, its k best or how many come before a known
place: what is shuffled grows with queries and tasks, not with the pairs that share a term. Scores are sums of billionths in
integers, so that they do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.operators.blocked import Blocks, Ragged, Score, _pieces, _rounds, _top, _usable
from plumeline.operators.retrieval import Bm25, term_counts, top_k, wanted_counts
from plumeline.sources.staged import stage

#: Products of a query's and a document's term count that are held at once.
PRODUCTS = 1 << 20
BLOCKS = Blocks(queries=512, documents=1024)


@dataclass(frozen=True)
class Lexical:
    """queries (query_id, q), documents (doc_id, d) and their score."""

    queries: DataFrame
    documents: DataFrame
    score: Score


def lexical(queries: DataFrame, documents: DataFrame, params: Bm25) -> Lexical:
    """Vectors of `queries` (query_id, text) and `documents` (doc_id, text); a document is split into words once. Documents and queries without a common term have no score."""
    asked = stage(term_counts(queries, "query_id", "text", params).withColumnRenamed("tf", "qtf"), "query-terms")
    terms = stage(asked.select("term").distinct().withColumn("_id", F.monotonically_increasing_id()), "terms")
    counts = wanted_counts(documents, terms.select("term", F.col("_id").alias("known")), params)
    entry = F.when(F.col("term").isNotNull(), F.array(F.col("term").cast("double"), F.col("tf").cast("double")))
    each = counts.groupBy("doc_id").agg(F.sum("tf").cast("double").alias("dl"), F.flatten(F.collect_list(entry)).alias("v"))
    d = stage(each.select("doc_id", F.size("v").alias("n"), "dl", F.concat(F.array("dl"), "v").alias("d")), "term-vectors")
    n, total = documents.count(), d.agg(F.sum("dl")).first()[0] or 0
    df = counts.filter("term is not null").groupBy(F.col("term").alias("_id")).agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(terms, "term").join(df, "_id").select("query_id", F.array(F.col("_id").cast("double"), F.col("qtf").cast("double"), idf).alias("w"))
    q = stage(weights.groupBy("query_id").agg(F.flatten(F.collect_list("w")).alias("q")), "query-vectors")
    return Lexical(q, d.filter("n > 0").select("doc_id", "d"), _score(params, total / max(1, n)))


def _score(params: Bm25, average: float) -> Score:
    def score(q: Ragged, d: Ragged) -> np.ndarray:
        rows, columns = len(q), len(d)
        total, met = np.zeros(rows * columns), np.zeros(rows * columns, bool)
        own = q.values[q.ends[0] : q.ends[-1]].reshape(-1, 3)
        order = np.argsort(own[:, 0], kind="stable")
        row, (term, qtf, idf) = np.repeat(np.arange(rows), q.lengths // 3)[order], own[order].T
        known, first, often = np.unique(term, return_index=True, return_counts=True)
        if not len(known) or not columns:
            return np.full((rows, columns), -np.inf)
        weight = qtf * idf
        sizes = d.lengths // 2
        doc = np.repeat(np.arange(columns), sizes)
        at = np.repeat(d.ends[:-1] + 1 - 2 * (np.cumsum(sizes) - sizes), sizes) + 2 * np.arange(len(doc))
        place = np.minimum(np.searchsorted(known, d.values[at]), len(known) - 1)
        kept = known[place] == d.values[at]
        doc, place, tf = doc[kept], place[kept], d.values[at[kept] + 1]
        under = tf + params.k1 * (1 - params.b + params.b * d.values[d.ends[:-1]][doc] / average)
        upto = np.cumsum(often[place])
        lo = 0
        while lo < len(doc):  # a slice is at most PRODUCTS products, or one term of a document
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PRODUCTS, side="right")))
            n = often[place[lo:hi]]
            p = np.repeat(np.arange(lo, hi), n)
            w = np.repeat(first[place[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(len(p))
            pair = row[w] * columns + doc[p]
            total += np.bincount(pair, np.floor(weight[w] * tf[p] / under[p] * 1e9 + 0.5), rows * columns)  # billionths: whole numbers
            met[pair] = True
            lo = hi
        return np.where(met, (total.astype(np.int64) + 500) // 1000 / 1e6, -np.inf).reshape(rows, columns)

    return score


def lexical_top_k(found: Lexical, k: int) -> DataFrame:
    """(query_id, pos, doc_id, score): the k best of each query by score, then doc_id."""
    score = found.score
    return top_k(_top(found.queries, found.documents, lambda q, d, _: score(q, d), k, BLOCKS, own=True), k)


def _each(queries: DataFrame, documents: DataFrame, score: Score, look, columns: str, label: str) -> DataFrame:
    """What `look` (scores, query ids, document ids, what is told) gives of each block, as arrays of query_id and a number, summed for each task and query."""
    data = _usable(documents, "doc_id", "d")
    found = None
    for ids, vectors, told in _rounds(queries):
        sent = documents.sparkSession.sparkContext.broadcast((ids, vectors, told))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q, known = sent.value
            out, seen = np.zeros(len(q_ids)), np.zeros(len(q_ids), bool)
            for d_ids, d in _pieces(batches, BLOCKS.documents):
                for lo in range(0, len(q_ids), BLOCKS.queries):
                    hi = min(lo + BLOCKS.queries, len(q_ids))
                    value, there = look(score(q.part(lo, hi), d), d_ids, known[lo:hi])
                    out[lo:hi] += value
                    seen[lo:hi] |= there
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[seen]), pa.array(out[seen])], ["query_id", "value"])

        part = stage(data.mapInArrow(run, columns), label)
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("query_id").agg(F.sum("value").alias("value"))


def lexical_ranks(found: Lexical, targets: DataFrame, limit: int = 20_000) -> DataFrame:
    """(query_id, target, rank) as `target_ranks` gives it: first the targets' own scores, from their documents alone, then how many documents come before."""

    def of_target(s: np.ndarray, d_ids: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = (d_ids[None, :] == told[:, :1]) & (s > -np.inf)
        return np.where(hit, s, 0.0).sum(axis=1), hit.any(axis=1)

    def before(s: np.ndarray, d_ids: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = (s > told[:, :1]) | ((s == told[:, :1]) & (d_ids[None, :] < told[:, 1:]))
        return first.sum(axis=1), np.ones(len(s), bool)

    columns = "query_id long, value double"
    wanted = found.queries.join(targets, "query_id").select("query_id", "q", F.array(F.col("target").cast("double")).alias("told"))
    held = found.documents.join(targets.select(F.col("target").alias("doc_id")).distinct(), "doc_id", "left_semi")
    own = stage(_each(wanted, held, found.score, of_target, columns, "own-scores"), "own")
    known = found.queries.join(own, "query_id").join(targets, "query_id").select("query_id", "q", F.array("value", F.col("target").cast("double")).alias("told"))
    ranks = _each(known, found.documents, found.score, before, columns, "before").select("query_id", (1 + F.col("value")).cast("long").alias("_rank"))
    return targets.join(ranks, "query_id", "left").select("query_id", "target", F.when(F.col("_rank") <= limit, F.col("_rank")).otherwise(F.lit(limit + 1)).cast("int").alias("rank"))
