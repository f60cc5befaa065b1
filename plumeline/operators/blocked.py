"""A stated query set against all vectors, block by block: matrix products in tasks, and no row for a pair.

Documents stay where they are. Queries come to them in rounds of at most `SENT` bytes; a task keeps the best k of each query of a round,
or sums, over all the documents it reads, so what it emits is k rows for each query and task. How many tasks there
are follows from the documents alone.

Vectors may have different lengths: a block is all its numbers and where each vector ends. Scores of whole vectors compare those of equal
length only; a score of token vectors takes a vector as so many tokens of `dim` numbers. Defined results: vectors that are null, or hold
null or non-finite numbers, take no part; an empty vector has cosine 0 with another empty one. Query ids are unique, document ids need
not be; rows without an id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumeline.operators.retrieval import top_k
from plumeline.sources.staged import stage, unstage

#: Bytes of queries in a round.
SENT = 16 << 20
#: Numbers of a product of token vectors that are held at once.
PRODUCT = 1 << 22


@dataclass(frozen=True)
class Ragged:
    """Vectors of any lengths: their numbers, one after another, and where each begins, with the end of the last."""

    values: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.ends)

    def matrix(self, at: np.ndarray, length: int) -> np.ndarray:
        """The vectors `at`, all of one length."""
        return self.values[self.ends[at][:, None] + np.arange(length)]

    def part(self, lo: int, hi: int) -> Ragged:
        return Ragged(self.values, self.ends[lo : hi + 1])


#: (queries, documents) -> a matrix of scores, one row for each query; minus infinity where a pair has none.
Score = Callable[[Ragged, Ragged], np.ndarray]


@dataclass(frozen=True)
class Blocks:
    queries: int = 512
    documents: int = 2048


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Rounded half away from zero, as SQL does."""
    y = x * 10.0**places
    return np.trunc(y + np.copysign(0.5, y)) / 10.0**places


def of_equal_length(score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Score:
    """A score of matrices, for vectors of any lengths: each length apart, none between two lengths. Matrices are taken as they are."""

    def scored(q: Ragged | np.ndarray, d: Ragged | np.ndarray) -> np.ndarray:
        if isinstance(q, np.ndarray):
            return score(q, d)
        out = np.full((len(q), len(d)), -np.inf)
        for length in np.intersect1d(q.lengths, d.lengths):
            a, b = np.flatnonzero(q.lengths == length), np.flatnonzero(d.lengths == length)
            out[np.ix_(a, b)] = score(q.matrix(a, length), d.matrix(b, length))
        return out

    return scored


@of_equal_length
def cosine_scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    return rounded(unit(q) @ unit(d).T, 6)


def sparse_products(least: float, none: float = -np.inf) -> Score:
    """Inner products over the coordinates that exceed `least` on both sides, each product rounded to nine places; `none` where there is no such coordinate."""

    def score(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        out, met = np.zeros((len(q), len(d)), np.int64), np.zeros((len(q), len(d)), bool)  # billionths
        for i in range(q.shape[1]):
            a, b = np.flatnonzero(q[:, i] > least), np.flatnonzero(d[:, i] > least)
            at = np.ix_(a, b)
            out[at] += np.trunc(np.outer(q[a, i], d[b, i]) * 1e9 + 0.5).astype(np.int64)  # positive
            met[at] = True
        return np.where(met, (out + 500) // 1000 / 1e6, none)

    return of_equal_length(score)


def maxsim(parts: int) -> Score:
    """Sum over a query's slices of the best cosine with a slice of the document."""

    def score(q: np.ndarray, d: np.ndarray) -> np.ndarray:
        qs, ds = (unit(x.reshape(len(x), parts, -1)) for x in (q, d))
        best = [np.max([qs[:, i] @ ds[:, j].T for j in range(parts)], axis=0) for i in range(parts)]
        return rounded(np.sum(rounded(np.array(best), 9), axis=0), 6)

    return of_equal_length(score)


def _tokens(x: Ragged, dim: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit token vectors of all rows, where each row's begin, with their end): the first `most` of each."""
    counts = np.minimum(x.lengths // dim, most)
    starts = np.append(0, np.cumsum(counts))
    first = np.repeat(x.ends[:-1] - starts[:-1] * dim, counts) + np.arange(starts[-1]) * dim
    return unit(x.values[first[:, None] + np.arange(dim)]), starts


def token_maxsim(dim: int, query_tokens: int = 32, document_tokens: int = 64, padded: bool = True) -> Score:
    """Sum over a query's tokens of the best cosine with a token of the document, of the first so many on each side.

    With `padded`, a document of fewer tokens is filled up with tokens that score 0 with all, so that none of its best
    is negative. A document or a query without tokens scores 0. Numbers behind the last whole token are not read.
    """

    def score(q: Ragged, d: Ragged) -> np.ndarray:
        out = np.zeros((len(q), len(d)))
        asked, begins = _tokens(q, dim, query_tokens)
        if not len(asked):
            return out
        step = max(1, PRODUCT // (len(asked) * document_tokens))
        for lo in range(0, len(d), step):
            held, starts = _tokens(d.part(lo, min(lo + step, len(d))), dim, document_tokens)
            counts = np.diff(starts)
            some = np.flatnonzero(counts)
            best = np.zeros((len(asked), len(counts)))
            if len(some):
                best[:, some] = np.maximum.reduceat(asked @ held.T, starts[some], axis=1)
            if padded:
                best[:, counts < document_tokens] = np.maximum(best[:, counts < document_tokens], 0)
            full = np.flatnonzero(np.diff(begins))
            out[full, lo : lo + len(counts)] = np.add.reduceat(rounded(best, 9), begins[full], axis=0)
        return rounded(out, 6)

    return score


def _usable(rows: DataFrame, key: str, vector: str, *more: Column) -> DataFrame:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col(key).isNotNull() & F.coalesce(whole, F.lit(False)))
    return kept.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *more)


def _ragged(column: pa.ListArray) -> Ragged:
    return Ragged(column.values.to_numpy(), column.offsets.to_numpy())


def _rounds(queries: DataFrame) -> Iterator[tuple[np.ndarray, Ragged, np.ndarray]]:
    """(ids, vectors, what is told of each) of the queries, in rounds that fit in `SENT`."""
    asked = stage(_usable(queries, "query_id", "q", F.col("told") if "told" in queries.columns else F.array().cast("array<double>").alias("told")), "queries")
    numbers = asked.agg(F.sum(F.size("v") + F.size("told") + 2)).first()[0] or 0
    rounds = max(1, -(-8 * numbers // SENT))
    asked = stage(asked.withColumn("round", F.monotonically_increasing_id() % rounds), "rounds")
    for r in range(rounds):
        rows = asked.filter(F.col("round") == r).select("id", "v", "told").collect()
        ends = np.append(0, np.cumsum([len(x.v) for x in rows])).astype(np.int64)
        values = np.concatenate([np.asarray(x.v, float) for x in rows]) if rows else np.empty(0)
        yield np.array([x.id for x in rows], np.int64), Ragged(values, ends), np.array([x.told for x in rows], float).reshape(len(rows), len(rows[0].told) if rows else 0)
    unstage(asked)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, Ragged]]:
    for batch in batches:
        ids, vectors = batch.column("id").to_numpy(), _ragged(batch.column("v"))
        for lo in range(0, len(ids), size):
            hi = min(lo + size, len(ids))
            yield ids[lo:hi], vectors.part(lo, hi)


def _kept(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by score, then id."""
    order = np.lexsort((ids, -scores, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    order = order[place < k]
    return query[order], ids[order], scores[order]


def _top(queries: DataFrame, documents: DataFrame, score: Callable[[Ragged, Ragged, np.ndarray], np.ndarray], k: int, blocks: Blocks, own: bool = False) -> DataFrame:
    """(query_id, doc_id, score): k rows for each query and task. With `own`, ids of queries and documents have nothing to do with each other."""
    data = _usable(documents, "doc_id", "d")
    found = None
    for ids, vectors, told in _rounds(queries):
        sent = documents.sparkSession.sparkContext.broadcast((ids, vectors, told))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q, known = sent.value
            none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            best = {lo: none for lo in range(0, len(q_ids), blocks.queries)}
            for d_ids, d in _pieces(batches, blocks.documents):
                for lo, held in best.items():
                    hi = min(lo + blocks.queries, len(q_ids))
                    s = score(q.part(lo, hi), d, known[lo:hi])
                    s = s if own else np.where(q_ids[lo:hi, None] != d_ids[None, :], s, -np.inf)
                    # Only what reaches the k-th best so far, and the k-th best here, is looked at.
                    least = np.where(np.bincount(held[0], minlength=hi - lo) >= k, np.inf, -np.inf)
                    np.minimum.at(least, held[0], held[2])
                    if s.shape[1] > k:
                        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                    query, at = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                    best[lo] = _kept(np.concatenate([held[0], query]), np.concatenate([held[1], d_ids[at]]), np.concatenate([held[2], s[query, at]]), k)
            for lo, (query, doc, s) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[lo + query]), pa.array(doc), pa.array(s)], ["query_id", "doc_id", "score"])

        part = stage(data.mapInArrow(run, "query_id long, doc_id long, score double"), "met")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def blocked_top_k(queries: DataFrame, documents: DataFrame, score: Score, k: int, competition: bool = False, blocks: Blocks | None = None) -> DataFrame:
    """The k best documents (doc_id, d) of each query (query_id, q) by score, then id; a query is never its own answer, nor is what scores minus infinity."""
    return top_k(_top(queries, documents, lambda q, d, _: score(q, d), k, blocks or Blocks()), k, competition)


#: Scores are rounded to so many places, and sums of them and of their squares are taken in integers of these.
MICRO, HALF = 10**6, 1 << 31


def score_moments(queries: DataFrame, documents: DataFrame, scores: dict[str, Score], blocks: Blocks | None = None) -> DataFrame:
    """Mean and sample deviation of each score over the documents that it is defined for, but the query itself: (query_id, mean_x, std_x for each x).

    Scores have six places, so that their sums are exact in integers: they depend neither on the order of rows nor on cancellation.
    """
    blocks = blocks or Blocks()
    data = _usable(documents, "doc_id", "d")
    columns = [f"{part}_{name}" for name in scores for part in ("n", "sum", "high", "low")]
    found = None
    for ids, vectors, _ in _rounds(queries):
        sent = documents.sparkSession.sparkContext.broadcast((ids, vectors))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            out = np.zeros((len(columns), len(q_ids)), np.int64)
            for d_ids, d in _pieces(batches, blocks.documents):
                for lo in range(0, len(q_ids), blocks.queries):
                    hi = min(lo + blocks.queries, len(q_ids))
                    for i, score in enumerate(scores.values()):
                        s = score(q.part(lo, hi), d)
                        other = (q_ids[lo:hi, None] != d_ids[None, :]) & (s > -np.inf)
                        whole = np.rint(np.where(other, s, 0.0) * MICRO).astype(np.int64)
                        squares = whole * whole
                        out[4 * i : 4 * i + 4, lo:hi] += [other.sum(axis=1), whole.sum(axis=1), (squares // HALF).sum(axis=1), (squares % HALF).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids), *map(pa.array, out)], ["query_id", *columns])

        part = stage(data.mapInArrow(run, ", ".join(["query_id long", *[f"{c} long" for c in columns]])), "moments")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    sums = found.groupBy("query_id").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in columns])
    each = []
    for x in scores:
        n, total, squares = F.col(f"n_{x}").cast("double"), F.col(f"sum_{x}"), F.col(f"high_{x}") * HALF + F.col(f"low_{x}")
        around = (F.col(f"n_{x}").cast("decimal(13,0)") * squares.cast("decimal(25,0)")).cast("decimal(38,0)") - (total.cast("decimal(19,0)") * total.cast("decimal(19,0)")).cast("decimal(38,0)")
        each.append((total.cast("double") / MICRO / F.greatest(n, F.lit(1.0))).alias(f"mean_{x}"))
        each.append((F.sqrt(around.cast("double") / F.greatest(n * (n - 1), F.lit(1.0))) / MICRO).alias(f"std_{x}"))
    return sums.select("query_id", *each)


def score_histogram(vectors: DataFrame, score: Score, blocks: Blocks | None = None) -> DataFrame:
    """(micro, n): how many unordered pairs of vectors (id, v) with different ids have each score, in millionths; no pair is emitted."""
    blocks = blocks or Blocks()
    data = _usable(vectors.select(F.col("id").alias("doc_id"), F.col("v").alias("d")), "doc_id", "d")
    found = None
    for ids, held, _ in _rounds(vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q"))):
        sent = vectors.sparkSession.sparkContext.broadcast((ids, held))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q = sent.value
            unit_range = np.zeros(2 * MICRO + 1, np.int64)  # scores from -1 to 1, counted where they are
            counts: dict[int, int] = {}  # others: at most one entry for each score of six places
            for d_ids, d in _pieces(batches, blocks.documents):
                for lo in range(0, len(q_ids), blocks.queries):
                    hi = min(lo + blocks.queries, len(q_ids))
                    if q_ids[lo:hi].min() >= d_ids.max():
                        continue  # each pair is counted at its greater id; ids mostly lie in order, so this spares half the products
                    s = score(q.part(lo, hi), d)
                    whole = np.rint(s[(q_ids[lo:hi, None] < d_ids[None, :]) & (s > -np.inf)] * MICRO).astype(np.int64)
                    inside = np.abs(whole) <= MICRO
                    unit_range += np.bincount(whole[inside] + MICRO, minlength=len(unit_range))
                    micro, n = np.unique(whole[~inside], return_counts=True)
                    for m, k in zip(micro.tolist(), n.tolist(), strict=True):
                        counts[m] = counts.get(m, 0) + k
            at = np.flatnonzero(unit_range)
            yield pa.RecordBatch.from_arrays([pa.array(at - MICRO), pa.array(unit_range[at])], ["micro", "n"])
            yield pa.RecordBatch.from_pydict({"micro": list(counts), "n": list(counts.values())}, pa.schema([("micro", pa.int64()), ("n", pa.int64())]))

        part = stage(data.mapInArrow(run, "micro long, n long"), "histogram")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("micro").agg(F.sum("n").alias("n"))


def blocked_fusion(queries: DataFrame, documents: DataFrame, scores: dict[str, tuple[Score, float]], k: int, blocks: Blocks | None = None) -> DataFrame:
    """The k best by a weighted sum of scores, each standardised within the query (sample deviation, at least 1e-6) and rounded to nine places.

    Two passes: moments first, which then travel with the queries; no score of a pair is ever written.
    """
    moments = score_moments(queries, documents, {x: s for x, (s, _) in scores.items()}, blocks)
    told = F.array(*[F.col(f"{p}_{x}") for x in scores for p in ("mean", "std")]).alias("told")
    asked = queries.join(moments, "query_id").select("query_id", "q", told)

    def fused(q: Ragged, d: Ragged, known: np.ndarray) -> np.ndarray:
        total, there = np.zeros((len(q), len(d)), np.int64), np.ones((len(q), len(d)), bool)  # billionths
        for i, (score, weight) in enumerate(scores.values()):
            s = score(q, d)
            there &= s > -np.inf
            part = weight * (np.where(there, s, 0.0) - known[:, 2 * i, None]) / np.maximum(known[:, 2 * i + 1, None], 1e-6)
            total += np.trunc(part * 1e9 + np.copysign(0.5, part)).astype(np.int64)
        return np.where(there, np.sign(total) * ((np.abs(total) + 500) // 1000) / 1e6, -np.inf)

    return top_k(_top(asked, documents, fused, k, blocks or Blocks()), k)
