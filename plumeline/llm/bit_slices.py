"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. The index holds, for each block of rows and each component, one bitmap for each binary digit
(a slice): a bit for each row. A query's scores over a block are a sum of multiples of components, computed on slices alone: bitmaps
are added digit by digit with AND, OR and XOR, 64 rows in a word, many queries at once; negative factors take the complement of the
slices, whose surplus is one number for each query. From the most significant slice of the sum downward, rows with the bit set
either fit among the k (they are in), or are too many (the others are out). Rows that are open at the last slice have equal scores,
and the first of them by id fill what is left, so the boundary is exact.

The index stays where it is. Queries come to it in rounds, each a broadcast of at most `SENT` bytes, and a task keeps k rows for each
query of a round over all the blocks it reads; what is shuffled is k rows for each query and task.

Defined results: vectors that are null, hold null or non-finite components, or reach `LIMIT` in a quantised component or `DIMS` in
length (so that every score is a long), take no part, and neither do rows without an id. Vectors of different lengths do not meet. Rows
that share the query's id are its own and no candidates; a repeated query row has a repeated result, a repeated candidate
is as many candidates. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeline.llm.common import stage, unstage

LIMIT, DIMS = 1 << 26, 1 << 10
#: Bytes of queries in a round.
SENT = 16 << 20
#: Factors are taken apart into digits of so many bits; multiples of a component by one digit are tabled.
DIGIT = 6
#: Bytes of the table of multiples; components are taken in groups that fit.
TABLE = 48 << 20


@dataclass(frozen=True)
class SliceParams:
    k: int = 20
    scale: int = 64
    #: Rows in a block of the index, and queries added up together: about so many, and at most twice as many.
    block: int = 8192
    queries: int = 512


def quantised(embedding: str, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def _usable(rows: DataFrame, scale: int) -> DataFrame:
    """(id, dims, x) of the rows that take part."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LIMIT / scale)) & (F.size("embedding") < DIMS)
    kept = rows.filter(F.col("id").isNotNull() & F.coalesce(fits, F.lit(False)))
    return kept.select(F.col("id").cast("long").alias("id"), quantised("embedding", scale).cast("array<int>").alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, x) of at most `most` rows of one length."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    for batch in batches:
        ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("x")
        ends = lists.offsets.to_numpy()
        sizes, values = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            held.setdefault(int(size), []).append((ids[at], values[ends[at][:, None] + np.arange(size)].reshape(len(at), size)))
            if sum(len(p[0]) for p in held[size]) >= most:
                all_ids, x = joined(held[size])
                full = len(all_ids) // most * most
                yield from ((all_ids[i : i + most], x[i : i + most]) for i in range(0, full, most))
                held[size] = [(all_ids[full:], x[full:])]
    for parts in held.values():
        ids, x = joined(parts)
        if len(ids):
            yield ids, x


def slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of integers -> the least of each component, and the bitmaps (component, digit, word) of what is above it."""
    least = x.min(axis=0, initial=LIMIT).astype(np.int64)
    above = (x - least).T
    digits = max(1, int(above.max(initial=0)).bit_length())
    words = -(-len(x) // 64)
    bits = np.zeros((x.shape[1], digits, words * 64), np.uint8)
    for b in range(digits):
        bits[:, b, : len(x)] = (above >> b) & 1
    return least, np.packbits(bits, axis=2, bitorder="little").view("<u8")


def _indexed(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, most):
            order = np.argsort(ids, kind="stable")
            least, bits = slices(x[order])
            yield pa.RecordBatch.from_pydict({"dims": [x.shape[1]], "digits": [bits.shape[1]], "ids": [ids[order].astype("<i8").tobytes()], "least": [least.astype("<i8").tobytes()], "bits": [bits.tobytes()]}, _INDEX)

    return run


_INDEX = pa.schema([("dims", pa.int32()), ("digits", pa.int32()), ("ids", pa.binary()), ("least", pa.binary()), ("bits", pa.binary())])


def _asked(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, most):
            yield pa.RecordBatch.from_pydict({"dims": [x.shape[1]], "query_ids": [ids.astype("<i8").tobytes()], "q": [x.astype("<i4").tobytes()]}, pa.schema([("dims", pa.int32()), ("query_ids", pa.binary()), ("q", pa.binary())]))

    return run


def _add(total: list[np.ndarray], more: list[np.ndarray]) -> None:
    """total += more, both as slices from the least significant; total has room for the sum."""
    carry = None
    for i, a in enumerate(total):
        if i < len(more):
            b = more[i]
            half = a ^ b
            out = a & b
            if carry is None:
                total[i] = half
            else:
                total[i] = half ^ carry
                np.bitwise_and(half, carry, out=half)
                np.bitwise_or(out, half, out=out)
            carry = out
        elif carry is None:
            return
        else:
            total[i] = a ^ carry
            carry = a & carry


def _multiples(bits: np.ndarray, most: int) -> np.ndarray:
    """Slices (component, digit, word) -> those of 0 to `most` times each component, (times, digit, component, word)."""
    dims, digits, words = bits.shape
    width = digits + most.bit_length()
    out = np.zeros((most + 1, width, dims, words), np.uint64)
    for times in range(1, most + 1):
        top = times.bit_length() - 1
        total = list(out[times ^ (1 << top)])
        shifted = [np.zeros((dims, words), np.uint64)] * top + [bits[:, b] for b in range(digits)]
        _add(total, shifted)
        out[times] = total
    return out


def block_sums(bits: np.ndarray, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Slices of a block and queries -> slices (query, word) of a sum for each query, and what to take from it.

    The sum less that number is the inner product of the query with what the rows have above the least of each component.
    """
    dims, digits, words = bits.shape
    size, whole = np.abs(q.astype(np.int64)), (1 << digits) - 1
    room = int((size.sum(axis=1) * whole).max(initial=0)).bit_length()
    total = [np.zeros((len(q), words), np.uint64) for _ in range(max(1, room))]
    n_digits = max(1, -(-int(size.max(initial=0)).bit_length() // DIGIT))
    most = int(min(size.max(initial=0), (1 << DIGIT) - 1))
    group = max(1, TABLE // (2 * (most + 1) * (digits + DIGIT) * words * 8))
    lot = max(1, (1 << 13) // max(1, words))  # queries whose bitmaps stay in the processor's cache
    for first in range(0, dims, group):
        part = bits[first : first + group]
        table = np.stack([_multiples(part, most), _multiples(~part, most)])
        for at in range(part.shape[0]):
            factor, negative = size[:, first + at], (q[:, first + at] < 0).astype(np.intp)
            for d in range(n_digits):
                times = (factor >> (DIGIT * d)) & ((1 << DIGIT) - 1)
                if times.any():
                    for lo in range(0, len(q), lot):
                        rows = slice(lo, lo + lot)
                        some = [s[rows] for s in total[DIGIT * d :]]
                        sign, row = negative[rows], times[rows]
                        _add(some, [table[sign, row, b, at] for b in range(min(table.shape[2], len(some)))])
                        for s, new in zip(total[DIGIT * d :], some, strict=True):
                            s[rows] = new
    return total, np.where(q < 0, size, 0).sum(axis=1) * whole


def _first_bits(bitmap: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the first set bits of each bitmap, at most so many."""
    query, row = np.nonzero(np.unpackbits(bitmap.view(np.uint8), axis=1, bitorder="little"))
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = place < most[query]
    return query[kept], row[kept]


def top_rows(total: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, sum) of each query's k largest sums among its valid rows, ties by row."""
    inside, open_ = np.zeros_like(valid), valid
    count = np.zeros(len(valid), np.int64)
    for s in reversed(total):
        with_bit = open_ & s
        more = np.bitwise_count(with_bit).sum(axis=1, dtype=np.int64)
        fits = (count + more <= k)[:, None]
        inside = np.where(fits, inside | with_bit, inside)
        open_ = np.where(fits, open_ ^ with_bit, with_bit)
        count += np.where(fits[:, 0], more, 0)
    query, row = (np.concatenate(x) for x in zip(_first_bits(inside, count), _first_bits(open_, k - count), strict=True))
    word, bit = row >> 6, (row & 63).astype(np.uint64)
    score = np.zeros(len(row), np.int64)
    for i, s in enumerate(total):
        score += ((s[query, word] >> bit) & np.uint64(1)).astype(np.int64) << i
    return query, row, score


def _best_in_block(ids: np.ndarray, least: np.ndarray, bits: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of a block's best rows."""
    words = bits.shape[2]
    total, surplus = block_sums(bits, q)
    rows = np.zeros(words * 64, np.uint8)
    rows[: len(ids)] = 1
    valid = np.repeat(np.packbits(rows, bitorder="little").view("<u8")[None, :], len(q), axis=0)
    own_from, own_to = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for i in np.flatnonzero(own_from < own_to):
        for row in range(own_from[i], own_to[i]):
            valid[i, row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
    found = [top_rows([s[lo : lo + 64] for s in total], valid[lo : lo + 64], k) for lo in range(0, len(q), 64)]
    query = np.concatenate([f[0] + 64 * i for i, f in enumerate(found)])
    row, score = (np.concatenate([f[j] for f in found]) for j in (1, 2))
    return query, ids[row], score - surplus[query] + (q.astype(np.int64) @ least)[query]


def _met(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[np.ndarray]] = {}
        names: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                ids, query_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["query_ids"], "<i8")
                words = -(-len(ids) // 64)
                bits, q = np.frombuffer(r["bits"], "<u8").reshape(r["dims"], r["digits"], words), np.frombuffer(r["q"], "<i4").reshape(len(query_ids), r["dims"])
                found = _best_in_block(ids, np.frombuffer(r["least"], "<i8"), bits, query_ids, q, k)
                names[r["block"]] = query_ids
                known = best.get(r["block"], [np.empty(0, np.int64)] * 3)
                query, vec, score = (np.concatenate([a, b]) for a, b in zip(known, found, strict=True))
                order = np.lexsort((vec, -score, query))
                query = query[order]
                order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
                best[r["block"]] = [np.concatenate([a, b])[order] for a, b in zip(known, found, strict=True)]
        for block, (query, vec, score) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), block)), pa.array(query), pa.array(names[block][query]), pa.array(vec), pa.array(score)], ["block", "place", "query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, params: SliceParams | None = None) -> DataFrame:
    """query_id, rank, vec_id and score for `rows` (id, embedding) and `queries` (id, embedding)."""
    params = params or SliceParams()
    data, asked = _usable(rows, params.scale), stage(_usable(queries, params.scale), "queries")
    n, m = data.count(), asked.count()
    index = stage(data.repartition(max(1, math.ceil(n / params.block))).mapInArrow(_indexed(2 * params.block), "dims int, digits int, ids binary, least binary, bits binary"), "bit-slices")
    longest = asked.agg(F.max(F.size("x"))).first()[0] or 1
    each = max(1, SENT // (2 * params.queries * (4 * longest + 8)))
    parts = max(1, math.ceil(m / params.queries))
    blocks = asked.repartition(parts).mapInArrow(_asked(2 * params.queries), "dims int, query_ids binary, q binary")
    blocks = stage(blocks.withColumn("round", (F.spark_partition_id() / each).cast("int")).withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    found = []
    for r in range(math.ceil(parts / each)):
        sent = F.broadcast(blocks.filter(F.col("round") == r).drop("round"))
        found.append(stage(index.join(sent, "dims").mapInArrow(_met(params.k), "block long, place long, query_id long, vec_id long, score long"), "met"))
    unstage(index, blocks, asked)
    best = functools.reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")
