"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, with DataFrame functions.

The rows are cut into partitions of at most 2**20 rows. How many rows of each partition go to each shard is drawn
exactly: partition by partition, a multivariate hypergeometric sample of the places still open. Every partition is put
in random order locally and dealt out by its row of the matrix; every shard is then put in random order again, in
buckets of its random keys, so no task holds a whole shard. Shard sizes differ by at most one (law `rows`).

The matrix has partitions x shards numbers (one row of it for a million documents) and is drawn on the driver, each
number in constant time: 1e11 documents are 1.5 million draws, some fifteen seconds.
Defined results: a null text has size 1 and the CRC-32 of nothing. Repeated rows and null ids are rows like any other.
An empty table gives no rows; extra columns are not read. One seed and one layout of the input give one result.
"""

from __future__ import annotations

import random
from itertools import accumulate
from math import e, floor, lgamma, log, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeline.llm.common import fresh, stage, unstage

CHUNK_BITS = 20


def _log_ways(good: int, bad: int, drawn: int, k: int) -> float:
    """-ln of the number of ways to have k good among `drawn`, but for a constant."""
    return lgamma(k + 1) + lgamma(good - k + 1) + lgamma(drawn - k + 1) + lgamma(bad - drawn + k + 1)


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` places taken from good + bad are good.

    Few draws are made one by one; more by ratio of uniforms under a table mountain (Stadlober 1989), which takes the
    same time whatever the numbers are.
    """
    low, high, total = max(0, drawn - bad), min(good, drawn), good + bad
    if low == high:
        return low
    if min(drawn, good) <= 12:
        taken, of = (drawn, good) if drawn <= good else (good, drawn)
        found = 0
        for k in range(taken):
            found += rng.random() * (total - k) < of - found
        return found
    mean = drawn * good / total
    spread = sqrt(mean * bad / total * (total - drawn) / (total - 1) + 0.5)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    peak = _log_ways(good, bad, drawn, mode)
    width = 2 * sqrt(2 / e) * spread + 3 - 2 * sqrt(3 / e)
    while True:
        u, v = rng.random(), rng.random()
        if not u:
            continue
        k = floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * log(u) <= peak - _log_ways(good, bad, drawn, k):
            return k


def communication_matrix(partition_rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition, how many of its rows go to each shard; rows sum to the partitions', columns to the shards' sizes."""
    rng, total = random.Random(seed), sum(partition_rows)
    places = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for rows in partition_rows:
        left, open_, row = rows, sum(places), []
        for s in range(shards):
            open_ -= places[s]
            row.append(hypergeometric(rng, places[s], open_, left))
            left -= row[-1]
        places = [p - r for p, r in zip(places, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 0, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """`rows` with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard). Input columns of these names give way; all others stay."""
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    taken = [*rows.columns, "shard", "slot"]
    row, part, ends, local, key, bucket, n, start, rank = (fresh(taken, c) for c in ("_row", "_part", "_ends", "_local", "_key", "_bucket", "_n", "_start", "_rank"))
    staged = stage(rows.withColumn(row, F.monotonically_increasing_id()), "rows")
    numbered = staged.withColumn(part, F.shiftright(row, chunk_bits))
    sizes = sorted((r[0], r[1]) for r in numbered.groupBy(part).agg(F.count("*")).collect())
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    plan = spark.createDataFrame([(p, list(accumulate(m))) for (p, _), m in zip(sizes, matrix, strict=True)], f"{part} long, {ends} array<long>")

    first, second = F.xxhash64(F.lit(seed), F.lit(1), row), F.xxhash64(F.lit(seed), F.lit(2), row)
    order = F.row_number().over(Window.partitionBy(part).orderBy(first, row)) - 1
    # One row for a million documents: 130 bytes with 16 shards.
    dealt = numbered.withColumn(local, order).join(F.broadcast(plan), part)
    dealt = dealt.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col(local)))).withColumn(key, second)

    # The second order: buckets by the key's leading part, then the key. Bucket sizes come from the keys alone.
    buckets = max(1, -(-sum(n for _, n in sizes) // (shards << max(0, chunk_bits - 2))))
    dealt = dealt.withColumn(bucket, F.floor(F.shiftrightunsigned(key, 1) / float(2**63) * buckets).cast("long"))
    dealt = stage(dealt.select(*rows.columns, "shard", bucket, key, row), "dealt")
    unstage(staged)
    counts = dealt.groupBy("shard", bucket).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", bucket, before.alias(start))  # a row for each bucket of 2**18 documents
    within = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(key, row)) - 1
    placed = dealt.withColumn(rank, within).join(starts, ["shard", bucket])
    return placed.select(*rows.columns, "shard", (F.col(start) + F.col(rank)).cast("long").alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is not `key`) of every document."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = shuffle_into_shards(light, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
