"""What the operators share: table access and word hashing, and the staged tables of the package."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumeline.sources.staged import shared_dir, stage, unstage  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """`name`, with underscores in front until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def one_text_each(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids in `ids`, a bounded table: of rows that share an id, the one with the smallest text hash.

    So the result is no larger than `ids` however often an id comes; Spark prunes each partition to one row for an id
    before the shuffle.
    """
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    found = docs.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text")
    return found.withColumn("_first", F.row_number().over(order)).filter("_first = 1").drop("_first")


class WordHash(dict):
    """64-bit hashes of words. A worker keeps at most `LIMIT` of them; beyond that it starts anew."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHash()

#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _running(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=np.uint64)])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n consecutive word hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    sums = _running(hashes)
    return mix((sums[n:] - sums[:-n]) * _powers(_INVERSE, m))


def run_hashes(hashes: np.ndarray, lengths: list[int], at: np.ndarray) -> np.ndarray:
    """The same for the runs of several lengths that start `at`, a column for each; a run that does not fit has hash 0."""
    sums, back = _running(hashes), _powers(_INVERSE, len(hashes) + 1)[at]
    ends = [np.minimum(at + n, len(hashes)) for n in lengths]
    return np.stack([np.where(at + n <= len(hashes), mix((sums[e] - sums[at]) * back), np.uint64(0)) for n, e in zip(lengths, ends, strict=True)], axis=1)


def shingles(text: str, n: int = 5) -> np.ndarray:
    """The set of n-word shingles of a text, hashed and sorted; a shorter text is one shingle, a wordless one none."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = WORDS.of(words)
    return np.unique(gram_hashes(hashes, min(n, len(words))))
