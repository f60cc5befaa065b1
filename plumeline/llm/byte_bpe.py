"""Byte-level BPE by two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Defined results: a null text counts as empty; an empty text has no tokens, so `ids_sha256` and `decoded_sha256`
are the digests of nothing. Repeated rows give repeated rows. Extra columns of the input are not read. Texts of any
length are encoded whole. Python rather than native functions: merges by rank have no SQL form.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from plumeline.llm.common import whole_text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _pair(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each key."""
    return tuple(np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys)) for seed in (1, 2))


class PerfectHash:
    """A minimal perfect hash over a fixed key set: n keys take the slots 0 to n - 1.

    Keys fall in buckets of about four. The largest buckets first, each gets the smallest displacement that sends all
    its keys to free slots; buckets of one key, which come last, name one of the slots still free. So a lookup is one
    table read and one multiplication.
    """

    TRIES = 64

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        first, second = _pair(keys)
        bucket = (first % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken, slot_of = np.zeros(self.n, bool), np.empty(self.n, np.int64)
        self.shift, self.direct = np.zeros(self.buckets, np.uint64), np.zeros(self.buckets, bool)
        sizes, free = np.diff(starts), iter(())
        for b in np.argsort(-sizes, kind="stable").tolist():
            members = order[starts[b] : starts[b + 1]]
            if not len(members):
                break
            if len(members) == 1:
                if not self.direct.any():
                    free = iter(np.flatnonzero(~taken).tolist())
                slots, shift, self.direct[b] = np.array([s := next(free)]), s, True
            else:
                shift, slots = self._displaced(second[members], taken)
            self.shift[b], taken[slots], slot_of[members] = shift, True, slots
        self.keys: list[bytes] = [b""] * self.n
        for key, slot in zip(keys, slot_of.tolist(), strict=True):
            self.keys[slot] = key

    def _displaced(self, second: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
        for start in range(0, 1 << 24, self.TRIES):
            slots = self._slots(second[None, :], np.arange(start, start + self.TRIES, dtype=np.uint64)[:, None])
            ordered = np.sort(slots, axis=1)
            good = np.flatnonzero(~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
            if len(good):
                return start + int(good[0]), slots[good[0]]
        raise ValueError("no displacement found; are there equal keys?")

    def _slots(self, second: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = second ^ (shift * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """The slot of each key, -1 for those outside the set."""
        if not keys or not self.n:
            return [-1] * len(keys)
        first, second = _pair(keys)
        bucket = (first % np.uint64(self.buckets)).astype(np.int64)
        shift = self.shift[bucket]
        slots = np.where(self.direct[bucket], shift.astype(np.int64), self._slots(second, shift)).tolist()
        return [s if self.keys[s] == k else -1 for s, k in zip(slots, keys, strict=True)]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left: a heap of pairs over linked parts."""
    n = len(word)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    rank_of = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:  # a part of the pair has changed since
            continue
        alive[ends[i]] = False
        ends[i] = end
        if end < n:
            before[end] = i
            if (r := rank_of(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := rank_of(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


@dataclass
class BytePairCodec:
    """Encoder and decoder over a rank table and the pattern that splits texts into pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str
    cache_limit: int = 300_000
    _known: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # White space as Unicode's White_Space property has it; the default class also holds four control characters.
        self._split = regex.compile(self.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self._table = PerfectHash(list(self.ranks))
        self._slot_id = [str(self.ranks[k]) for k in self._table.keys]
        self._bytes = {str(rank): token for token, rank in self.ranks.items()}

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        for word, data, slot in zip(words, raw, self._table.find(raw), strict=True):
            self._known[word] = self._slot_id[slot] if slot >= 0 else " ".join(map(str, merge_bytes(data, self.ranks)))

    def encode(self, text: str) -> str:
        """The ids of a text in decimal, joined by a space."""
        words = self._split.findall(text)
        known = self._known
        try:
            return " ".join([known[w] for w in words])
        except KeyError:
            if len(known) > self.cache_limit:
                known.clear()
            self._learn([w for w in dict.fromkeys(words) if w not in known])
            return " ".join([known[w] for w in words])

    def decode(self, ids: str) -> bytes:
        return b"".join([self._bytes[i] for i in ids.split(" ")]) if ids else b""


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def _codec(path: str, pattern: str) -> BytePairCodec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def byte_bpe_round_trip(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (decimal, joined by a space) digest and count, and the digest of the decoded bytes, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                counts.append(ids.count(" ") + 1 if ids else 0)
                encoded.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The documents with their ids as an array column `token_ids`; all other columns stay."""
    fields = [c for c in documents.columns if c != "token_ids"]
    docs = documents.select(*fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            ids = [[int(i) for i in codec.encode(t).split()] for t in ((x.as_py() or "") for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "token_ids"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("token_ids", ArrayType(IntegerType()))]))
