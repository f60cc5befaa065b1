"""Quartile bucket digests: a fingerprint of byte triplets and a bounded difference score between two of them.

Every window of five bytes gives six triplets that hold its first byte; each is hashed to one of 256 buckets. The
digest holds, in hexadecimal, the logarithm of the length, two quartile ratios, and two bits for each bucket that name
the quartile its count falls in. The difference of two digests adds the distances of bucket quartiles (the farthest
pair counts twice), of lengths and of ratios; likeness is one minus that difference over what unrelated digests
have on average, and never under 0.

Defined results: a null text is an empty one; texts under three bytes have no triplets and an all-zero body; equal
texts have equal fingerprints. Documents are ordered by descending doc_id (nulls last), then CRC-32 and text;
a single document is its own next one. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.llm.common import stage, whole_text

BUCKETS = 256
#: Offsets from a window's first byte of the other two bytes of its triplets.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: What two unrelated bodies differ by: 1.625 a bucket when all quartiles are equally likely.
UNRELATED = 1.625 * BUCKETS
_STEP = np.array([0, 1, 2, 6])
_CHUNK = 1 << 16


def _counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for k, (i, j) in enumerate(TRIPLETS):
        n = len(raw) - j
        for at in range(0, max(n, 0), _CHUNK):
            end = min(at + _CHUNK, n)
            h = raw[at:end] * np.uint32(0x9E3779B1) + raw[at + i : end + i] * np.uint32(0x85EBCA77) + raw[at + j : end + j] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    counts = _counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, round(8 * math.log2(len(data) + 1)))
    ratios = (15 * q1 // q3 << 4 | 15 * q2 // q3) if q3 else 0
    return bytes([length, ratios]).hex() + body.astype(np.uint8).tobytes().hex()


def _parts(fingerprint: str) -> tuple[int, int, int, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    body = np.frombuffer(raw, np.uint8)[2:].astype(np.int16)
    return raw[0], raw[1] >> 4, raw[1] & 15, np.concatenate([body & 3, body >> 2 & 3, body >> 4 & 3, body >> 6])


def likeness(one: str, other: str) -> float:
    """1 for equal digests, 0 for those as far apart as unrelated texts."""
    if one == other:
        return 1.0
    a, b = _parts(one), _parts(other)
    away = int(_STEP[np.abs(a[3] - b[3])].sum()) + min(abs(a[0] - b[0]), 64) + abs(a[1] - b[1]) + abs(a[2] - b[2])
    return max(0.0, 1.0 - away / UNRELATED)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id: int | None, text: str, own: str, following: str, theirs: str) -> tuple:
    changed = edited(text, following)
    mark = own if changed == text else digest(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own, mark, likeness(own, mark), likeness(own, theirs)


def _sorted_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> each compared with the next; a partition's first and last texts go along as its ends."""
    part, held, schema = TaskContext.get().partitionId(), None, _SCHEMA.append(pa.field("end", pa.int32())).append(pa.field("part", pa.int32())).append(pa.field("text", pa.string()))
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = cell.as_py()
            own = digest(text)
            rows.append((*_compared(*held, text, own), 0, part, None) if held else (doc_id, *[None] * 6, 1, part, text))
            held = (doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)
    if held:
        yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "end": 2, "part": part, "text": held[1]}], schema)


def _ends_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_compared(d, t, digest(t), f, digest(f)) for d, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(_OUT, r, strict=True)) for r in rows], _SCHEMA)


def fingerprint_with_next(documents: DataFrame) -> DataFrame:
    """Each document's digest, that of its edited text, and the likeness to both that and the next document's.

    One range shuffle puts the texts in order; neighbours are then compared inside a partition. Only the two ends of
    each partition meet in a second, small join.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    docs = docs.withColumn("_tie", F.crc32(F.col("text").cast("binary")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie")]
    run = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    done = stage(run.mapInArrow(_sorted_run, f"{_DDL}, end int, part int, text string"), "digests")
    # As many rows as the shuffle has partitions, each one number.
    parts = sorted(r.part for r in done.filter("end = 1").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, _next int")
    heads = done.filter("end = 1").select(F.col("part").alias("_next"), F.col("text").alias("following"))
    ends = done.filter("end = 2").select("doc_id", "text", "part").join(F.broadcast(after), "part").join(heads, "_next").select("doc_id", "text", "following")
    return done.filter("end = 0").select(*_OUT).unionByName(ends.mapInArrow(_ends_run, _DDL))
