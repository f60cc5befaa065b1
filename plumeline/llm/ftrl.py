"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: the presence of its words, of pairs of neighbouring words and of pairs with one word between them,
hashed to 2**22 coordinates. Per-coordinate rates and the L1 term leave few weights that are not zero; only those leave
a training task. Training is distributed: a bounded, documented sample of labelled rows is dealt to shards, each shard
runs its own passes, and the weights are averaged (parameter mixing). The averaged weights are a sorted array of a few
thousand numbers, which tasks get with the function that scores.

Defined results: a null text is an empty one and has the bias alone for a score. Documents with a null label or a null
doc_id are never learnt from; repeated labels of a document are learnt from once each, and of rows that share a doc_id one text is; without any usable label every
score is 0.5. Repeated rows give repeated rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.llm.common import WORDS, mix, one_text_each, stage, unstage, whole_text

_WORD = regex.compile(r"[\p{L}\p{N}_']+")
_MULTIPLIER, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class FtrlParams:
    """The settings were chosen by log loss on a fold inside the training rows (crc32 of 'inner:' and the id, mod 4); the held-out rows had no part in it."""

    bits: int = 22
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 1.0
    passes: int = 8
    #: Toxic documents are few; each counts so many times.
    positive_weight: float = 4.0
    rows_per_shard: int = 12_000
    #: A shard is one task; long texts make more shards.
    features_per_shard: int = 16_000_000
    #: At most so many labelled rows are learnt from, chosen by a hash of their ids.
    max_rows: int = 24_000


def features(text: str, bits: int) -> np.ndarray:
    """Sorted distinct coordinates of a text."""
    h = WORDS.of(_WORD.findall(text.lower()))
    pairs = mix(h[:-1] * _MULTIPLIER + h[1:])
    skips = mix((h[:-2] * _MULTIPLIER + h[2:]) ^ _SKIP)
    return np.unique(np.concatenate([mix(h), pairs, skips]) >> np.uint64(64 - bits)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]], params: FtrlParams) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (coordinates, label) rows; returns the non-zero weights. The last coordinate, 2**bits, is the bias."""
    z, n = np.zeros((1 << params.bits) + 1), np.zeros((1 << params.bits) + 1)
    bias = np.array([1 << params.bits])

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - params.l1, 0)
        return -shrunk / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2)

    order = np.random.default_rng(7)
    for _ in range(params.passes):
        for i in order.permutation(len(rows)):
            at = np.concatenate([rows[i][0], bias])
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - rows[i][1]
            g *= params.positive_weight if rows[i][1] else 1.0
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / params.alpha * w
            n[at] = ni + g * g
    used = np.flatnonzero((np.abs(z) > params.l1) & (n > 0))
    w = weights(used)
    return used[w != 0], w[w != 0]


def fit(documents: DataFrame, labels: DataFrame, params: FtrlParams) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from `labels` (doc_id, label) and the texts of `documents`: sorted coordinates and their weights."""
    usable = labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", "label")
    # Bounded by max_rows, 12 bytes each.
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(params.max_rows)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    texts = one_text_each(docs, sample)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [features(t.as_py(), params.bits).astype(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "at"])

    seen = stage(texts.mapInArrow(featured, "doc_id long, at array<int>").join(F.broadcast(sample), "doc_id"), "features")
    size = seen.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("features")).first()
    shards = max(1, -(-size.rows // params.rows_per_shard), -(-size.features // params.features_per_shard))
    rows = seen.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.assign(_size=pdf["at"].map(len)).sort_values(["doc_id", "label", "_size"])
        at, w = train([(x.astype(np.int64), int(y)) for x, y in zip(data["at"], data["label"], strict=True)], params)
        return pd.DataFrame({"at": at, "w": w})

    mixed = rows.groupBy("shard").applyInPandas(learn, "at long, w double").groupBy("at").agg((F.sum("w") / shards).alias("w"))
    found = mixed.filter("w <> 0").toPandas().sort_values("at")  # what the L1 term leaves: a few thousand numbers
    unstage(seen)
    return found["at"].to_numpy(np.int64), found["w"].to_numpy(np.float64)


def score_texts(documents: DataFrame, at: np.ndarray, w: np.ndarray, params: FtrlParams, cut: float) -> DataFrame:
    """doc_id, score and predicted for every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    bias = float(w[at == 1 << params.bits].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << params.bits, bool)
        known[at[at < 1 << params.bits]] = True
        for batch in batches:
            scores = []
            for text in batch.column(1):
                x = features(text.as_py(), params.bits)
                x = x[known[x]]
                scores.append(bias + (float(w[np.searchsorted(at, x)].sum()) if len(x) else 0.0))
            p = 1 / (1 + np.exp(-np.clip(np.array(scores, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32))], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(folds: int, fold: int, column: str = "doc_id"):
    """Whether crc32(doc_id as text) mod `folds` is `fold`."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, params: FtrlParams | None = None, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted; rows of `labels` in the held-out fold are not learnt from."""
    params = params or FtrlParams()
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(~held_out(3, 1))
    at, w = fit(documents, usable, params)
    return score_texts(documents, at, w, params, cut).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
