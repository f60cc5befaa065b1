"""Quality scores by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled good; the unlabelled sample is drawn from all documents of the training folds,
whatever their label. A text becomes a short dense vector of surface statistics (symbols, capitals, repetition, word
lengths, fields, stop-like words) and their squares; a logistic model minimises
    pi * R+(g) + max(0, R-u(g) - pi * R-p(g)),
stepping against the negative part where it falls under zero. The class prior pi is estimated from the data: the largest
share of positives that the unlabelled score distribution can hold, by the lowest ratio of the two distribution tails.

Only a bounded sample is learnt from, a vector of surface counts and their squares for each of its rows. Two bounds hold, each a
parameter: `max_positive` for rows labelled good, and `max_unlabelled` for rows that are drawn whatever their label.
Defined results: a null text is an empty one and gets its vector's score. Null or repeated labels: null is no positive,
each positive row counts, and of rows that share a doc_id one text is learnt from. With no positive or no document to learn from, every score is 0.5. Repeated rows give repeated
rows. Extra columns are not read by `quality`; `keep_good` returns all columns it was given.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from plumeline.llm.common import fresh, one_text_each, whole_text
from plumeline.llm.ftrl import held_out

_KIND = np.zeros(256, np.uint8)  # 0 symbol, 1 lower or non-ASCII, 2 capital, 3 digit, 4 space, 5 line end
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5


@dataclass(frozen=True)
class PuParams:
    max_positive: int = 12_000
    max_unlabelled: int = 12_000
    steps: int = 600
    rate: float = 0.05
    l2: float = 1e-3


def vector(text: str) -> np.ndarray:
    """Surface statistics of a whole text, all between 0 and about 1."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    n = max(1, len(raw))
    kinds = _KIND[raw]
    share = np.bincount(kinds, minlength=6) / n
    pairs = np.bincount(kinds[:-1] * 6 + kinds[1:], minlength=36) / n if len(raw) > 1 else np.zeros(36)
    words = text.split()
    w = max(1, len(words))
    lines = text.split("\n")
    counts = np.bincount(raw, minlength=256)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    more = [
        len(set(words)) / w, len(set(lines)) / len(lines), min(1.0, len(lines) / w), min(1.0, lengths.mean() / 20), min(1.0, lengths.std() / 20), (lengths <= 3).mean(), (lengths > 12).mean(),
        min(1.0, np.log1p(len(words)) / 12), counts[ord(".")] / w, counts[ord(",")] / w, counts[ord("|")] / w, counts[ord("!")] / w, counts[ord("?")] / w,
        float(np.count_nonzero((counts > 0)[33:48]) + np.count_nonzero((counts > 0)[58:65])) / 22, counts[33:48].max() / n, len(zlib.compress(data, 1)) / (n + 11),
    ]
    return np.concatenate([share, pairs[[1 * 6, 2 * 6 + 2, 1 * 6 + 2, 4 * 6 + 2, 0, 1 * 6 + 3]], more]).clip(0, 2)


_EMPTY = vector("")


def _risk_step(theta: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk with the logistic loss; where the negative part is below 0, minus that part's gradient."""
    gp, gu = 1 / (1 + np.exp(-(positive @ theta))), 1 / (1 + np.exp(-(unlabelled @ theta)))
    softplus = lambda g: -np.log(np.maximum(1 - g, 1e-12))
    negative = softplus(gu).mean() - prior * softplus(gp).mean()
    slope = unlabelled.T @ gu / len(gu) - prior * (positive.T @ gp) / len(gp)
    if negative < 0:
        return -slope
    return prior * (positive.T @ (gp - 1)) / len(gp) + slope


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float, params: PuParams) -> np.ndarray:
    theta, m, v = np.zeros(positive.shape[1]), np.zeros(positive.shape[1]), np.zeros(positive.shape[1])
    for t in range(1, params.steps + 1):
        g = _risk_step(theta, positive, unlabelled, prior) + params.l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= params.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives in the unlabelled: the least of P(u <= c) / P(p <= c), and of the other tail, over cuts that 2 % of either side reach."""
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(np.concatenate([np.quantile(p, np.linspace(0.02, 0.98, 97)), np.quantile(u, np.linspace(0.02, 0.98, 97))]))
    best = 1.0
    for fp, fu in zip(1 - np.searchsorted(p, cuts, "left") / len(p), 1 - np.searchsorted(u, cuts, "left") / len(u), strict=True):
        if fp >= 0.05:
            slack = np.sqrt(fu * (1 - fu) / len(u)) + np.sqrt(fp * (1 - fp) / len(p))
            best = min(best, (fu + slack) / fp)
    return float(min(0.99, max(0.01, best)))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    theta: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(expand(x, self.mean, self.spread) @ self.theta, -35, 35)))


def expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = ((x - mean) / spread).clip(-4, 4)
    return np.concatenate([np.ones((len(z), 1)), z, z * z / 4], axis=1)


def fit_vectors(positive: np.ndarray, unlabelled: np.ndarray, params: PuParams) -> QualityModel:
    width = len(_EMPTY)
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(2 * width + 1), 0.5)
    mean, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = expand(positive, mean, spread), expand(unlabelled, mean, spread)
    first = _descend(p, u, 0.5, params)  # ranks well whatever the prior
    prior = estimate_prior(p @ first, u @ first)
    return QualityModel(mean, spread, _descend(p, u, prior, params), prior)


def _vectors(rows: DataFrame) -> DataFrame:
    """The text column of `rows`, the last one, replaced by its vector."""
    out = StructType([*rows.schema.fields[:-1], StructField("x", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])

    return rows.mapInArrow(run, out)


def fit(documents: DataFrame, labels: DataFrame, params: PuParams) -> QualityModel:
    """`labels` (doc_id, label) has label 1 for trusted positives; the caller has taken the held-out fold out."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    trusted = labels.filter("doc_id is not null and label = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_positive)
    # Bounded by max_positive + max_unlabelled ids of 8 bytes.
    open_ = docs.filter(~held_out(5, 0)).select("doc_id").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(params.max_unlabelled)
    sample = trusted.select("doc_id", F.lit(1).alias("trusted")).unionByName(open_.filter("doc_id is not null").select("doc_id", F.lit(0).alias("trusted")))
    # One text for an id, so the driver gets no more than the sample's rows.
    rows = _vectors(one_text_each(docs, sample)).join(F.broadcast(sample), "doc_id").select("trusted", "x").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), len(_EMPTY))
    return fit_vectors(x[rows["trusted"] == 1], x[rows["trusted"] == 0], params)


def with_score(documents: DataFrame, model: QualityModel, cut: float, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """All columns, and the score and prediction of the column text; input columns of those names give way."""
    fields = [f for f in documents.schema.fields if f.name not in (score, predicted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [vector(t.as_py() or "") for t in batch.column("text")]
            # Rounded, so that a text's score does not depend on the batch it came in.
            p = model.score(np.array(x, np.float64).reshape(len(x), len(_EMPTY))).round(9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= cut).astype(np.int32))], [*batch.schema.names, score, predicted])

    out = StructType([*fields, StructField(score, DoubleType()), StructField(predicted, IntegerType())])
    return documents.select(*[f.name for f in fields]).mapInArrow(run, out)


def _fold_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(~held_out(5, 0))


def quality(documents: DataFrame, labels: DataFrame, params: PuParams | None = None, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(documents, _fold_labels(labels), params or PuParams())
    scored = with_score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, cut)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, params: PuParams | None = None, cut: float = 0.3) -> DataFrame:
    """The documents whose predicted quality is 1, with the columns they came with."""
    model = fit(documents, _fold_labels(labels), params or PuParams())
    score, predicted = fresh(documents.columns, "_score"), fresh(documents.columns, "_predicted")
    return with_score(documents, model, cut, score, predicted).filter(F.col(predicted) == 1).select(*documents.columns)
