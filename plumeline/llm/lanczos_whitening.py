"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The rows X, quantised to integers and centred, are never decomposed. Each step asks for one pass over them, in which every task takes
its rows' products y = Xr with the step's vector and at once the sum of Xᵀy, so what leaves a task is as many numbers as a vector
has components. A left vector u, which has a number for each row, is never stored: it is Xz for a short z that the driver keeps, and
both sides are reorthogonalised in full against all before through Zᵀ(XᵀXr) and Vᵀ(Xᵀu). The singular values and vectors of the small
bidiagonal matrix give deviations and components; the steps end when the residuals of the wanted ones have reached rounding.

From one start a Krylov space holds one direction of each eigenvalue. So a second run starts at random across what was found, and ends
once it is settled below the last of them; if it is not, what it finds is taken in and another run follows.

Defined results: rows whose vector is null, or holds null or non-finite entries or entries that quantise to `LIMIT` or more, are left
out. Vectors of each length are fitted apart. Components without variance are left out, so a table of equal vectors, or of empty
ones, gives no rows. Of equal eigenvalues any basis may be given. A deviation that no long holds is null. Repeated rows give repeated
rows; a null vec_id stays null. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeline.llm.common import stage, unstage

LIMIT = 1 << 31
#: Rows of a block of the fit list.
BLOCK = 4096
#: A residual of so many units of rounding, relative to the largest deviation, is convergence.
ROUNDING = 8


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n distinct rows, their sums, unit components as columns, their eigenvalues, shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    steps: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as rows."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    return values.reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("x")) if batch.num_rows else np.empty((0, 0))
        parts = [x[i : i + BLOCK] for i in range(0, len(x), BLOCK)]
        yield pa.RecordBatch.from_pydict({"n": [len(p) for p in parts], "x": [p.astype("<i4").tobytes() for p in parts]}, pa.schema([("n", pa.int64()), ("x", pa.binary())]))


def _sums(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum of `of`(block of rows) over the fit list, a vector; summed in tasks, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, x in zip(batch.column("n").to_pylist(), batch.column("x").to_pylist(), strict=True):
                part = of(np.frombuffer(x, "<i4").reshape(n, -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "value"])

    by_place = fit.mapInArrow(run, f"i long, value {kind}").groupBy("i")
    total = by_place.agg(F.sum("value" if kind == "double" else F.col("value").cast("decimal(38,0)")).alias("value"))
    return np.array([r.value for r in sorted(total.collect(), key=lambda r: r.i)], object if kind == "long" else float)


@dataclass
class Run:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    steps: int
    ended: bool  # the space is exhausted


def bidiagonalise(product: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, apart: np.ndarray, done: Callable[[Run], bool]) -> Run:
    """Right singular triplets of X across the orthonormal columns of `apart`.

    `product`(r) gives |Xr|² and XᵀXr in one pass. `done` looks at what each step has found.
    """
    dims = len(start)

    def across(w: np.ndarray) -> np.ndarray:
        basis = np.column_stack([apart, *vs]) if vs else apart
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        return w

    vs: list[np.ndarray] = []
    v = across(start)
    vs = [v / np.linalg.norm(v)]
    zs: list[np.ndarray] = []  # u = Xz
    gs: list[np.ndarray] = []  # Xᵀu
    alphas: list[float] = []
    betas: list[float] = []
    run, largest = Run(np.empty(0), np.empty((dims, 0)), np.empty(0), 0, True), 0.0
    while True:
        r = vs[-1] - betas[-1] * zs[-1] if zs else vs[-1]
        square, g = product(r)
        if zs:
            c = np.array([z @ g for z in zs])  # uᵀXr
            r, g, square = r - np.column_stack(zs) @ c, g - np.column_stack(gs) @ c, square - c @ c
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha)
        if alpha <= dims * np.finfo(float).eps * largest or largest == 0:
            run.ended = True
            return run
        alphas.append(alpha)
        zs.append(r / alpha)
        gs.append(g / alpha)
        w = across(gs[-1] - alpha * vs[-1])
        beta = float(np.linalg.norm(w))
        p, s, qt = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        full = len(vs) + apart.shape[1] >= dims or beta <= dims * np.finfo(float).eps * largest
        run = Run(s, np.column_stack(vs) @ qt.T, (0.0 if full else beta) * np.abs(p[-1]), len(alphas), full)
        if full or done(run):
            return run
        betas.append(beta)
        vs.append(w / beta)


def fit_whitening(rows: DataFrame, most: int = 4, seed: int = 13) -> Whitening | None:
    """The whitening of `rows` (x, integers of one length), each distinct one once; None where nothing varies."""
    fit = stage(rows.select("x").distinct().mapInArrow(_packed, "n long, x binary"), "fit")
    try:
        exact = _sums(fit, lambda x: np.append(x.sum(axis=0, dtype=np.int64), len(x)), "long")
        if not len(exact):
            return None
        n, sums = int(exact[-1]), [int(s) for s in exact[:-1]]
        mean, dims = np.array([s / n for s in sums]), len(sums)

        def product(r: np.ndarray) -> tuple[float, np.ndarray]:
            def of(x: np.ndarray) -> np.ndarray:
                centred = x - mean
                y = centred @ r
                return np.append(centred.T @ y, y @ y)

            total = _sums(fit, of)
            return total[-1], total[:-1]

        rng, eps = np.random.default_rng(seed), np.finfo(float).eps
        want = min(most, dims)

        def settled(run: Run) -> bool:
            return run.steps >= want and bool((run.residuals[:want] <= ROUNDING * eps * run.values[0]).all())

        first = bidiagonalise(product, rng.standard_normal(dims), np.empty((dims, 0)), settled)
        values, vectors, steps = first.values[:want], first.vectors[:, :want], first.steps
        while 0 < len(values) < dims and len(values) <= want:
            last = values[-1] if len(values) == want else 0.0

            def below(run: Run, last: float = last) -> bool:
                top, residual = run.values[0], run.residuals[0]
                return residual <= ROUNDING * eps * values[0] or run.steps >= 8 and residual < (last - top) / 2

            more = bidiagonalise(product, rng.standard_normal(dims), vectors, below)
            steps += more.steps
            if not more.steps or more.values[0] <= max(last * (1 + 1e-12), dims * eps * values[0]):
                break
            order = np.argsort(-np.append(values, more.values[0]), kind="stable")[:want]
            values, vectors = np.append(values, more.values[0])[order], np.column_stack([vectors, more.vectors[:, 0]])[:, order]
        kept = values > dims * eps * (values[0] if len(values) else 0)
        values, vectors = values[kept], np.linalg.qr(vectors[:, kept])[0]
        if not len(values):
            return None
        scale = np.sqrt(n) / values

        def white(x: np.ndarray) -> np.ndarray:
            return ((x - mean) @ vectors) * scale

        first_pass = _sums(fit, lambda x: np.append(white(x).sum(axis=0), ((x - mean) ** 2).sum()))
        middle = first_pass[:-1] / n
        around = _sums(fit, lambda x: (lambda w: (w.T @ w).ravel())(white(x) - middle)).reshape(len(values), -1) / n
        error = float(np.abs(around - np.eye(len(values))).max())
        return Whitening(n, sums, vectors, values**2 / n, values**2 / first_pass[-1], error, steps)
    finally:
        unstage(fit)


def _applied(w: Whitening):
    mean, scale, k = w.mean, 1 / np.sqrt(w.eigenvalues), len(w.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x")).astype(np.int64)
            most = w.n * int(np.abs(x).max()) + max(map(abs, w.sums))
            exact = np.int64 if x.shape[1] * most**2 < 1 << 63 else object
            around = x.astype(exact) * w.n - np.array(w.sums, exact)
            deviation = [int(v) if v < 1 << 63 else None for v in (around * around).sum(axis=1)]
            white = ((x - mean) @ w.components) * scale
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, w.n)), pa.array(deviation, pa.int64()).take(at),
                pa.array(white.ravel()), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(len(x) * k, w.identity_error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, most: int = 4, scale: int = 256) -> DataFrame:
    """For each row of `embeddings` (vec_id, embedding) that takes part and each of up to `most` components, its whitened value."""
    fits = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LIMIT / scale))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("int"))
    rows = stage(embeddings.filter(F.coalesce(fits, F.lit(False)) & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), "quantised")
    out = []
    for dims in sorted(r.dims for r in rows.select(F.size("x").alias("dims")).distinct().collect()):
        same = rows.filter(F.size("x") == dims)
        fitted = fit_whitening(same, most)
        if fitted is not None:
            out.append(same.mapInArrow(_applied(fitted), OUT))
    found = rows.sparkSession.createDataFrame([], OUT)
    for part in out:
        found = found.unionByName(part)
    return found
