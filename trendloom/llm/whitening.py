"""Whitening of embeddings by exact covariances: products of integer limbs in float64 BLAS.

Each entry becomes the integer floor(scale * c) + shift. A batch is centred at its own integer means, the centred values
are split into signed limbs of LIMB bits, and the limbs' products run as float64 matrix products over so few rows
that every sum stays below 2**53, so that each is exact. The products are recombined as big integers, moved from the
batch's means back to the origin (exactly, too), and each task sends its sums once, cut into digits of DIGIT bits that Spark
adds as longs, pre-aggregated, for each pair of dimensions. From them the covariance of all rows is one fraction for each
pair, rounded once; its eigenvectors are the components. What meets in the driver is a matrix of dimensions
(``MOST_DIMS`` at most), never rows.

Defined results: rows whose vector is null or has null or non-finite entries take no part; null or repeated ids are rows
like others; a shorter vector counts as ending in zeros; equal rows count each. A component without variance (all
rows alike, or fewer independent dimensions than components) has a null ``whitened`` and is left out of ``identity_error``. Other columns
are ignored; an empty table gives no rows. ``deviation`` is null where it exceeds 64 bits;
``deviation_exact`` has its decimal digits always.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.vectors import complete, dense, scaled, widest

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of one exact product, bits of a limb: 2**12 rows of products of 2**40 stay within 2**53.
ROWS, LIMB = 4096, 20
#: Bits of a digit of the sums, digits: numbers below 2**(DIGIT * DIGITS - 1) in sum over up to 2**33 tasks.
DIGIT, DIGITS = 30, 7
MOST_DIMS = 2048


class Model(NamedTuple):
    """Of the fit list: rows n, exact sums, components as columns, their eigenvalues, the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Float64 arrays with values = sum of limb k * 2**(LIMB * k), each below 2**LIMB in magnitude."""
    out, rest = [], values
    while True:
        if not rest.size or np.abs(rest).max() < 1 << LIMB:
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB


def exact_gram(values: np.ndarray) -> np.ndarray:
    """values.T @ values as an array of Python integers, for at most ROWS rows."""
    parts = limbs(values)
    total = np.zeros((values.shape[1],) * 2, dtype=object)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            product = (a.T @ parts[j]).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
            total = total + product + (product.T if i != j else 0)
    return total


def batch_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and exact sums of products of the rows of x, by products of values centred at the batch's means."""
    n = len(x)
    sums = np.array([int(v) for v in (x >> 31).sum(axis=0)], dtype=object) * 2**31 + np.array([int(v) for v in (x & (2**31 - 1)).sum(axis=0)], dtype=object)
    means = sums // n
    y = x - means.astype(np.int64)
    left = sums - n * means
    return sums, exact_gram(y) + np.outer(means, left) + np.outer(left, means) + n * np.outer(means, means)


def digits(value: int) -> list[int]:
    """Digits of DIGIT bits, the last one signed."""
    out = []
    for _ in range(DIGITS - 1):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


DIGIT_COLUMNS = [f"d{k}" for k in range(DIGITS)]


def fit(vectors: DataFrame, dims: int, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> Model | None:
    """The model of all rows of ``_v``; None without rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, grams = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = scaled(dense(batch.slice(at, ROWS).column(0), dims), scale) + shift
                s, q = batch_sums(x)
                n, sums, grams = n + len(x), sums + s, grams + q
        if n:
            cells = [(-1, -1, n), *((i, -1, int(s)) for i, s in enumerate(sums)), *((i, j, int(grams[i, j])) for i in range(dims) for j in range(i, dims))]
            rows = [(i, j, *digits(v)) for i, j, v in cells]
            yield pa.RecordBatch.from_pydict(dict(zip(["i", "j", *DIGIT_COLUMNS], map(list, zip(*rows, strict=True)), strict=True)))

    schema = "i long, j long, " + ", ".join(f"{c} long" for c in DIGIT_COLUMNS)
    merged = vectors.select("_v").mapInArrow(partial, schema).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in DIGIT_COLUMNS)).collect()  # dims * dims / 2 rows
    if not merged:
        return None
    value = {(r["i"], r["j"]): sum(r[c] << DIGIT * k for k, c in enumerate(DIGIT_COLUMNS)) for r in merged}
    n, sums = value[-1, -1], [value[i, -1] for i in range(dims)]
    covariance = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            covariance[i, j] = covariance[j, i] = (n * value[i, j] - sums[i] * sums[j]) / (n * n)  # integers: rounded once
    eigenvalues, eigenvectors = np.linalg.eigh(covariance)
    top = slice(None, -components - 1, -1)
    chosen = eigenvectors[:, top]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return Model(n, sums, chosen * signs, eigenvalues[top], float(np.trace(covariance)))


def centred(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """x minus the integer means, and what is left of the means (sums modulo n)."""
    means = np.array([s // model.n for s in model.sums], dtype=np.int64)
    return x - means, np.array([s % model.n for s in model.sums], dtype=object)


def deviations(y: np.ndarray, left: np.ndarray, n: int) -> list[int]:
    """Exact sums over dimensions of (n * y - left) squared."""
    top = max(int(np.abs(y).max()) if y.size else 0, 1)
    if y.shape[1] * (n * (top + 1)) ** 2 < 2**63:
        return ((n * y - left.astype(np.int64)) ** 2).sum(axis=1).tolist()
    z = n * y.astype(object) - left
    return (z * z).sum(axis=1).tolist()


def projected(y: np.ndarray, left: np.ndarray, model: Model) -> np.ndarray:
    """Whitened values; nan for components without variance."""
    e = model.eigenvalues
    real = e > 1e-12 * max(model.trace, 0.0)
    fraction = (left / model.n).astype(np.float64)
    return (y - fraction) @ model.components / np.sqrt(np.where(real, e, np.nan))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """Per row and component: id, component, n, deviation, deviation_exact, whitened, explained, identity_error."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, deviation_exact string, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).filter(complete(F.col("_v")))
    dims = widest(rows, "_v")
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} entries")
    model = fit(rows, dims, scale, shift, components) if dims else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = model.components.shape[1]

    def whitened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, left = centred(scaled(dense(batch.column("_v"), dims), scale) + shift, model)
        return y, left, projected(y, left, model)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = whitened(batch)[2]
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(k), k), "j": np.tile(np.arange(k), k), "a": second.ravel(), "b": np.repeat(first, k)})

    measured = rows.mapInArrow(products, "i long, j long, a double, b double").groupBy("i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()  # components squared
    means = {r["i"]: r["b"] / model.n for r in measured}
    errors = [abs(r["a"] / model.n - means[r["i"]] * means[r["j"]] - (r["i"] == r["j"])) for r in measured]
    error = float(np.nanmax(errors)) if not np.isnan(errors).all() else None
    explained = model.eigenvalues / model.trace if model.trace > 0 else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, left, w = whitened(batch)
            m = len(y)
            exact = deviations(y, left, model.n)
            short = [d if d < 2**63 else None for d in exact]
            yield pa.RecordBatch.from_pydict(
                {
                    id_col: batch.column("_id").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, model.n)),
                    "deviation": pa.array(short, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    "deviation_exact": pa.array(list(map(str, exact)), pa.string()).take(pa.array(np.repeat(np.arange(m), k))),
                    "whitened": pa.array(w.ravel(), from_pandas=True),
                    "explained": pa.array(np.tile(explained, m)),
                    "identity_error": pa.array(np.full(m * k, np.nan if error is None else error), from_pandas=True),
                }
            )

    return rows.mapInArrow(project, schema)
