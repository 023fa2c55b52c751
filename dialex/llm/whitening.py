"""Whitening of embeddings: a randomised range finder with oversampling and power passes over all centred rows, then
Rayleigh-Ritz.

Vectors become whole numbers, and each distinct one counts once in the fit. A pass multiplies the covariance V by a few
columns without ever forming it for the driver: each task adds up B'(BQ) over its centred rows B, and Spark sums the
tasks' cells. What reaches the driver is d by l numbers, d the dimension. After each pass the Ritz vectors' residuals are
measured; once they are small the components are done. Where they don't get small (flat spectra), the basis is expanded to
the full dimension, whose Ritz vectors are the eigenvectors themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialex.llm.common import bound_arrow, materialise, table

#: Whole numbers are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components, columns beside them, passes over the rows before the basis is expanded, and the residual, as a part of the
#: largest eigenvalue, at which a component is done. A pass of the full basis takes BLOCK columns at a time.
COMPONENTS, OVERSAMPLE, PASSES, TOLERANCE, BLOCK = 16, 10, 4, 1e-13, 512
#: An eigenvalue under this part of the largest is no direction of the data, and is not whitened.
RANK = 1e-12
#: Rows of a batch that are turned into doubles at a time, and bytes of the fit list in a task of a pass.
ROWS, TASK_BYTES = 2048, 64 << 20


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: np.ndarray  # whole numbers, a dimension each
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float
    identity_error: float
    passes: int
    expanded: bool

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(len(column), -1)


def _cells(values: np.ndarray) -> pa.RecordBatch:
    flat = values.ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size), pa.int64()), pa.array(flat)], names=["cell", "value"])


def _sum_cells(rows: DataFrame, work: Callable, kind: str, size: int) -> np.ndarray:
    """The tasks' cells summed by Spark, as one array of `size` numbers; its size follows the dimension, not the rows."""
    bound_arrow(rows.sparkSession)
    summed = rows.mapInArrow(work, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    cells = summed.toArrow()
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return out


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums by dimension, and its rows as the last cell."""
    total: np.ndarray | None = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            sums = np.append(x.sum(0), len(x))
            total = sums if total is None else total + sums
    if total is not None:
        yield _cells(total)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, with the difference taken in whole numbers so that nothing cancels."""
    return (x * n - sums) / n


def _centred_blocks(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, len(sums)), np.int64)
        for at in range(0, len(x), ROWS):
            yield _centred(x[at : at + ROWS], n, sums)


def _product(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's part of n V Q, and of n trace(V) as the last cell."""
    total, trace, seen = np.zeros(basis.shape), 0.0, False
    for b in _centred_blocks(batches, n, sums):
        total += b.T @ (b @ basis)
        trace += float((b * b).sum())
        seen = True
    if seen:
        yield _cells(np.append(total.ravel(), trace))


def _square(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, project: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's part of n times the covariance of the whitened rows, which are centred by what they are made of."""
    total, seen = np.zeros((project.shape[1],) * 2), False
    for b in _centred_blocks(batches, n, sums):
        w = b @ project
        total += w.T @ w
        seen = True
    if seen:
        yield _cells(total)


def _apply(rows: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q and trace(V), by one pass over all rows."""
    cells = _sum_cells(rows, partial(_product, n=n, sums=sums, basis=basis), "double", basis.size + 1) / n
    return cells[:-1].reshape(basis.shape), float(cells[-1])


def _apply_full(rows: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, float]:
    d = len(sums)
    parts = [_apply(rows, n, sums, np.eye(d)[:, a : a + BLOCK]) for a in range(0, d, BLOCK)]
    return np.concatenate([p for p, _ in parts], axis=1), parts[0][1]


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (falling), vectors and residuals of V within the span of an orthonormal basis, from V's image of it."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def fit(vectors: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 17) -> Whitening | None:
    """The whitening of the distinct rows of `vectors`, a table with one column `x` of lists of longs; None without a row.

    Lists must have one length (ValueError otherwise). Directions without variance are no components.
    """
    shape = vectors.agg(F.min(F.size("x")), F.max(F.size("x")), F.count("*")).first()
    if shape[0] is None:
        return None
    if shape[0] != shape[1]:
        raise ValueError(f"vectors have from {shape[0]} to {shape[1]} entries")
    d = shape[0]
    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, shape[2] * d * 8 // TASK_BYTES)
    rows = materialise(vectors.select("x").distinct().coalesce(tasks), "fit")  # passes are many, and a task costs something
    cells = _sum_cells(rows, _column_sums, "long", d + 1)
    sums, n = cells[:-1], int(cells[-1])
    width = min(components + oversample, d)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    done, took, expanded = False, 0, False
    while not done:
        image, trace = _apply(rows, n, sums, basis)
        took += 1
        values, found, rest = _ritz(basis, image)
        done = bool((rest[:components] <= tolerance * max(values[0], 0)).all())
        if not done and (took >= passes or width == d):
            expanded, done, took = True, True, took + 1
            image, trace = _apply_full(rows, n, sums)
            values, found, rest = _ritz(np.eye(d), image)
        elif not done:
            basis = np.linalg.qr(image)[0]
    k = int((values[:components] > RANK * max(values[0], 0)).sum())
    values, found = values[:k].copy(), found[:, :k].copy()
    project = found / np.sqrt(values)
    error = np.abs(_sum_cells(rows, partial(_square, n=n, sums=sums, project=project), "double", k * k).reshape(k, k) / n - np.eye(k)).max() if k else 0.0
    return Whitening(n, sums, values, found, trace, float(error), took + 1, expanded)


def _white(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    n, sums, k = model.n, model.sums, len(model.values)
    project = model.vectors / np.sqrt(model.values)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            off = _matrix(part.column(1)) * n - sums
            if (np.square(off.astype(np.float64)).sum(1) >= 2.0**63 * (1 - 1e-12)).any():
                raise OverflowError("a deviation doesn't fit a long")
            white, deviation, m = (off / n) @ project, np.square(off).sum(1), len(off)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k)),
                    pa.array(white.ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, **how) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Null and empty vectors and those with null or non-finite entries are dropped. Repeated vectors count once in the fit
    and have rows each, whatever their ids; so have vectors without an id. Fewer components are returned where the data
    have fewer dimensions or directions with variance: none of one distinct vector. An empty table gives an empty result.
    Vectors of different lengths, entries too large for a long, and deviations that overflow one raise an error. Other
    columns, whatever their names, aren't read.
    """
    bound_arrow(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v"))).select("vec_id", whole_numbers(F.col("v")).alias("x"))
    model = fit(rows.select("x"), components, **how)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(partial(_white, model=model), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first 16 principal components, each scaled to unit variance. What nulls, repeated rows,
    empty tables and the like give is said at `whiten`."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
