"""Symmetric eigenproblems and principal components.

Means and the centred Gram matrix are summed on the executors (one small array
for each partition, summed again in a second, bounded level); the d x d eigenproblem is
solved on the driver; scores are Arrow-batch matrix products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import measure

#: Fixed value: a component below this share of the total variance is degenerate.
DEGENERATE = 1e-10


def canonical_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry (the first of equals) positive."""
    if not vectors.size:
        return vectors
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def symmetric_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and eigenvectors as columns with canonical signs."""
    matrix = np.asarray(matrix, float)
    if matrix.ndim != 2 or matrix.shape[0] != matrix.shape[1]:
        raise ValueError("a square matrix is needed")
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], canonical_signs(vectors[:, order])


def rows_of(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def lists_of(values: np.ndarray) -> pa.Array:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(values, np.float64).ravel()))


def summed(frame: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, fan_in: int = 32) -> np.ndarray:
    """Sum over the frame's batches of an array of ``size`` doubles: per partition, then in ``fan_in`` groups, then here."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(rows_of(batch)).ravel()
        yield pa.RecordBatch.from_arrays([lists_of(total[None, :])], ["v"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += rows_of(batch, "v").sum(axis=0)
        yield pa.RecordBatch.from_arrays([lists_of(total[None, :])], ["v"])

    partial = frame.select("x").mapInArrow(first, "v array<double>")
    table = partial.withColumn("k", F.spark_partition_id() % fan_in).repartition(fan_in, "k").select("v").mapInArrow(second, "v array<double>").toArrow()
    return np.array(table.column("v").to_pylist(), float).reshape(-1, size).sum(axis=0)


def covariance(frame: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and the sample covariance (n - 1), in two passes."""
    extent = measure(frame, 2)
    n, d = extent.rows, extent.width
    mean = np.array(frame.agg(*(F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(d))).first(), float)

    def gram(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    return n, mean, summed(frame, gram, d * d).reshape(d, d) / (n - 1)


@dataclass(frozen=True)
class PrincipalComponents:
    """Components are rows, by falling variance."""

    mean: np.ndarray
    components: np.ndarray
    explained_variance: np.ndarray
    total_variance: float
    whiten: bool
    rows: int

    @property
    def count(self) -> int:
        return len(self.components)

    @property
    def explained_variance_ratio(self) -> float:
        return float(self.explained_variance.sum() / self.total_variance) if self.total_variance > 0 else 1.0

    @staticmethod
    def fit(frame: DataFrame, variance_threshold: float = 0.99, whiten: bool = True) -> PrincipalComponents:
        """The fewest leading components that explain the threshold; degenerate ones are left out."""
        if not 0 < variance_threshold <= 1:
            raise ValueError("the variance threshold must lie above 0 and not above 1")
        return _principal(frame, lambda values: _enough(values, variance_threshold), whiten)

    @staticmethod
    def fit_count(frame: DataFrame, component_count: int, whiten: bool = True) -> PrincipalComponents:
        """Exactly so many components, at most one for each column."""
        if component_count < 1:
            raise ValueError("at least one component is needed")
        return _principal(frame, lambda values: min(component_count, len(values)), whiten)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.components.T
        if self.whiten:
            with np.errstate(divide="ignore", invalid="ignore"):
                z = z / np.sqrt(self.explained_variance)
        return z

    def restored(self, z: np.ndarray) -> np.ndarray:
        if self.whiten:
            z = z * np.sqrt(self.explained_variance)
        return z @ self.components + self.mean

    def transform(self, frame: DataFrame) -> DataFrame:
        """(id, x) with the scores."""
        return mapped(frame, self.scores, len(self.mean))

    def inverse_transform(self, frame: DataFrame) -> DataFrame:
        """(id, x) with the values that scores stand for."""
        return mapped(frame, self.restored, self.count)

    def loadings(self, spark) -> DataFrame:
        """(component, column, loading)."""
        rows = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(self.components)]
        return spark.createDataFrame(rows, "component int, column int, loading double")


def mapped(frame: DataFrame, function: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """(id, function(x)) batch by batch; rows of another width are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
                if (sizes != width).any():
                    raise ValueError(f"samples must have {width} values")
                yield pa.RecordBatch.from_arrays([batch.column("id"), lists_of(function(rows_of(batch)))], ["id", "x"])

    return frame.select("id", "x").mapInArrow(run, "id long, x array<double>")


def _enough(values: np.ndarray, threshold: float) -> int:
    total = values.sum()
    usable = int((values > DEGENERATE * total).sum()) if total > 0 else 0
    if usable == 0:
        return 1
    if threshold >= 1:
        return usable
    share = np.cumsum(values[:usable]) / total
    return min(int(np.searchsorted(share, threshold)) + 1, usable)


def _principal(frame: DataFrame, choose: Callable[[np.ndarray], int], whiten: bool) -> PrincipalComponents:
    n, mean, cov = covariance(frame)
    values, vectors = symmetric_eigen(cov)
    values = np.maximum(values, 0)
    k = choose(values)
    return PrincipalComponents(mean, vectors[:, :k].T.copy(), values[:k], float(values.sum()), whiten, n)


#: Degree of the Chebyshev filter; collapse limit of a column.
FILTER_DEGREE, COLLAPSED = 10, 1e-10


def orthonormal(block: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal basis of the columns; columns that collapse are replaced at random."""
    for _ in range(4):
        norms = np.linalg.norm(block, axis=0)
        block = block / np.where(norms > 0, norms, 1.0)
        q, r = np.linalg.qr(block)
        weak = np.abs(np.diag(r)) <= COLLAPSED
        if not weak.any():
            return np.linalg.qr(q)[0]
        block = np.where(weak[None, :], rng.uniform(-0.5, 0.5, block.shape), q)
    return q


def chebyshev(multiply: Callable[[np.ndarray], np.ndarray], vectors: np.ndarray, image: np.ndarray, ceiling: float) -> np.ndarray:
    """The filter polynomial on [0, ceiling] applied to a block whose image is known."""
    half = ceiling / 2
    before, now = vectors, (image - half * vectors) / half
    for _ in range(2, FILTER_DEGREE + 1):
        before, now = now, 2 * (multiply(now) - half * now) / half - before
    return now


def leading_eigen(size: int, multiply: Callable[[np.ndarray], np.ndarray], count: int, seed: int = 1, tolerance: float = 1e-8, max_iterations: int = 3000) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Largest eigenpairs of a positive semidefinite operator: (values, vectors, iterations, converged).

    Subspace iteration with a Chebyshev filter and Rayleigh-Ritz steps.  ``multiply``
    maps an n x p block to an n x p block; it may run a Spark job.
    """
    if size < 1 or not 1 <= count <= size:
        raise ValueError("count must lie between 1 and the size")
    if tolerance <= 0 or max_iterations < 1:
        raise ValueError("tolerance and iterations must be positive")

    def product(block: np.ndarray) -> np.ndarray:
        out = np.asarray(multiply(block), float)
        if out.shape != block.shape:
            raise ValueError("the operator returned a block of another shape")
        return out

    width = min(size, max(2 * count, count + 16))
    rng = np.random.default_rng(seed)
    basis = orthonormal(rng.uniform(-0.5, 0.5, (size, width)), rng)
    for step in range(1, max_iterations + 1):
        image = product(basis)
        values, rotation = symmetric_eigen(basis.T @ image)
        vectors, image = basis @ rotation, image @ rotation
        worst = np.linalg.norm(image[:, :count] - vectors[:, :count] * values[:count], axis=0).max()
        done = bool(worst <= tolerance * max(abs(values[0]), np.finfo(float).eps))
        if done or step == max_iterations:
            lead = vectors[:, :count]
            return values[:count], canonical_signs(lead / np.linalg.norm(lead, axis=0)), step, done
        ceiling = values[-1]
        block = chebyshev(product, vectors, image, ceiling) if ceiling > 1e-12 * max(abs(values[0]), np.finfo(float).eps) else image
        basis = orthonormal(block, rng)
    raise AssertionError
