"""Spectral embedding of a weighted graph: eigenvectors of the random-walk Laplacian."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import DRIVER_CELLS, dense_ids, frame_of
from .graphs import connected_components, degrees, distributed_product, from_edges, local_components, local_product
from .linalg import leading_eigen

#: Edges up to which the operator is collected and iterated on the driver.
LOCAL_EDGES = 4_000_000


@dataclass(frozen=True)
class SpectralResult:
    ids: np.ndarray
    coordinates: np.ndarray
    placed: np.ndarray
    eigenvalues: np.ndarray
    eigen_gap: float
    graph_components: int
    iterations: int
    converged: bool

    @property
    def node_count(self) -> int:
        return len(self.ids)

    @property
    def dimensions(self) -> int:
        return self.coordinates.shape[1]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """(id, x, placed)."""
        own = spark.createDataFrame(pa.table({"id": pa.array(self.ids), "placed": pa.array(self.placed)}))
        return frame_of(spark, self.ids, self.coordinates).join(own, "id")


def laplacian_eigenvalues(values: np.ndarray) -> np.ndarray:
    """Laplacian eigenvalues of those of the halved and shifted operator."""
    return np.clip(2 - 2 * values, 0, 2)


def spectral_embedding(nodes: DataFrame, edges: DataFrame, dimensions: int, seed: int = 1, tolerance: float = 1e-8, local: bool | None = None) -> SpectralResult:
    """Coordinates of every node; isolated ones stay at the origin and are not placed.

    No axis is left out: for a connected graph the first one is constant.
    """
    if dimensions < 1:
        raise ValueError("at least one dimension is needed")
    edges = from_edges(edges).cache()
    if (many := nodes.count()) * dimensions > DRIVER_CELLS:
        raise ValueError(f"{many} nodes in {dimensions} dimensions are too many for the driver (limit {DRIVER_CELLS} values)")
    ids = np.sort(nodes.select("id").toArrow().column("id").to_numpy())
    table = edges.limit(LOCAL_EDGES + 1).toArrow() if local is not False else None
    if table is not None and (local or table.num_rows <= LOCAL_EDGES):
        a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "weight"))
        order = np.lexsort((b, a))
        placed_ids, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
        i, j = ends[: len(a)], ends[len(a) :]
        multiply, own = local_product(i, j, w[order], len(placed_ids), 0.0, (0.5, 0.5))
        pieces = len(np.unique(local_components(i, j, len(placed_ids))))
    else:
        index = dense_ids(degrees(nodes, edges).where("degree > 0").select("id")).cache()
        numbered = index.toArrow()
        placed_ids = np.empty(numbered.num_rows, np.int64)
        placed_ids[numbered.column("index").to_numpy()] = numbered.column("id").to_numpy()
        multiply, own = distributed_product(index, edges, len(placed_ids), 0.0, (0.5, 0.5))
        pieces = connected_components(index.select("id"), edges, local=False).select("component").distinct().count()
    size = len(placed_ids)
    if dimensions > size:
        raise ValueError(f"{size} connected node(s) cannot carry {dimensions} dimensions")
    if not np.isin(placed_ids, ids).all():
        raise ValueError("an edge names a node that does not exist")
    ask = min(size, dimensions + 1)
    values, vectors, iterations, converged = leading_eigen(size, multiply, ask, seed, tolerance)
    laplacian = laplacian_eigenvalues(values)
    at = np.searchsorted(ids, placed_ids)
    coordinates = np.zeros((len(ids), dimensions))
    coordinates[at] = vectors[:, :dimensions] / np.sqrt(own)[:, None]
    placed = np.zeros(len(ids), bool)
    placed[at] = True
    gap = float(laplacian[dimensions] - laplacian[dimensions - 1]) if ask > dimensions else math.nan
    edges.unpersist()
    return SpectralResult(ids, coordinates, placed, laplacian[:dimensions], gap, pieces, iterations, converged)


def constant_axis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, x): the first axis of a connected graph, in closed form: one over the root of the total degree."""
    degree = degrees(nodes, edges)
    total = degree.agg(F.sum("degree").alias("t"))
    return degree.join(F.broadcast(total)).select("id", F.when(F.col("degree") > 0, 1 / F.sqrt("t")).otherwise(0.0).alias("x"))
