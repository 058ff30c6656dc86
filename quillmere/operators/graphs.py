"""Weighted undirected graphs as edge tables (a, b, weight) with a < b, and a table of nodes (id)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import shared_folder
from .distances import nearest

#: Edges up to which a graph is worked on in memory.
LOCAL_EDGES = 1_000_000


def from_edges(edges: DataFrame) -> DataFrame:
    """Edges in order (a < b); repeated ones keep the larger weight; loops and zero weights go.  Without a weight: 1."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    rows = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), weight.alias("weight")).where("a <> b")
    return rows.groupBy("a", "b").agg(F.max("weight").alias("weight")).where("weight <> 0")


def neighbour_graph(frame: DataFrame, neighbours: int) -> DataFrame:
    """Edges between nearest neighbours: weight 1 where both chose each other, else one half."""
    near = nearest(frame, neighbours)
    return near.groupBy(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).agg((F.count("*") * 0.5).alias("weight"))


def neighbour_graph_by_distance(frame: DataFrame, neighbours: int, maximum_distance: float = math.inf, blocked: Column | DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges between nearest neighbours that either end chose, weighted by distance.

    Longer edges than the maximum go (equal ones stay), then blocked ones, then those of
    length zero.  ``blocked``: a condition on the columns a and b, asked once for each
    pair; a function from edges to those that stay, which may join what it needs to
    them; or a table (a, b) of blocked pairs in either order.
    """
    if math.isnan(maximum_distance) or maximum_distance < 0:
        raise ValueError("the maximum distance must not be negative")
    near = nearest(frame, neighbours).where(F.col("distance") <= maximum_distance)
    edges = near.groupBy(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).agg(F.min("distance").alias("weight"))
    if isinstance(blocked, DataFrame):
        edges = edges.join(blocked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    elif callable(blocked) and not isinstance(blocked, Column):
        edges = blocked(edges).select("a", "b", "weight")
    elif blocked is not None:
        edges = edges.where(~blocked)
    return edges.where("weight > 0")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node: the sum of its weights, 0 for isolated ones."""
    own = both_ways(edges).groupBy("a").agg(F.sum("weight").alias("degree"))
    return nodes.select("id").join(own, F.col("id") == F.col("a"), "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def adjacent(edges: DataFrame) -> DataFrame:
    """(id, neighbours): sorted ids of adjacent nodes."""
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def reweight(edges: DataFrame, weight: Column) -> DataFrame:
    """The same edges with another weight, an expression of a, b and weight."""
    return edges.withColumn("weight", weight.cast("double"))


def propagate(nodes: DataFrame, edges: DataFrame, values: DataFrame, width: int, self_weight: float = 0.0) -> DataFrame:
    """(id, x): D^-1/2 (A + s I) D^-1/2 applied to values (id, x); D holds s as well, rows of degree 0 give 0.

    A join of edges, degrees and values, then sums by node that are combined before the shuffle.
    """
    degree = degrees(nodes, edges).withColumn("root", F.when(F.col("degree") + self_weight > 0, 1 / F.sqrt(F.col("degree") + self_weight)).otherwise(0.0)).select("id", "root")
    scaled = values.join(degree, "id").select("id", "root", *((F.get("x", F.lit(i)) * F.col("root")).alias(f"v{i}") for i in range(width)))
    links = both_ways(edges)
    if self_weight:
        links = links.unionByName(nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(float(self_weight)).alias("weight")))
    moved = links.join(scaled.withColumnRenamed("id", "b").drop("root"), "b").groupBy("a").agg(*(F.sum(F.col("weight") * F.col(f"v{i}")).alias(f"s{i}") for i in range(width)))
    out = degree.join(moved, F.col("id") == F.col("a"), "left")
    return out.select("id", F.array(*(F.coalesce(F.col(f"s{i}") * F.col("root"), F.lit(0.0)) for i in range(width))).alias("x"))


def connected_components(nodes: DataFrame, edges: DataFrame, checkpoint: bool = True, local: bool | None = None) -> DataFrame:
    """(id, component): the smallest node of each component.

    Smallest neighbour label, then the label's label, until nothing changes: in
    memory for up to LOCAL_EDGES edges, else (or with ``local=False``) a few jobs a round.
    """
    if local is not False:
        few = edges.select("a", "b").limit(LOCAL_EDGES + 1).toArrow()
        if local or few.num_rows <= LOCAL_EDGES:
            a, b = few.column("a").to_numpy(), few.column("b").to_numpy()
            known, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = known[local_components(ends[: len(a)], ends[len(a) :], len(known))] if len(known) else known
            found = nodes.sparkSession.createDataFrame(pa.table({"node": pa.array(known, pa.int64()), "least": pa.array(label, pa.int64())}))
            return nodes.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("least", "id").alias("component"))
    links = both_ways(edges.select("a", "b", F.lit(1.0).alias("weight"))).select("a", "b").distinct()
    if checkpoint:
        shared_folder(nodes.sparkSession)
    links = links.checkpoint() if checkpoint else links
    labels = nodes.select("id", F.col("id").alias("component"))
    while True:
        near = links.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("least", "component")).alias("component"))
        step = step.checkpoint() if checkpoint else step
        jump = step.select(F.col("id").alias("via"), F.col("component").alias("far"))
        after = step.join(jump, F.col("component") == F.col("via"), "left").select("id", "old", F.least("component", F.coalesce("far", "component")).alias("component"))
        after = after.checkpoint() if checkpoint else after
        labels = after.select("id", "component")
        if after.where("component <> old").isEmpty():
            return labels


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: list[int]) -> DataFrame:
    """(id, cost, previous): cheapest cost from any source, null where there is no way; ties to the lower previous node.

    Relaxation from the frontier, one job a round, until no cost falls.
    """
    shared_folder(nodes.sparkSession)
    links = both_ways(edges).checkpoint()
    best = nodes.select("id", F.when(F.col("id").isin(sources), 0.0).alias("cost"), F.lit(None).cast("long").alias("previous"), F.col("id").isin(sources).alias("fresh"))
    while True:
        offers = links.join(best.where("fresh").select(F.col("id").alias("a"), F.col("cost").alias("paid")), "a").groupBy("b").agg(F.min(F.struct((F.col("paid") + F.col("weight")).alias("cost"), F.col("a").alias("via"))).alias("offer"))
        joined = best.join(offers, F.col("id") == F.col("b"), "left")
        better = F.col("offer").isNotNull() & (F.col("cost").isNull() | (F.col("offer.cost") < F.col("cost")))
        best = joined.select("id", F.when(better, F.col("offer.cost")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("offer.via")).otherwise(F.col("previous")).alias("previous"), F.coalesce(better, F.lit(False)).alias("fresh"))
        best = best.checkpoint()
        if best.where("fresh").isEmpty():
            return best.drop("fresh")


def route(paths: DataFrame, target: int) -> list[int]:
    """Nodes of the cheapest way to one target, from its source on; empty without a way."""
    rows = {r.id: (r.cost, r.previous) for r in paths.where("cost is not null").toLocalIterator()}
    way = []
    while target is not None and target in rows:
        way.append(target)
        target = rows[target][1]
    return way[::-1]


def inside_polygon(px: Column, py: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point lies strictly inside a polygon (even-odd rule), as one expression."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > py) != (F.lit(y2) > py)) & (px < F.lit(x2 - x1) * (py - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1))
        odd = odd != crosses
    return odd


class Obstacles:
    """Polygons in the plane that points may lie in and segments may be blocked by, as column expressions.

    What lies no deeper than the tolerance inside a polygon only touches it.
    """

    def __init__(self, polygons: list[list[tuple[float, float]]], tolerance: float = 0.0):
        if not tolerance >= 0:
            raise ValueError("the tolerance must not be negative")
        self.polygons, self.tolerance = [], tolerance
        for polygon in polygons:
            corners = [(float(x), float(y)) for x, y in polygon]
            corners = [c for c, before in zip(corners, corners[-1:] + corners[:-1]) if c != before]
            if len(corners) < 3 or not all(math.isfinite(v) for c in corners for v in c):
                raise ValueError("a polygon needs at least three finite corners")
            self.polygons.append(corners)

    def _deep(self, px: Column, py: Column, polygon: list[tuple[float, float]]) -> Column:
        """Inside, and farther than the tolerance from every edge."""
        deep = inside_polygon(px, py, polygon)
        for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
            dx, dy = x2 - x1, y2 - y1
            along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
            away = [px - (F.lit(x1) + along * dx), py - (F.lit(y1) + along * dy)]
            deep = deep & (away[0] * away[0] + away[1] * away[1] > self.tolerance**2)
        return deep

    def contains(self, px: Column, py: Column) -> Column:
        """Whether a point lies inside any polygon."""
        return reduce(or_, (self._deep(px, py, polygon) for polygon in self.polygons), F.lit(False))

    def blocks(self, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
        """Whether a segment passes through the inside of any polygon.

        The lines of a polygon's edges cut the segment into pieces that lie wholly inside or outside: their middles tell.
        """
        return reduce(or_, (self._passes(ax, ay, bx, by, polygon) for polygon in self.polygons), F.lit(False))

    def _passes(self, ax: Column, ay: Column, bx: Column, by: Column, polygon: list[tuple[float, float]]) -> Column:
        cuts = [F.lit(0.0), F.lit(1.0)]
        for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
            begin, end = ((py - y1) * (x2 - x1) - (px - x1) * (y2 - y1) for px, py in ((ax, ay), (bx, by)))
            cuts.append(F.when(begin * end < 0, begin / (begin - end)))
        at = F.array_sort(F.array_compact(F.array(*cuts)))
        middles = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: (F.get(at, k - 1) + F.get(at, k)) / 2)
        return F.exists(middles, lambda m: self._deep(ax + m * (bx - ax), ay + m * (by - ay), polygon))


def _roots(degree: np.ndarray) -> np.ndarray:
    return np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 0.0)


def local_product(i: np.ndarray, j: np.ndarray, weight: np.ndarray, size: int, self_weight: float, scale: tuple[float, float]):
    """multiply(block) = scale[0] * D^-1/2 (A + sI) D^-1/2 @ block + scale[1] * block from edge arrays, and the degrees."""
    rows, cols, vals = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([weight, weight])
    degree = np.bincount(rows, vals, size) + self_weight
    root = _roots(degree)
    order = np.lexsort((cols, rows))
    rows, cols = rows[order], cols[order]
    vals = vals[order] * root[rows] * root[cols]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    # short rows: one gather for each place in a row is cheaper than a sum over segments
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    layers = [(rows[at], cols[at], vals[at][:, None]) for k in range(int(place.max()) + 1) if len(at := np.flatnonzero(place == k))] if len(rows) and place.max() < 512 else None

    def multiply(block: np.ndarray) -> np.ndarray:
        out = (self_weight * root * root)[:, None] * block
        if layers is not None:
            for r, c, v in layers:
                out[r] += v * block[c]
        elif len(rows):
            out[rows[first]] += np.add.reduceat(vals[:, None] * block[cols], first)
        return scale[0] * out + scale[1] * block

    return multiply, degree


def local_components(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The smallest node of each node's component, from edge arrays."""
    label = np.arange(size)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def distributed_product(index: DataFrame, edges: DataFrame, size: int, self_weight: float, scale: tuple[float, float]):
    """The same multiply and degrees, where each product is a Spark job that joins edges with the block and sums by node."""
    pairs = edges.join(index.select(F.col("id").alias("a"), F.col("index").alias("i")), "a").join(index.select(F.col("id").alias("b"), F.col("index").alias("j")), "b").select("i", "j", "weight")
    spark = edges.sparkSession
    links = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")).cache()
    degree = np.full(size, float(self_weight))
    sums = links.groupBy("i").agg(F.sum("weight").alias("d")).toArrow()
    degree[sums.column("i").to_numpy()] += sums.column("d").to_numpy()
    root = _roots(degree)

    def multiply(block: np.ndarray) -> np.ndarray:
        p = block.shape[1]
        scaled = np.ascontiguousarray(block * root[:, None])
        table = pa.table({"j": pa.array(np.arange(size)), "x": pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * p, pa.int32()), pa.array(scaled.ravel()))})
        moved = links.join(spark.createDataFrame(table), "j").groupBy("i").agg(F.array(*(F.sum(F.col("weight") * F.get("x", F.lit(c))) for c in range(p))).alias("s")).toArrow()
        out = self_weight * scaled
        if moved.num_rows:
            out[moved.column("i").to_numpy()] += np.array(moved.column("s").to_pylist(), float)
        return scale[0] * out * root[:, None] + scale[1] * block

    return multiply, degree
