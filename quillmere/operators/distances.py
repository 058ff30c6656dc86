"""Exact Euclidean distances and nearest neighbours.

Neighbours are found in numpy, query batch by base block.  A matrix product gives
distances that are right to a known error; what lies within the k-th of them plus that
error is then measured exactly, its squares summed column by column from the left, so
that ties are exact and go to the lower id.  One block of base samples is broadcast, at
most ``block_cells`` values; more blocks are dealt to tasks by a shuffle, each with
a share of the queries, and neither passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import DRIVER_CELLS, matrix, measure
from .linalg import rows_of

#: Distances of one numpy pass.
PASS_CELLS = 4_000_000
#: Distances that one task works out at most, about.
TASK_PAIRS = 20_000_000_000
#: Base samples of a block from which a first bound on the k-th distance is taken.
FIRST_LOOK = 4096
#: Samples of one side of a tile of pairs; of a tile whose rows repeat within what a codec looks back on; rows of one numpy pass of it.
TILE, SIDE, STRIP = 4096, 512, 64
#: The same where samples occur few times: snappy finds the repeats of longer rows less well.
PAIR_SIDE = 128
#: Pairs that one task returns, about.
TASK_ROWS = 20_000_000


def squared(a: Column | str, b: Column | str, width: int) -> Column:
    """Squared distance of two array columns of known width, as one flat expression."""
    total = None
    for i in range(width):
        d = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
        total = d * d if total is None else total + d * d
    return total


def squared_any(a: Column | str, b: Column | str) -> Column:
    """Squared distance where the width is not known when planning (slower)."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def between(a: Column | str, b: Column | str, width: int) -> Column:
    return F.sqrt(squared(a, b, width))


def squared_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of two blocks of rows, columns summed from the left."""
    total = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        d = x[:, c][:, None] - y[:, c][None, :]
        d *= d
        total += d
    return total


def squared_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of equally many rows, in the same order of sums."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        d = x[:, c] - y[:, c]
        total += d * d
    return total


class Block:
    """Base samples, ascending by id, made ready for queries."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        with np.errstate(over="ignore", invalid="ignore"):
            self.centre = self.values.mean(axis=0)
            moved = self.values - self.centre
            size = (moved * moved).sum(axis=1)
            self.largest = float(size.max())
            # [q, 1] @ product = |b|^2 - 2 q.b, the squared distance less |q|^2
            self.product = np.vstack([-2 * moved.T, size])

    def nearest(self, ids: np.ndarray, x: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query id, base id, squared distance) of the nearest base samples with other ids, at most ``count`` for each query."""
        step = max(1, PASS_CELLS // len(self.ids))
        for at in range(0, len(x), step):
            yield self._pass(ids[at : at + step], x[at : at + step], count)

    def _pass(self, ids: np.ndarray, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            q = x - self.centre
            size = (q * q).sum(axis=1)
            near = np.column_stack([q, np.ones(len(q))]) @ self.product
            # of the product and of the two sums of squares, with room to spare
            error = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (size + self.largest)
        if not np.isfinite(error).all() or not np.isfinite(near).all():
            near, error = squared_block(x, self.values), np.zeros(len(x))
        lo, hi = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for k in range(int((hi - lo).max(initial=0))):
            own = np.flatnonzero(lo + k < hi)
            near[own, lo[own] + k] = np.inf
        first = min(near.shape[1], max(FIRST_LOOK, 64 * count))
        k = min(count, first)
        bound = np.partition(near[:, :first], k - 1, axis=1)[:, k - 1]
        found = np.flatnonzero(near <= (bound + error)[:, None])
        row, column = np.divmod(found, near.shape[1])
        value = near.ravel()[found]
        on = np.isfinite(value)
        row, column, value = row[on], column[on], value[on]
        order = np.lexsort((value, row))
        starts = np.searchsorted(row[order], np.arange(len(x) + 1))
        kth = np.full(len(x), np.inf)
        full = np.flatnonzero(np.diff(starts) >= count)
        kth[full] = value[order][starts[full] + count - 1]
        on = value <= (kth + 2 * error)[row]
        row, column = row[on], column[on]
        exact = np.concatenate([squared_rows(x[row[a : a + 100_000]], self.values[column[a : a + 100_000]]) for a in range(0, len(row), 100_000)]) if len(row) else np.zeros(0)
        order = np.lexsort((self.ids[column], exact, row))
        row, column, exact = row[order], column[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        on = (place < count) & np.isfinite(exact)
        return ids[row[on]], self.ids[column[on]], exact[on]


_FOUND = "id long, neighbour long, d2 double"


def _batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(3)], ["id", "neighbour", "d2"])


def _dealt(frame: DataFrame, rows: int, blocks: int, count: int) -> DataFrame:
    """Candidates from each block of base samples: a block and its queries meet in a task, sorted block first."""
    context = frame.sparkSession.sparkContext
    shares = max(1, -(-2 * context.defaultParallelism // blocks), math.ceil(rows * (rows / blocks) / TASK_PAIRS))
    own = frame.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shares)).cast("int").alias("share"))
    base = own.withColumn("any", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select("id", "x", F.lit(0).alias("role"), (F.col("block") * shares + F.col("any")).alias("tile"))
    asked = own.withColumn("any", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "x", F.lit(1).alias("role"), (F.col("any") * shares + F.col("share")).alias("tile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, block = -1, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("tile").to_numpy().astype(np.int64) * 2 + batch.column("role").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part, now = batch.slice(a, b - a), int(key[a]) // 2
                if now != tile:
                    tile, held, block = now, [], None
                ids, x = part.column("id").to_numpy(), rows_of(part)
                if key[a] % 2 == 0:
                    held.append((ids, x))
                    continue
                if block is None and held:
                    block, held = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), []
                if block is not None and (found := list(block.nearest(ids, x, count))):
                    yield _batch(found)

    tiles = blocks * shares
    return base.unionByName(asked).repartitionById(tiles, "tile").sortWithinPartitions("tile", "role").mapInArrow(run, _FOUND)


def _best(rows: DataFrame, count: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("d2", "neighbour")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count).select("id", "rank", "neighbour", F.sqrt("d2").alias("distance"))


def nearest(frame: DataFrame, count: int, block_cells: int = DRIVER_CELLS // 4) -> DataFrame:
    """(id, rank from 1, neighbour, distance): the nearest other samples, nearest first, ties to the lower id."""
    extent = measure(frame)
    if not 1 <= count <= extent.rows - 1:
        raise ValueError(f"count must lie between 1 and {extent.rows - 1}")
    blocks = max(1, -(-extent.rows * extent.width // block_cells))
    if blocks > 1:
        return _best(_dealt(frame, extent.rows, blocks, count), count)
    context = frame.sparkSession.sparkContext
    shared = context.broadcast(matrix(frame, block_cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            if batch.num_rows:
                block = block or Block(*shared.value)
                yield _batch(list(block.nearest(batch.column("id").to_numpy(), rows_of(batch), count)))

    # queries are spread over the cluster: the work is per query and base sample, not per byte read
    return _best(frame.select("id", "x").repartition(context.defaultParallelism * 2, "id").mapInArrow(run, _FOUND), count)


def nearest_sql(frame: DataFrame, count: int, broadcast_cells: int = DRIVER_CELLS // 4) -> DataFrame:
    """The same rows by theta joins and ranked windows, without Python.

    The k-th distance to about sqrt(k n) of the samples bounds the k-th distance to all of
    them; the join over all pairs keeps pairs within it, so few reach the second window.
    A side is broadcast while it has at most ``broadcast_cells`` values.
    """
    extent = measure(frame)
    if not 1 <= count <= extent.rows - 1:
        raise ValueError(f"count must lie between 1 and {extent.rows - 1}")
    near = (lambda df: F.broadcast(df)) if extent.rows * extent.width <= broadcast_cells else (lambda df: df)
    # plain columns without nulls: sums over array elements make methods too long for the JVM to compile
    flat = lambda p: [F.coalesce(F.get("x", F.lit(i)), F.lit(0.0)).alias(f"{p}{i}") for i in range(extent.width)]
    spread = frame.select("id", *flat("u")).repartition(frame.sparkSession.sparkContext.defaultParallelism * 2, "id")
    other = frame.select(F.col("id").alias("neighbour"), *flat("v"))
    parts = max(1, int(extent.rows / math.sqrt(count * extent.rows)))
    some = other.where(F.pmod(F.xxhash64("neighbour"), F.lit(parts)) == 0)
    d2 = reduce(add, ((F.col(f"u{i}") - F.col(f"v{i}")) * (F.col(f"u{i}") - F.col(f"v{i}")) for i in range(extent.width)))
    w = Window.partitionBy("id").orderBy("d2")
    looked = spread.join(near(some), F.col("id") != F.col("neighbour")).select("id", d2.alias("d2"))
    bound = looked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == count).select("id", F.col("d2").alias("bound"))
    bounded = spread.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
    pairs = bounded.join(near(other), (F.col("id") != F.col("neighbour")) & (d2 <= F.col("bound"))).select("id", "neighbour", d2.alias("d2"))
    return _best(pairs, count)


def alike(values: np.ndarray) -> np.ndarray:
    """Of each row the first row that equals it."""
    rows = np.ascontiguousarray(values + 0.0)
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    _, first, which = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first[which.ravel()]


def triangle(spark: SparkSession, side: int, parts: int) -> DataFrame:
    """(id): numbers of the tiles a <= b of ``side`` blocks, column by column; no task sees more than its share."""
    tiles = side * (side + 1) // 2
    return spark.range(0, tiles, 1, max(1, min(tiles, parts)))


def corner(tile: int) -> tuple[int, int]:
    """(a, b) of a tile of ``triangle``."""
    b = (math.isqrt(8 * tile + 1) - 1) // 2
    return tile - b * (b + 1) // 2, b


class _Samples:
    """Samples with equal ones side by side, each class of equal ones kept once."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        first = alike(values)
        order = np.argsort(first, kind="stable")
        kept, which = np.unique(first[order], return_inverse=True)
        self.ids, self.which, self.distinct = ids[order], which.ravel(), values[kept]
        self.repeats = len(np.unique(ids)) < len(ids)

    def tile(self, a: slice, b: slice) -> Iterator[pa.RecordBatch]:
        """Pairs of two blocks, of a block with itself once.  The second block runs by id, so ids come in runs."""
        by_id = np.argsort(self.ids[b], kind="stable")
        v, right = self.ids[b][by_id], self.which[b][by_id]
        few, back = np.unique(right, return_inverse=True)
        for s in range(a.start, a.stop, STRIP):
            u, left = self.ids[s : min(s + STRIP, a.stop)], self.which[s : min(s + STRIP, a.stop)]
            own, ahead = np.unique(left, return_inverse=True)
            if len(own) * len(few) < len(u) * len(v):
                d2 = squared_block(self.distinct[own], self.distinct[few]).take(ahead.ravel(), axis=0).take(back.ravel(), axis=1)
            else:
                d2 = squared_block(self.distinct[left], self.distinct[right])
            i, j, d2 = np.minimum.outer(u, v).ravel(), np.maximum.outer(u, v).ravel(), d2.ravel()
            if a == b:
                on = np.less.outer(u, v).ravel()
            elif self.repeats:
                on = i != j
            else:
                on = None
            if on is not None:
                i, j, d2 = i[on], j[on], d2[on]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d2), pa.array(np.sqrt(d2))], ["i", "j", "d2", "d"])


_PAIRS = "i long, j long, d2 double, d double"


def pairs(frame: DataFrame, tile: int = TILE, block_cells: int = DRIVER_CELLS // 4, side: int = PAIR_SIDE) -> DataFrame:
    """(i, j, d2, d) of all pairs i < j: as many rows as there are pairs.

    Up to ``block_cells`` values the samples are broadcast and nothing is shuffled.  Equal samples
    stand side by side, so that what they repeat lies close together in the rows, and distances
    between classes of equal samples are worked out once a strip.  Beyond, samples fall into groups
    by id; two groups meet in a task for each pair of groups.
    """
    extent = measure(frame, 0)
    if not 0 < extent.rows * extent.width <= block_cells:
        return _met(frame, extent.rows, tile)
    spark, n, size = frame.sparkSession, extent.rows, min(tile, side)
    shared = spark.sparkContext.broadcast(_Samples(*matrix(frame, block_cells)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                yield from shared.value.tile(*(slice(k * size, min((k + 1) * size, n)) for k in corner(number)))

    parts = max(2 * spark.sparkContext.defaultParallelism, n * n // 2 // TASK_ROWS)
    return triangle(spark, -(-n // size), parts).mapInArrow(run, _PAIRS)


def _met(frame: DataFrame, n: int, tile: int) -> DataFrame:
    """All pairs by a shuffle of the samples."""
    parallelism = frame.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-n // tile), min(math.ceil(math.sqrt(8 * parallelism)), -(-n // 256)), 1)
    own = frame.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("own"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    rows = met.select("id", "x", "own", (F.least("own", "other") * groups + F.greatest("own", "other")).alias("tile"))

    def made(tile: int, ids: np.ndarray, x: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        a = np.flatnonzero(group == group.min())
        b = np.flatnonzero(group != group.min())
        if not len(b) and tile // groups != tile % groups:  # one of the two groups is empty
            return
        step = max(1, 500_000 // max(1, len(b) or len(a)))
        for s in range(0, len(a), step):
            left = a[s : s + step]
            right = b if len(b) else a
            d2 = squared_block(x[left], x[right])
            u, v = np.broadcast_to(ids[left][:, None], d2.shape).ravel(), np.broadcast_to(ids[right][None, :], d2.shape).ravel()
            d2 = d2.ravel()
            if not len(b):
                on = u < v
                u, v, d2 = u[on], v[on], d2[on]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d2), pa.array(np.sqrt(d2))], ["i", "j", "d2", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from made(now, *(np.concatenate([h[k] for h in held]) for k in range(3)))

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("tile").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if key[a] != now:
                    yield from flush()
                    now, held = int(key[a]), []
                part = batch.slice(a, b - a)
                held.append((part.column("id").to_numpy(), rows_of(part), part.column("own").to_numpy()))
        yield from flush()

    # tiles above the diagonal are dealt in turn, so that tasks get equal numbers of them
    turn = (F.col("tile") / groups).cast("int") + (F.col("tile") % groups) * (F.col("tile") % groups + 1) / 2
    return rows.repartitionById(min(groups * (groups + 1) // 2, 4096), turn.cast("int")).sortWithinPartitions("tile").mapInArrow(run, _PAIRS)
