"""Multidimensional scaling of features or of a distance table, with stress majorisation.

Features: the classical map is an unwhitened principal-component map, so no n x n
matrix exists.  Stress and each majorisation step are sums over tiles of pairs, each
pair worked out once: wanted distances come from broadcast features, or from
the tiles of a distance table, stored or worked out from its samples.  Only n x k maps and sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import Note, frame_of, matrix, measure, stored
from .distances import SIDE, alike, corner, squared_block, squared_rows, triangle
from .linalg import canonical_signs, leading_eigen, lists_of, symmetric_eigen

#: Tolerance of the eigen solve, share of the first eigenvalue that is nothing, spare eigenpairs.
EIGEN_TOLERANCE, NEGLIGIBLE, HEADROOM = 1e-10, 1e-6, 4
#: Samples up to which the kernels run on the driver.
LOCAL_ROWS = 2_000
#: Samples of one side of a tile of pairs, worked out from features and stored.
TILE, STORED_TILE = 512, 1024
#: Rows of a tile that one numpy pass works on: its arrays stay in a core's cache.
STRIP = 64
#: Cells that one task works out from samples, about.
TASK_CELLS = 40_000_000
#: Samples of a distance table: their ids are kept on the driver.
MOST_SAMPLES = 4_000_000
#: Share of the largest samples' size below which a squared distance is measured exactly.
_CLOSE = 1e-5


@dataclass(frozen=True)
class ScalingOptions:
    dimensions: int = 2
    refine: bool = True
    maximum_iterations: int = 300
    tolerance: float = 1e-4
    seed: int = 1

    def validate(self, rows: int) -> None:
        if self.dimensions < 1:
            raise ValueError("at least one dimension is needed")
        if self.dimensions >= rows:
            raise ValueError(f"{rows} samples span fewer than {self.dimensions} dimensions")
        if self.maximum_iterations < 1:
            raise ValueError("at least one iteration is needed")
        if not self.tolerance > 0:
            raise ValueError("the tolerance must be positive")


@dataclass(frozen=True)
class ScalingResult:
    ids: np.ndarray
    coordinates: np.ndarray
    eigenvalues: np.ndarray
    retained: float
    most_negative_eigenvalue: float
    classical_stress: float
    stress: float
    distortion: np.ndarray
    iterations: int
    converged: bool
    notes: tuple[Note, ...] = field(default=())
    axes: np.ndarray | None = None
    centre: np.ndarray | None = None

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """(id, x, distortion)."""
        own = spark.createDataFrame(pa.table({"id": pa.array(self.ids), "distortion": pa.array(self.distortion)}))
        return frame_of(spark, self.ids, self.coordinates).join(own, "id")


#: kernel(rows a, rows b, wanted distances) -> sums for a, and for b (None where b is a).
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]]


class Features:
    """Wanted distances of pairs of rows, by a matrix product; close pairs exactly."""

    def __init__(self, values: np.ndarray):
        self.values = values - values.mean(axis=0)
        size = (self.values * self.values).sum(axis=1)
        one = np.ones(len(values))
        # left[i] . right[j] = |i|^2 + |j|^2 - 2 i.j
        self.left, self.right = np.column_stack([self.values, size, one]), np.column_stack([-2 * self.values, one, size])
        self.close = 2 * _CLOSE * float(size.max(initial=0))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d2 = self.left[a[0] : a[-1] + 1] @ self.right[b[0] : b[-1] + 1].T
        close = np.flatnonzero(d2 <= self.close)
        if len(close):
            i, j = np.divmod(close, len(b))
            d2.ravel()[close] = squared_rows(self.values[a[i]], self.values[b[j]])
        return np.sqrt(d2, out=d2)


class DistanceTable:
    """A checked symmetric table of distances, in tiles of pairs (a, b, cells) with a <= b: stored, both halves averaged,
    or numbered alone and worked out from samples each time.  ``first`` has of each sample the first at distance zero by its row."""

    def __init__(self, ids: np.ndarray, tiles: DataFrame, tile: int, values: Broadcast | None = None, first: np.ndarray | None = None):
        self.ids, self.tiles, self.tile, self.values, self.first = ids, tiles, tile, values, first

    @property
    def rows(self) -> int:
        return len(self.ids)

    @staticmethod
    def between(frame: DataFrame, tile_rows: int = SIDE) -> DistanceTable:
        """The Euclidean distances of samples (id, x): no cell is stored or shuffled.  Equal samples stand side by side."""
        measure(frame, 1, check_ids=True)
        ids, values = matrix(frame)
        first = alike(values)
        order = np.argsort(first, kind="stable")
        ids, values, first = ids[order], values[order], np.searchsorted(first[order], first[order])
        spark, side = frame.sparkSession, -(-len(ids) // tile_rows)
        tiles = triangle(spark, side, max(3 * spark.sparkContext.defaultParallelism, len(ids) ** 2 // TASK_CELLS))
        return DistanceTable(ids, tiles, tile_rows, spark.sparkContext.broadcast(values), first)

    @property
    def opened(self) -> Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, Callable[[slice], np.ndarray]]]]:
        """Of a batch of tiles the places of both sides, and what gives the cells of some rows."""
        n, tile, source = self.rows, self.tile, self.values

        def stored_cells(batch: pa.RecordBatch):
            for a, b, cells in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("cells")):
                i, j = _sides(a, b, tile, n)
                yield i, j, np.frombuffer(cells.as_buffer()).reshape(len(i), len(j)).__getitem__

        def measured(batch: pa.RecordBatch):
            for number in batch.column("id").to_pylist():
                i, j = _sides(*corner(number), tile, n)
                u, v = source.value[i], source.value[j]
                yield i, j, lambda place, u=u, v=v: _apart(u[place], v)

        return stored_cells if source is None else measured

    @staticmethod
    def of(cells: DataFrame, tile_rows: int = STORED_TILE) -> DistanceTable:
        """From cells (i, j, d): a full table, finite, not negative, symmetric, with a zero diagonal; anything else is refused."""
        cells = cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("d").cast("double").alias("d"))
        bad = F.coalesce(F.isnan("d") | (F.abs("d") == math.inf) | (F.col("d") < 0), F.lit(True))
        by_row = cells.groupBy("i").agg(F.count("*").alias("n"), F.bool_or(bad).alias("bad"), F.max("d").alias("most"))
        if by_row.limit(MOST_SAMPLES + 1).count() > MOST_SAMPLES:
            raise ValueError(f"more than {MOST_SAMPLES} samples are too many for one table")
        one = by_row.toArrow()
        n = one.num_rows
        if not n or one.column("i").null_count or (one.column("n").to_numpy() != n).any():
            raise ValueError("the distance table must be square and without gaps")
        if any(one.column("bad").to_pylist()):
            raise ValueError("distances must be finite and not negative")
        ids = np.sort(one.column("i").to_numpy())
        slack = 1e-9 * max(1.0, float(one.column("most").to_numpy().max()))
        context = cells.sparkSession.sparkContext
        shared, side = context.broadcast(ids), -(-n // tile_rows)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Cells of a batch by tile: places and values as bytes; the mirrored half lies behind."""
            ids = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                place = []
                for c in ("i", "j"):
                    v = batch.column(c).to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(ids, v), n - 1)
                    place.append(np.where(ids[at] == v, at, -1))
                i, j = place
                upper = i // tile_rows <= j // tile_rows
                a, b = np.where(upper, i, j), np.where(upper, j, i)
                tile = np.where((a < 0) | (b < 0), -1, a // tile_rows * side + b // tile_rows)
                spot = (a % tile_rows * tile_rows + b % tile_rows) * 2 + ~upper
                order = np.argsort(tile, kind="stable")
                tile, spot, d = tile[order], spot[order].astype(np.int32), batch.column("d").to_numpy()[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]])
                ends = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(tile[cuts[:-1]]), pa.array([spot[s:e].tobytes() for s, e in ends], pa.binary()), pa.array([d[s:e].tobytes() for s, e in ends], pa.binary())], ["tile", "spots", "values"])

        def built(tile: int, spots: list[bytes], values: list[bytes]) -> pa.RecordBatch:
            a, b = divmod(tile, side) if tile >= 0 else (0, 0)
            height, width = (min(tile_rows, n - k * tile_rows) for k in (a, b))
            spot, d = np.frombuffer(b"".join(spots), np.int32), np.frombuffer(b"".join(values))
            halves = np.full((2, tile_rows, tile_rows), np.nan)
            halves[spot & 1, (spot >> 1) // tile_rows, (spot >> 1) % tile_rows] = d
            halves = halves[:, :height, :width]
            one, other = (halves[0], halves[0].T) if a == b else halves
            whole = tile >= 0 and len(spot) == height * width * (1 if a == b else 2) and not np.isnan(one).any() and not np.isnan(other).any()
            gap = float(np.abs(one - other).max()) if whole else 0.0
            diagonal = float(np.abs(np.diagonal(one)).max()) if whole and a == b else 0.0
            mean = (one + other) / 2
            if a == b:
                np.fill_diagonal(mean, 0)
            return pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b]), pa.array([whole]), pa.array([gap]), pa.array([diagonal]), pa.array([mean.tobytes()], pa.binary())], ["a", "b", "whole", "gap", "own", "cells"])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, spots, values = None, [], []
            for batch in batches:
                for tile, s, v in zip(batch.column("tile").to_pylist(), batch.column("spots").to_pylist(), batch.column("values").to_pylist()):
                    if tile != now and spots:
                        yield built(now, spots, values)
                        spots, values = [], []
                    now = tile
                    spots.append(s), values.append(v)
            if spots:
                yield built(now, spots, values)

        # by the number of the tile among those above the diagonal, so that tasks get equal numbers of them
        turn = (F.col("tile") / side).cast("long") + (F.col("tile") % side) * (F.col("tile") % side + 1) / 2
        pieces = cells.mapInArrow(cut, "tile long, spots binary, values binary")
        dealt = pieces.repartitionById(min(side * (side + 1) // 2, 4096), F.pmod(turn.cast("long"), F.lit(4096)).cast("int")).sortWithinPartitions("tile")
        tiles = stored(dealt.mapInArrow(build, "a long, b long, whole boolean, gap double, own double, cells binary"), "tiles")
        seen = tiles.agg(F.count("*").alias("n"), F.bool_and("whole").alias("whole"), F.max("gap").alias("gap"), F.max("own").alias("own")).first()
        if seen.n != side * (side + 1) // 2 or not seen.whole:
            raise ValueError("the distance table must be square and without gaps")
        if seen.own > slack:
            raise ValueError("a sample must lie at distance zero from itself")
        if seen.gap > slack:
            raise ValueError("the distance table must be symmetric")
        return DistanceTable(ids, tiles.select("a", "b", "cells"), tile_rows)

    def over_pairs(self, kernel: Kernel, width: int) -> np.ndarray:
        """Sums of the kernel over all tiles, (rows, width)."""
        n, opened = self.rows, self.opened

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, width))
            for batch in batches:
                for a, b, cells in opened(batch):
                    _add(total, kernel, a, b, lambda _, place, cells=cells: cells(place))
            yield from _blocks(total)

        return _gathered(self.tiles.mapInArrow(run, _SUMS), n, width)

    def means(self) -> tuple[np.ndarray, float]:
        """Mean squared distance of each sample, and of all."""
        row = self.over_pairs(_squares, 1)[:, 0] / self.rows
        return row, float(row.mean())

    def matrix(self) -> np.ndarray:
        """The whole table on the driver."""
        out = np.zeros((self.rows, self.rows))
        for batch in self.tiles.toArrow().to_batches():
            for a, b, cells in self.opened(batch):
                d = cells(slice(None))
                out[np.ix_(a, b)], out[np.ix_(b, a)] = d, d.T
        return out

    def cells(self, name: str = "d", centred: bool = False) -> DataFrame:
        """(i, j, value) of all cells: distances, or minus half their squares centred by row, column and grand means."""
        row, grand = self.means() if centred else (np.zeros(0), 0.0)
        opened, shared = self.opened, self.tiles.sparkSession.sparkContext.broadcast((self.ids, row))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, row = shared.value
            for batch in batches:
                for a, b, cells in opened(batch):
                    for s in range(0, len(a), STRIP):
                        own, v = a[s : s + STRIP], cells(slice(s, s + STRIP))
                        if centred:
                            v = -0.5 * (v * v - row[own][:, None] - row[b][None, :] + grand)
                        i, j = np.broadcast_to(ids[own][:, None], v.shape).ravel(), np.broadcast_to(ids[b][None, :], v.shape).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v.ravel())], ["i", "j", name])
                        if a[0] != b[0]:
                            yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(i), pa.array(v.ravel())], ["i", "j", name])

        return self.tiles.mapInArrow(run, f"i long, j long, {name} double")


_SUMS = "block long, v array<double>"
#: Rows of the partial sums that travel together.
_BLOCK_ROWS = 4096


def _sides(a: int, b: int, tile: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.arange(k * tile, min((k + 1) * tile, n)) for k in (a, b))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of two blocks of rows; of single values without squares."""
    return np.abs(np.subtract.outer(x[:, 0], y[:, 0])) if x.shape[1] == 1 else np.sqrt(squared_block(x, y))


def _add(total: np.ndarray, kernel: Kernel, a: np.ndarray, b: np.ndarray, wanted: Callable[[np.ndarray, slice], np.ndarray]) -> None:
    """Add the sums of one tile, strip by strip; ``wanted`` gives the distances of a strip, by its samples and its place."""
    for s in range(0, len(a), STRIP):
        place = slice(s, min(s + STRIP, len(a)))
        strip = a[place]
        own, other = kernel(strip, b, wanted(strip, place))
        total[strip[0] : strip[-1] + 1] += own
        if a[0] != b[0]:
            total[b[0] : b[-1] + 1] += other


def _blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(total), _BLOCK_ROWS):
        part = total[k : k + _BLOCK_ROWS]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK_ROWS]), lists_of(part.reshape(1, -1))], ["block", "v"])


def _gathered(partial: DataFrame, n: int, width: int) -> np.ndarray:
    """Partial sums by block of rows, added up on the executors, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, v in zip(batch.column("block").to_pylist(), batch.column("v")):
                values = v.values.to_numpy()
                held[block] = held[block] + values if block in held else values.copy()
        for block, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), lists_of(values[None, :])], ["block", "v"])

    out = np.zeros((n, width))
    spread = partial.repartitionById(min(-(-n // _BLOCK_ROWS), 64), F.pmod("block", F.lit(64)).cast("int"))
    table = spread.mapInArrow(run, _SUMS).toArrow()
    for block, v in zip(table.column("block").to_pylist(), table.column("v")):
        out[block * _BLOCK_ROWS : (block + 1) * _BLOCK_ROWS] = v.values.to_numpy().reshape(-1, width)
    return out


def _squares(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = d * d
    return s.sum(axis=1)[:, None], s.sum(axis=0)[:, None]


class Targets:
    """Wanted distances by pairs of rows: from features, or of a table."""

    def __init__(self, spark: SparkSession, rows: int, features: np.ndarray | None = None, table: DistanceTable | None = None, local: bool | None = None):
        self.spark, self.rows, self.table = spark, rows, table
        self.local = rows <= LOCAL_ROWS if local is None else local
        self.wanted = Features(features) if features is not None else None
        # on the driver each step asks for the same distances
        every = np.arange(rows)
        self.matrix = (table.matrix() if table is not None else self.wanted(every, every)) if self.local else None
        self.source = None if self.local or table is not None else spark.sparkContext.broadcast(self.wanted)

    def over_pairs(self, kernel: Kernel, width: int) -> np.ndarray:
        """Sums of the kernel over all pairs, (rows, width)."""
        n, total = self.rows, np.zeros((self.rows, width))
        edges = [np.arange(k, min(k + TILE, n)) for k in range(0, n, TILE)]
        if self.local:
            for k, a in enumerate(edges):
                for b in edges[k:]:
                    _add(total, kernel, a, b, lambda strip, _, b=b: self.matrix[strip[0] : strip[-1] + 1, b[0] : b[-1] + 1])
            return total
        if self.table is not None:
            return self.table.over_pairs(kernel, width)
        source, parts = self.source, min(len(edges), 3 * self.spark.sparkContext.defaultParallelism)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted: Features = source.value
            total = np.zeros((n, width))
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    a = np.arange(k * TILE, min((k + 1) * TILE, n))
                    for at in range(k * TILE, n, TILE):
                        b = np.arange(at, min(at + TILE, n))
                        _add(total, kernel, a, b, lambda strip, _, b=b: wanted(strip, b))
            yield from _blocks(total)

        # rows of tiles shorten with their number: every task gets long and short ones
        dealt = self.spark.range(len(edges)).repartitionById(parts, (F.col("id") % parts).cast("int"))
        return _gathered(dealt.mapInArrow(run, _SUMS), n, width)


def misfit(x: np.ndarray) -> Kernel:
    """Per row: sum of squared misfits, sum of squared targets, then the pull of the Guttman transform."""

    def kernel(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = x[a], x[b]
        distance = np.subtract.outer(u[:, 0], v[:, 0])
        distance *= distance
        for c in range(1, x.shape[1]):
            d = np.subtract.outer(u[:, c], v[:, c])
            d *= d
            distance += d
        np.sqrt(distance, out=distance)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = wanted / distance
        if not distance.min():
            ratio[distance == 0] = 0
        gap = np.subtract(wanted, distance, out=distance)
        # sums and pulls of both sides are products with (1, place)
        ahead, back = ratio @ np.column_stack([np.ones(len(b)), v]), ratio.T @ np.column_stack([np.ones(len(a)), u])
        pull = ahead[:, :1] * u - ahead[:, 1:], back[:, :1] * v - back[:, 1:]
        np.multiply(gap, gap, out=gap)
        size = np.multiply(wanted, wanted, out=ratio)
        return tuple(np.column_stack([gap.sum(axis=way), size.sum(axis=way), p]) for way, p in zip((1, 0), pull))

    return kernel


def _stress(out: np.ndarray) -> tuple[float, np.ndarray]:
    """Stress and distortions from the sums of ``misfit``."""
    scale = out[:, 1].sum()
    own = np.sqrt(np.divide(out[:, 0], out[:, 1], out=np.zeros(len(out)), where=out[:, 1] > 0))
    return (math.sqrt(out[:, 0].sum() / scale) if scale > 0 else 0.0), own


def stress_of(targets: Targets, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Kruskal's stress-1 and the same ratio over each sample's own pairs."""
    return _stress(targets.over_pairs(misfit(x), 2 + x.shape[1]))


def majorise(targets: Targets, x: np.ndarray, options: ScalingOptions, sums: np.ndarray | None = None) -> tuple[np.ndarray, int, bool, np.ndarray]:
    """Stress majorisation from x: (map, steps, converged, misfit sums of the map).

    One pass over the pairs yields the misfit of x and the next map at once; ``sums`` are those of x where they are known.
    """
    before = math.inf
    for step in range(options.maximum_iterations + 1):
        if step or sums is None:
            sums = targets.over_pairs(misfit(x), 2 + x.shape[1])
        now = sums[:, 0].sum() / 2
        if step and before - now <= options.tolerance * before:
            return x, step, True, sums
        if step == options.maximum_iterations:
            return x, step, False, sums
        before, x = now, sums[:, 2:] / len(x)
    raise AssertionError


def _finish(targets: Targets, ids: np.ndarray, x: np.ndarray, kept: np.ndarray, retained: float, negative: float, notes: list[Note], options: ScalingOptions, axes=None, centre=None) -> ScalingResult:
    k = options.dimensions
    for axis in range(k):
        if axis >= len(kept) or kept[axis] <= NEGLIGIBLE * max(kept[0], 0) or kept[axis] <= 0:
            x[:, axis] = 0
            notes.append(Note.remark(f"Axis {axis + 1} of {k} carries no structure and is left at zero."))
    sums = targets.over_pairs(misfit(x), 2 + k)
    classical, own = _stress(sums)
    stress, steps, converged = classical, 0, True
    if options.refine and classical > 0:
        x, steps, converged, sums = majorise(targets, x, options, sums)
        stress, own = _stress(sums)
        if not converged:
            notes.append(Note.remark(f"Refinement stopped at its cap of {options.maximum_iterations} steps."))
    return ScalingResult(ids, x, kept, retained, negative, classical, stress, own, steps, converged, tuple(notes), axes, centre)


def from_features(frame: DataFrame, options: ScalingOptions = ScalingOptions(), local: bool | None = None) -> ScalingResult:
    """A map of samples by their features; distances are those between the features."""
    from .linalg import covariance

    extent = measure(frame, 2)
    options.validate(extent.rows)
    n, mean, cov = covariance(frame)
    values, vectors = symmetric_eigen(cov)
    values = np.maximum(values, 0) * (n - 1)
    k = options.dimensions
    axes = np.zeros((k, extent.width))
    axes[: min(k, extent.width)] = vectors[:, :k].T
    ids, features = matrix(frame)
    notes = [Note.remark(f"The features have {extent.width} column(s), so a map of {k} only rotates them.")] if extent.width <= k else []
    kept = np.zeros(k)
    kept[: min(k, len(values))] = values[:k]
    total = (values**2).sum()
    retained = float((kept**2).sum() / total) if total > 0 else 0.0
    targets = Targets(frame.sparkSession, n, features=features, local=local)
    return _finish(targets, ids, (features - mean) @ axes.T, kept, retained, math.nan, notes, options, axes, mean)


def checked_table(cells: DataFrame) -> DataFrame:
    """Cells (i, j, d) of a full symmetric table: finite, not negative, zero diagonal, no gaps; both halves averaged."""
    return DistanceTable.of(cells).cells()


def double_centre(cells: DataFrame | DistanceTable) -> DataFrame:
    """(i, j, b): minus half the squared distances, centred by row, column and grand means.

    Of a plain table of cells the means are aggregated first (combined before the
    shuffle) and joined back; of a checked table they come from its tiles.
    """
    if isinstance(cells, DistanceTable):
        return cells.cells("b", centred=True)
    square = cells.select("i", "j", (F.col("d") * F.col("d")).alias("s"))
    row = square.groupBy("i").agg(F.avg("s").alias("r"))
    column = square.groupBy("j").agg(F.avg("s").alias("c"))
    grand = square.agg(F.avg("s").alias("g"))
    return square.join(row, "i").join(column, "j").join(F.broadcast(grand)).select("i", "j", (F.lit(-0.5) * (F.col("s") - F.col("r") - F.col("c") + F.col("g"))).alias("b"))


def _centred_product(table: DistanceTable, row: np.ndarray, grand: float) -> Callable[[np.ndarray], np.ndarray]:
    """B @ block of the centred table B, tile by tile."""

    def multiply(block: np.ndarray) -> np.ndarray:
        def kernel(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = d * d
            return s @ block[b], s.T @ block[a]

        whole = block.sum(axis=0)[None, :]
        return -0.5 * (table.over_pairs(kernel, block.shape[1]) - row[:, None] * whole - (row[None, :] @ block) + grand * whole)

    return multiply


def from_distances(cells: DataFrame | DistanceTable, options: ScalingOptions = ScalingOptions(), local: bool | None = None) -> ScalingResult:
    """A map of a distance table (i, j, d), in the order of the ids.  Large tables stay in tiles on the executors.

    Samples that a table knows to be equal get one place: their rows are the same, so they part by rounding alone.
    """
    table = cells if isinstance(cells, DistanceTable) else DistanceTable.of(cells)
    found = _from_table(table, options, local)
    x = found.coordinates if table.first is None else found.coordinates[table.first]
    order = np.argsort(found.ids)
    return replace(found, ids=found.ids[order], coordinates=x[order], distortion=found.distortion[order])


def _from_table(table: DistanceTable, options: ScalingOptions, local: bool | None) -> ScalingResult:
    spark, ids, n, k = table.tiles.sparkSession, table.ids, table.rows, options.dimensions
    options.validate(n)
    targets = Targets(spark, n, table=table, local=local)
    row = targets.over_pairs(_squares, 1)[:, 0] / n
    grand = float(row.mean())
    if not grand > 0:
        return ScalingResult(ids, np.zeros((n, k)), np.zeros(k), 0.0, 0.0, 0.0, 0.0, np.zeros(n), 0, True, (Note.remark("Every distance is zero, so all samples share one place."),))

    def centred_squares(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(a, b, -0.5 * (d * d - row[a][:, None] - row[b][None, :] + grand))

    if targets.local:
        s = targets.matrix * targets.matrix
        b = -0.5 * (s - row[:, None] - row[None, :] + grand)
        multiply = lambda block: b @ block
    else:
        multiply = _centred_product(table, row, grand)
    values, vectors, negative = _leading(multiply, n, k, options.seed)
    notes = []
    if negative < -NEGLIGIBLE * max(values[0], 0):
        notes.append(Note.remark("These distances are not those of points in any flat space; the map is an approximation."))
    kept = np.zeros(k)
    kept[: len(values)] = np.maximum(values, 0)
    x = np.zeros((n, k))
    x[:, : len(values)] = vectors * np.sqrt(np.maximum(values, 0))
    total = float(targets.over_pairs(centred_squares, 1).sum())
    return _finish(targets, ids, x, kept, float((kept**2).sum() / total) if total > 0 else 0.0, negative, notes, options)


def _leading(multiply: Callable[[np.ndarray], np.ndarray], n: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The most positive eigenpairs of a symmetric operator by iteration on its square, and the most negative value seen."""
    ask = min(n, count + HEADROOM)
    while True:
        _, vectors, _, _ = leading_eigen(n, lambda block: multiply(multiply(block)), ask, seed, EIGEN_TOLERANCE)
        # inside the found space the signs of equal squares are told apart by a small eigenproblem
        values, rotation = symmetric_eigen(vectors.T @ multiply(vectors))
        vectors = vectors @ rotation
        positive = np.flatnonzero(values > 0)[:count]
        if len(positive) == count or ask == n:
            return values[positive], canonical_signs(vectors[:, positive]), float(min(values.min(), 0.0))
        ask = min(n, ask * 2)
