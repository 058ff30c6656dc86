"""Feature preparation: row normalisation, log, standardisation, weights, constant columns; and the way back.

Fitting is one aggregation that returns one row of moments; transforms are lazy
projections of element expressions that stay inside code generation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import finite

#: Fixed value: a column whose deviation is at most this share of its centre's size (at least 1) is constant.
CONSTANT = 1e-12


def elements(x: Column | str, width: int) -> list[Column]:
    return [F.get(x, F.lit(i)) for i in range(width)]


def normalised(values: list[Column]) -> list[Column]:
    """Values over the row's Euclidean length; a zero row stays."""
    total = values[0] * values[0]
    for v in values[1:]:
        total = total + v * v
    length = F.sqrt(total)
    return [F.when(length > 0, F.try_divide(v, length)).otherwise(v) for v in values]


def logged(values: list[Column]) -> list[Column]:
    """ln(1 + v); negative values end the query with an error."""
    refuse = F.raise_error(F.lit("the log of a negative value was asked for")).cast("double")
    return [F.when(v < 0, refuse).otherwise(F.log(F.lit(1.0) + v)) for v in values]


@dataclass(frozen=True)
class FeaturePipeline:
    """A fitted preparation; immutable."""

    width: int
    kept_columns: tuple[int, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    log_transform: bool = False
    normalise_rows: bool = False
    dropped: tuple[int, ...] = field(default=())

    @staticmethod
    def fit(frame: DataFrame, log_transform: bool = False, normalise_rows: bool = False, weights: list[float] | None = None) -> FeaturePipeline:
        """Means and population deviations after row normalisation and log; constant and zero-weight columns are left out."""
        first = frame.select(F.size("x").alias("d")).limit(1).collect()
        if not first:
            raise ValueError("no samples to fit on")
        d = first[0].d
        weights = [1.0] * d if weights is None else [float(w) for w in weights]
        if len(weights) != d:
            raise ValueError(f"{len(weights)} weights for {d} columns")
        staged = _staged(F.col("x"), d, log_transform, normalise_rows)
        one = frame.select(*(v.alias(f"v{i}") for i, v in enumerate(staged)), (F.size("x") == d).alias("ok"))
        moments = [f(f"v{i}").alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        good = F.col("ok")
        for i in range(d):
            good = good & finite(F.col(f"v{i}"))
        row = one.agg(*moments, F.bool_and(F.coalesce(good, F.lit(False))).alias("good")).first()
        if not row.good:
            raise ValueError(f"every sample needs {d} finite values")
        centre, scale = [row[f"m{i}"] for i in range(d)], [row[f"s{i}"] for i in range(d)]
        kept = [i for i in range(d) if scale[i] > CONSTANT * max(1.0, abs(centre[i])) and weights[i] != 0]
        if not kept:
            raise RuntimeError("no column varies, nothing is left to prepare")
        return FeaturePipeline(d, tuple(kept), tuple(centre), tuple(scale), tuple(weights), log_transform, normalise_rows, tuple(i for i in range(d) if i not in kept))

    def expressions(self, x: Column | str) -> list[Column]:
        staged = _staged(F.col(x) if isinstance(x, str) else x, self.width, self.log_transform, self.normalise_rows)
        return [(staged[i] - F.lit(self.centre[i])) / F.lit(self.scale[i]) * F.lit(self.weights[i]) for i in self.kept_columns]

    def transform(self, frame: DataFrame, column: str = "x") -> DataFrame:
        """Prepared values of the kept columns; other columns of the frame stay.  Works on streams too."""
        refuse = F.raise_error(F.lit(f"samples must have {self.width} values")).cast("array<double>")
        return frame.withColumn(column, F.when(F.size(column) == self.width, F.array(*self.expressions(column))).otherwise(refuse))

    def inverse_transform(self, frame: DataFrame, column: str = "x") -> DataFrame:
        """Back to all columns; left-out ones return their centre, row lengths do not come back."""
        place = {c: k for k, c in enumerate(self.kept_columns)}
        back = []
        for i in range(self.width):
            v = F.get(column, F.lit(place[i])) / F.lit(self.weights[i]) * F.lit(self.scale[i]) + F.lit(self.centre[i]) if i in place else F.lit(self.centre[i])
            back.append(F.exp(v) - 1.0 if self.log_transform else v)
        refuse = F.raise_error(F.lit(f"prepared samples must have {len(self.kept_columns)} values")).cast("array<double>")
        return frame.withColumn(column, F.when(F.size(column) == len(self.kept_columns), F.array(*back)).otherwise(refuse))


def _staged(x: Column, width: int, log_transform: bool, normalise_rows: bool) -> list[Column]:
    values = elements(x, width)
    if normalise_rows:
        values = normalised(values)
    return logged(values) if log_transform else values
