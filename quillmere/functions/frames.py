"""The sample frame: one row per sample, ``id`` (long, carries every tie rule) and ``x`` (array of doubles)."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Doubles that may be brought to the driver or broadcast as one block (256 MB).
DRIVER_CELLS = 32_000_000


@dataclass(frozen=True)
class Note:
    """A remark or warning for the reader of a result."""

    text: str
    level: str = "remark"

    @staticmethod
    def remark(text: str) -> Note:
        return Note(text)

    @staticmethod
    def warning(text: str) -> Note:
        return Note(text, "warning")


@dataclass(frozen=True)
class Extent:
    rows: int
    width: int


def samples(df: DataFrame, id_column: str, columns: list[str] | str) -> DataFrame:
    """A sample frame from numeric columns, or from one array column."""
    x = F.col(columns).cast("array<double>") if isinstance(columns, str) else F.array(*(F.col(c).cast("double") for c in columns))
    return df.select(F.col(id_column).cast("long").alias("id"), x.alias("x"))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def measure(frame: DataFrame, least_rows: int = 1, check_ids: bool = False) -> Extent:
    """Rows and width in one aggregation; ragged rows, nulls, NaN and infinities are refused."""
    bad = F.exists("x", lambda v: ~finite(v))
    checks = [F.count("*").alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), F.bool_or(F.coalesce(bad, F.lit(True)) | F.col("id").isNull()).alias("bad")]
    row = frame.agg(*checks).first()
    if row.n < least_rows:
        raise ValueError(f"at least {least_rows} sample(s) are needed, there are {row.n}")
    if row.n == 0:
        return Extent(0, 0)
    if row.bad:
        raise ValueError("every sample needs an id and finite values")
    if row.lo != row.hi:
        raise ValueError(f"samples have between {row.lo} and {row.hi} values")
    if row.lo < 1:
        raise ValueError("samples need at least one value")
    if check_ids and frame.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("sample ids must be unique")
    return Extent(int(row.n), int(row.lo))


def matrix(frame: DataFrame, most_cells: int = DRIVER_CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Ids (ascending) and values as numpy arrays on the driver; refused beyond ``most_cells`` doubles."""
    size = frame.agg(F.sum(F.size("x"))).first()[0] or 0
    if size > most_cells:
        raise ValueError(f"{size} values are too many for the driver (limit {most_cells})")
    table = frame.select("id", "x").orderBy("id").toArrow()
    ids = table.column("id").to_numpy()
    lists = table.column("x").combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, values.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def frame_of(spark, ids: np.ndarray, values: np.ndarray, name: str = "x") -> DataFrame:
    """A frame (id, name) from driver arrays."""
    import pyarrow as pa

    flat = pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * values.shape[1], pa.int32()), flat)
    return spark.createDataFrame(pa.table({"id": pa.array(np.asarray(ids, np.int64)), name: lists}))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Unset, a temporary folder is set and used, but only where everything runs in one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='quillmere-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/quillmere-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_ids(frame: DataFrame) -> DataFrame:
    """(id, index): ranks from 0 in the order of the ids.  Ranges of ids are numbered apart and offset, so no task sees all rows.

    The ranges are stored before they are counted: bounds of a second evaluation would differ.
    """
    spread = frame.select("id").repartitionByRange("id").sortWithinPartitions("id")
    local = stored(spread.select("id", F.spark_partition_id().alias("part")), "ranges")
    local = local.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)
    sizes = sorted((r.part, r["count"]) for r in local.groupBy("part").count().collect())
    before, total = {}, 0
    for part, n in sizes:
        before[part] = total
        total += n
    if not before:
        return local.select("id", F.lit(0).cast("long").alias("index"))
    starts = F.create_map(*(F.lit(v) for part, n in before.items() for v in (part, n)))
    return local.select("id", (F.col("place") + starts[F.col("part")]).cast("long").alias("index"))
