"""Shared plumbing: scratch folders, written tables, Arrow text access, label folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer single text is a pass of its own.
SLICE_BYTES = 1 << 20

#: Rows below which a table of (long id, small value) rows may be broadcast: at most some 32 MB.
BROADCAST_ROWS = 2_000_000


_MADE: list[str] = []

#: Rows of one Arrow batch: long texts must not add up in a worker.
ARROW_ROWS = 1024


def arrow_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``ARROW_ROWS`` rows, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the cluster's shared folder (``spark.checkpoint.dir``).

    Where the setting is absent (tests), a temporary folder is set and used, but only in
    local mode: on a cluster it would be a folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='quillmere-')}"
        spark.sparkContext.setCheckpointDir(base)
    _MADE.append(f"{base.rstrip('/')}/quillmere-{what}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the folders that ``scratch`` named in this process; results read from them must have been stored before."""
    count = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        count += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return count


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_turn(shared: list):
    """The values of broadcasts one after the other; of several, only the present one is held by the worker."""
    for one in shared:
        yield one.value
        if len(shared) > 1:
            one.__dict__.pop("_value", None)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose text has at most ``budget`` bytes, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + budget, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until they clash with no column of ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken or f"{name}_".lower() in taken:
            name += "_x"
        out.append(name)
    return out


def share_limit(rows: int, of: int) -> int:
    """What at most a share rows / of of all 64-bit hashes reach, however small the share."""
    return -(2**63) + min(2**64 - 1, 2**64 * rows // max(of, 1))


def chosen(id_column: str, rows: int, of: int) -> F.Column:
    """Whether a hash of the id falls into the share rows / of: about ``rows`` ids of ``of``."""
    return F.xxhash64(id_column) <= F.lit(share_limit(rows, of))


def fold(id_column: str, of: int) -> F.Column:
    """crc32 of the id as text, modulo ``of``: the contract's folds."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(of)
