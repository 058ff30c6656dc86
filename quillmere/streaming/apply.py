"""Fitted transforms and models on streams: they keep no state, so they apply to a streaming frame as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.preprocessing import FeaturePipeline
from ..sources.onnx_model import OnnxModel, score


def read_folder(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepared(stream: DataFrame, pipeline: FeaturePipeline, column: str = "x") -> DataFrame:
    """The stream with its samples prepared by a pipeline fitted on a batch."""
    return pipeline.transform(stream, column)


def scored(stream: DataFrame, model: OnnxModel, features: list[str] | str = "x") -> DataFrame:
    """The stream with the model's answers."""
    return score(stream, model, features)


def write_folder(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """Start writing the stream to Parquet files, or call ``each`` with every batch; returns the running query."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
