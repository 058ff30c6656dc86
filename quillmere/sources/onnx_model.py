"""Read ONNX models with their record, and score DataFrames with them.

The driver loads a model once to check it and to know its task, which decides the
output columns before a plan exists; executors get the bytes by broadcast and
keep one session for each model and worker.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .onnx_metadata import METADATA_KEY, InvalidModelData, ModelMetadata

_SESSIONS: dict[str, OnnxModel] = {}


@dataclass(frozen=True)
class Prediction:
    """Answers for a block of rows; what does not belong to the task is empty."""

    labels: tuple[str, ...] = ()
    label_index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    confidence: np.ndarray = field(default_factory=lambda: np.zeros(0))
    probabilities: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))


class OnnxModel:
    """A loaded model."""

    def __init__(self, data: bytes, key: str = METADATA_KEY, last_write: datetime | None = None):
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        options.log_severity_level = 4
        try:
            self._session = ort.InferenceSession(data, options, providers=["CPUExecutionProvider"])
        except Exception as error:
            raise InvalidModelData(f"the model cannot be loaded: {error}") from error
        self.data, self.key, self.last_write = data, key, last_write
        record = self._session.get_modelmeta().custom_metadata_map.get(key)
        self.metadata = ModelMetadata.from_json(record) if record else None
        inputs = self._session.get_inputs()
        if len(inputs) != 1:
            raise InvalidModelData(f"a model must have one input, this one has {len(inputs)}")
        self._input = inputs[0]
        if self._input.type != "tensor(float)" or len(self._input.shape) != 2:
            raise InvalidModelData("the input must be a table of float32")
        width = self._input.shape[1]
        if isinstance(width, int) and self.metadata and width != len(self.metadata.features):
            raise InvalidModelData(f"the record names {len(self.metadata.features)} features, the model takes {width}")
        self.feature_count = width if isinstance(width, int) else len(self.metadata.features) if self.metadata else None
        if self.feature_count is None:
            raise InvalidModelData("neither the model nor a record tells the number of features")
        outputs = {o.name: o for o in self._session.get_outputs()}
        if not outputs:
            raise InvalidModelData("the model has no output")
        first = next(iter(outputs))
        if self.metadata:
            self.task = self.metadata.task
        else:
            integral = outputs[first].type in ("tensor(int64)", "tensor(int32)")
            self.task = "classification" if "label" in outputs or integral else "regression"
        if self.task == "classification":
            self._label = "label" if "label" in outputs else first
            floats = [n for n, o in outputs.items() if n != self._label and o.type == "tensor(float)"]
            self._probabilities = "probabilities" if "probabilities" in outputs else floats[0] if floats else None
        else:
            self._value = "value" if "value" in outputs else first

    @staticmethod
    def load(path: str, key: str = METADATA_KEY) -> OnnxModel:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        with open(path, "rb") as file:
            return OnnxModel(file.read(), key, datetime.fromtimestamp(os.path.getmtime(path), UTC))

    @property
    def has_metadata(self) -> bool:
        return self.metadata is not None

    @property
    def feature_names(self) -> tuple[str, ...]:
        return self.metadata.features if self.metadata else tuple(f"feature {i}" for i in range(self.feature_count))

    def describe(self) -> list[str]:
        return self.metadata.describe() if self.metadata else [f"A {self.task} model of {self.feature_count} features without a record"]

    def predict(self, rows: np.ndarray) -> Prediction:
        """Answers for rows of finite values."""
        rows = np.asarray(rows, float)
        if rows.ndim != 2 or rows.shape[1] != self.feature_count:
            raise ValueError(f"the model takes {self.feature_count} features")
        if not np.isfinite(rows).all():
            raise ValueError("features must be finite")
        if not len(rows):
            return Prediction()
        with np.errstate(over="ignore"):
            block = rows.astype(np.float32)
        found = dict(zip([o.name for o in self._session.get_outputs()], self._session.run(None, {self._input.name: block})))
        if self.task == "regression":
            values = np.asarray(found[self._value], float).ravel()
            if len(values) != len(rows):
                raise InvalidModelData("the model did not answer each row with one value")
            return Prediction(values=values)
        return self._classes(found, len(rows))

    def _classes(self, found: dict, n: int) -> Prediction:
        raw = np.asarray(found[self._label]).ravel()
        if len(raw) != n:
            raise InvalidModelData("the model did not answer each row with one label")
        if raw.dtype.kind in "iu":
            index = raw.astype(np.int64)
        else:
            index = np.array([int(v) if str(v).strip().lstrip("+-").isdigit() else -1 for v in raw], np.int64)
        p = np.zeros((n, 0))
        if self._probabilities:
            p = np.asarray(found[self._probabilities], float).reshape(n, -1)
        confidence = np.ones(n)
        if p.shape[1]:
            inside = (index >= 0) & (index < p.shape[1])
            confidence = np.where(inside, p[np.arange(n), np.where(inside, index, 0)], 1.0)
        if self.metadata:
            if ((index < 0) | (index >= len(self.metadata.classes))).any():
                raise InvalidModelData("the model chose a class that its record does not name")
            labels = tuple(self.metadata.classes[i] for i in index)
        else:
            labels = tuple(map(str, index))
        return Prediction(labels, index, confidence, p)


def _cached(data: bytes, key: str) -> OnnxModel:
    mark = hashlib.sha256(data).hexdigest() + key
    if mark not in _SESSIONS:
        _SESSIONS[mark] = OnnxModel(data, key)
    return _SESSIONS[mark]


def score(df: DataFrame, model: OnnxModel, features: list[str] | str = "x") -> DataFrame:
    """``df`` with the model's answers: label, label_index, confidence, probabilities; or value.

    ``features``: one array column, or one column for each feature.  Works on streams too.
    """
    shared, key, task = df.sparkSession.sparkContext.broadcast(model.data), model.key, model.task
    if task == "classification":
        more = [("label", T.StringType()), ("label_index", T.LongType()), ("confidence", T.DoubleType()), ("probabilities", T.ArrayType(T.DoubleType()))]
    else:
        more = [("value", T.DoubleType())]
    taken = {f.name for f in df.schema.fields} & {n for n, _ in more}
    if taken:
        raise ValueError(f"the columns {sorted(taken)} exist already")
    names = [f.name for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _cached(shared.value, key)
        for batch in batches:
            if isinstance(features, str):
                column = batch.column(features)
                rows = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, own.feature_count))
            else:
                rows = np.column_stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features])
            p = own.predict(rows)
            if task == "classification":
                new = [pa.array(p.labels, pa.string()), pa.array(p.label_index, pa.int64()), pa.array(p.confidence, pa.float64()), pa.array(list(p.probabilities), pa.list_(pa.float64()))]
            else:
                new = [pa.array(p.values, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *new], [*names, *(n for n, _ in more)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in more)]))


def read_models(spark: SparkSession, path: str, key: str = METADATA_KEY) -> DataFrame:
    """(path, modified, task, features, target, classes, record) of the models in a folder, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = [OnnxModel(c, key) for c in batch.column("content").to_pylist()]
            meta = [m.metadata for m in models]
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("modificationTime"), pa.array([m.task for m in models]), pa.array([list(m.feature_names) for m in models], pa.list_(pa.string())), pa.array([m.target if m else None for m in meta], pa.string()), pa.array([list(m.classes) if m else None for m in meta], pa.list_(pa.string())), pa.array([m.to_json() if m else None for m in meta], pa.string())],
                ["path", "modified", "task", "features", "target", "classes", "record"],
            )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.onnx").load(path).select("path", "modificationTime", "content")
    return files.mapInArrow(run, "path string, modified timestamp, task string, features array<string>, target string, classes array<string>, record string")
