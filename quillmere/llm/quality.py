"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Learned
filters run over each chunk's bytes (through a learned byte embedding) and
are max-pooled.  The largest and the mean pooled values of the chunks are combined by
a logistic layer into one probability.

Trained with Adam on a bounded sample of labelled rows on the driver; scored on
the executors.  With the weights fixed, each filter tap is a table by byte, so a
convolution is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chosen, fold, raw_text, slices

CHUNK, STEP = 1024, 896
FILTERS, TAPS, EMBED = 16, 6, 8
#: Labelled rows that the network is trained on, at most about this many, none of more than so many bytes.
TRAIN_ROWS, TRAIN_BYTES = 3_000, 32_768
EPOCHS, BATCH, RATE = 7, 32, 0.01
#: Steps that a small sample is trained for at least, over more epochs.
LEAST_STEPS = 400
THRESHOLD = 0.7
#: Chunks that are convolved at once.
_BLOCK = 16


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (chunks, CHUNK), zero-padded, and the n+1 offsets of the texts' chunks; an empty text has one empty chunk."""
    n = np.diff(offsets)
    count = np.maximum(1, -(-(n - CHUNK) // STEP) + 1)
    text = np.repeat(np.arange(len(n)), count)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < n[text][:, None]
    padded = np.append(data, np.uint8(0))
    return np.where(inside, padded[np.where(inside, offsets[:-1][text][:, None] + at, len(data))], np.uint8(0)), np.concatenate([[0], np.cumsum(count)])


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (TAPS, EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    dense: np.ndarray  # (2 * FILTERS + 1,)

    @classmethod
    def new(cls, seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.5, (256, EMBED)), r.normal(0, 0.3, (TAPS, EMBED, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.1, 2 * FILTERS + 1))

    def taps(self) -> np.ndarray:
        """(TAPS, 256, FILTERS): what a byte adds to each filter at each tap."""
        return np.einsum("be,tef->tbf", self.embed, self.filters).astype(np.float32)

    def pooled(self, matrix: np.ndarray, taps: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled filter values (chunks, FILTERS) before the bias, and the places of the maxima."""
        width = CHUNK - TAPS + 1
        out = np.empty((len(matrix), FILTERS), np.float32)
        place = np.empty((len(matrix), FILTERS), np.int64) if where else None
        for i in range(0, len(matrix), _BLOCK):
            rows = matrix[i : i + _BLOCK]
            total = taps[0][rows[:, :width]]
            for t in range(1, TAPS):
                total += taps[t][rows[:, t : t + width]]
            if where:
                place[i : i + _BLOCK] = total.argmax(axis=1)
            out[i : i + _BLOCK] = total.max(axis=1)
        return out, place

    def combine(self, pooled: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk values (chunks, FILTERS) and the logistic layer's inputs."""
        value = np.maximum(pooled + self.bias, 0)
        n = np.diff(bounds)[:, None]
        x = np.column_stack([np.maximum.reduceat(value, bounds[:-1]), np.add.reduceat(value, bounds[:-1]) / n, np.ones(len(n))])
        return value, x

    def score(self, data: np.ndarray, offsets: np.ndarray, taps: np.ndarray) -> np.ndarray:
        matrix, bounds = chunks(data, offsets)
        _, x = self.combine(self.pooled(matrix, taps)[0], bounds)
        return 1 / (1 + np.exp(-np.clip(x @ self.dense, -30, 30)))


def train(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam on the cross-entropy; labels 0 or 1, one for each text."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    matrix, bounds = chunks(data, offsets)
    weights = [net.embed, net.filters, net.bias, net.dense]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    epochs = max(epochs, -(-LEAST_STEPS // max(1, -(-len(labels) // BATCH))))
    for epoch in range(epochs):
        order = r.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            texts = order[i : i + BATCH]
            rows = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in texts])
            own = np.concatenate([[0], np.cumsum(np.diff(bounds)[texts])])
            part = matrix[rows]
            pooled, place = net.pooled(part, net.taps(), where=True)
            value, x = net.combine(pooled, own)
            p = 1 / (1 + np.exp(-np.clip(x @ net.dense, -30, 30)))
            miss = (p - labels[texts]) / len(texts)
            g_dense = x.T @ miss + 1e-4 * net.dense
            g_x = miss[:, None] * net.dense[None, :]
            text = np.repeat(np.arange(len(texts)), np.diff(own))
            top = value == np.maximum.reduceat(value, own[:-1])[text]
            k = FILTERS
            g = (top * g_x[text, :k] / np.maximum(np.add.reduceat(top, own[:-1]), 1)[text] + g_x[text, k : 2 * k] / np.diff(own)[text][:, None]) * (value > 0)
            window = part[np.arange(len(part))[:, None, None], place[:, :, None] + np.arange(TAPS)]  # (chunks, FILTERS, TAPS)
            seen = net.embed[window]  # (chunks, FILTERS, TAPS, EMBED)
            g_filters = np.einsum("cf,cfte->tef", g, seen)
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, window, g[:, :, None, None] * net.filters.transpose(2, 0, 1)[None])
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for w, d, m, v in zip(weights, (g_embed, g_filters, g.sum(axis=0), g_dense), first, second):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Network | float:
    """Train on a sample of labelled rows whose crc32(id) mod 4 is not 2: about ``rows`` of at most ``most_bytes`` bytes.

    Where one class has no such row the result is no network but the share of label 1.
    """
    side = labels.where(F.col(label_column).isin(0, 1) & (fold(id_column, 4) != 2)).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    sample = side.where(chosen("id", rows, side.count()))
    base = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes)
    table = base.join(F.broadcast(sample), "id").select("id", "text", "label").toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
    y = table.column("label").to_numpy().astype(float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    data, offsets = raw_text(table.column("text"))
    return train(data, offsets, y)


def _score(shared, keep: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        taps = None if isinstance(net, float) else net.taps()
        for batch in batches:
            for part in slices(batch):
                score = np.full(part.num_rows, net) if taps is None else net.score(*raw_text(part.column("text")), taps)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return run


def quality(docs: DataFrame, network: Network | float, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts are one empty chunk and get the network's value for it.
    Repeated rows get equal results; other columns are not read.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(_score(shared, ["doc_id"], threshold), schema).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
