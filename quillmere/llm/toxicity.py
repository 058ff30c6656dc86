"""Toxicity by class-conditional Kneser-Ney character models.

Two five-gram models over the bytes of lower-cased words, one of the toxic and one of
the ordinary labelled texts, give each byte a likelihood.  Orders five and four
count by class (order four by Kneser-Ney continuation counts); below, both
back off to the same shared counts of both classes, so an expression that a
class has hardly seen is judged alike by both and tells little.  The compared
value is length-normalised: the mean log-likelihood ratio over windows of a few
words and over the whole text.  A logistic curve, fitted on labelled rows
that gave no counts, turns the values into a probability.

Counts are summed on the executors over all labelled rows of their folds.  The
scoring tables hold every counted n-gram, exactly.  All that the likelihood of a byte needs
shares the three bytes before it, so the tables fall into shards by these: as many
as there are n-grams for, each of bounded size, made and broadcast one by one.  A worker holds
one shard at a time and takes a few megabytes of text through all of them.  Only the
shared counts of three bytes (at most 2**24) stand apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import BROADCAST_ROWS, chosen, fold, in_turn, raw_text, slices, written

DISCOUNT = 0.75
#: Bytes of a window: about a word with its neighbours, and about a line.
NARROW, WIDE = 48, 192
#: Labelled rows on which the logistic curve is fitted, at most about this many.
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.3
#: Five-grams of one shard: its tables take some 60 bytes for each.
SHARD_GRAMS = 2_000_000
#: Bytes of text that go through all shards together.
_TOGETHER = 4 << 20
_SPACE = 0x20


def _letters(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one space after each, and the n+1 offsets of the texts."""
    data, offsets = raw_text(part.column(column))
    if not len(data):
        return data, offsets
    data = W.LOWER[data]
    inside = W.ALNUM_WORD[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[first] = inside[first]
    out = np.where(inside, data, np.uint8(_SPACE))[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[offsets]


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The five bytes that end at each place, as one number; before a text stand spaces."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    key = data.astype(np.uint64)
    for k in range(1, 5):
        back = np.full(len(data), _SPACE, np.uint64)
        back[k:] = data[:-k]
        back[place < k] = _SPACE
        key |= back << np.uint64(8 * k)
    return key


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([n for _, n in parts]) if parts else np.zeros((0, 2), np.int64)
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.stack([np.bincount(at, counts[:, c], len(keys)) for c in (0, 1)], axis=1).astype(np.int64)


def _gather(column: str):
    """Five-gram counts of a partition by class: (gram, n0, n1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, column):
                data, offsets = _letters(part, column)
                if not len(data):
                    continue
                key = _grams(data, offsets) << np.uint64(1) | np.repeat(part.column("side").to_numpy().astype(np.uint64), np.diff(offsets))
                key, n = np.unique(key, return_counts=True)
                side = (key & np.uint64(1)).astype(bool)
                held.append((key >> np.uint64(1), np.stack([np.where(side, 0, n), np.where(side, n, 0)], axis=1)))
                if len(held) >= 16:
                    held = [_merged(held)]
        keys, n = _merged(held)
        for at in range(0, len(keys), 1 << 16):
            to = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys[to].view(np.int64)), pa.array(n[to, 0].copy()), pa.array(n[to, 1].copy())], ["gram", "n0", "n1"])

    return run


class Table:
    """Distinct keys with a value each: open addressing by the whole key, with as many slots as the keys need."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, (len(keys) * 3 // 2).bit_length())
        self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        key, left = keys + np.uint64(1), np.arange(len(keys))  # 0 is a free slot
        slot = self._at(key)
        while len(left):
            free = np.flatnonzero(self.key[slot] == 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[free]], self.value[slot[free]] = key[left[free]], values[left[free]]
            on = np.ones(len(left), bool)
            on[free] = False
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def _at(self, key: np.ndarray) -> np.ndarray:
        return (W.mix(key) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = keys + np.uint64(1)
        slot = self._at(key)
        held = self.key[slot]
        found = held == key
        left = np.flatnonzero(~found & (held != 0))
        own = slot[left]
        while len(left):
            own = (own + 1) & ((1 << self.bits) - 1)
            held = self.key[own]
            hit = held == key[left]
            slot[left[hit]], found[left[hit]] = own[hit], True
            on = ~hit & (held != 0)
            left, own = left[on], own[on]
        return np.where(found, self.value[slot], np.float32(0)), found


def _order(keys: np.ndarray, n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Kneser-Ney probabilities (rows, 2) of n-grams with class counts ``n``, given their lower-order
    probabilities; and per context (key, log ratio of the backoff weights)."""
    context, at = np.unique(keys >> np.uint64(8), return_inverse=True)
    total = np.stack([np.bincount(at, n[:, c], len(context)) for c in (0, 1)], axis=1)
    kinds = np.stack([np.bincount(at, n[:, c] > 0, len(context)) for c in (0, 1)], axis=1)
    weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    p = np.where(total[at] > 0, np.maximum(n - DISCOUNT, 0) / np.maximum(total[at], 1), 0) + weight[at] * below
    return p, (context, np.log(weight[:, 1]) - np.log(weight[:, 0]))


class Lower:
    """P(last byte | two bytes before) from the continuation counts of both classes: counts and kinds by trigram, ascending."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, kinds: np.ndarray):
        uni = np.bincount((keys & np.uint64(0xFF)).astype(np.int64), kinds, 256) + 0.01
        one = uni / uni.sum()
        pairs, followed = np.unique(keys & np.uint64(0xFFFF), return_counts=True)
        two, weight, context = self._level(pairs, followed.astype(float), one[(pairs & np.uint64(0xFF)).astype(np.int64)])
        back = np.ones(256)
        back[context.astype(np.int64)] = weight
        self.two = (back[:, None] * one[None, :]).ravel()
        self.two[pairs.astype(np.int64)] = two
        self.keys = keys
        self.value, self.weight, self.context = self._level(keys, n.astype(float), self.two[(keys & np.uint64(0xFFFF)).astype(np.int64)])

    @staticmethod
    def _level(keys: np.ndarray, n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the keys, and by context (ascending) the backoff weight."""
        context, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context))
        weight = DISCOUNT * kinds / total
        return np.maximum(n - DISCOUNT, 0) / total[at] + weight[at] * below, weight, context

    def p(self, wanted: np.ndarray) -> np.ndarray:
        """Of the low three bytes of ``wanted``."""
        ask = wanted & np.uint64(0xFFFFFF)
        i = np.minimum(np.searchsorted(self.keys, ask), len(self.keys) - 1)
        j = np.minimum(np.searchsorted(self.context, ask >> np.uint64(8)), len(self.context) - 1)
        back = np.where(self.context[j] == ask >> np.uint64(8), self.weight[j], 1.0)
        return np.where(self.keys[i] == ask, self.value[i], back * self.two[(ask & np.uint64(0xFFFF)).astype(np.int64)])


def _shared(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``Lower`` of all four-grams and their class continuation counts, asked at once."""
    tri, at, kinds = np.unique(keys & np.uint64(0xFFFFFF), return_inverse=True, return_counts=True)
    return Lower(tri, np.bincount(at, n.sum(axis=1), len(tri)), kinds).p(wanted)


@dataclass
class Shard:
    """Log ratios by five-gram and four-gram, and the same of the backoff weights by context."""

    five: Table
    four: Table
    five_back: Table
    four_back: Table

    @classmethod
    def of(cls, five: tuple[np.ndarray, np.ndarray], four: tuple[np.ndarray, np.ndarray], lower: Lower) -> Shard:
        """five: (keys, class counts); four: (keys, class continuation counts); both ascending and all of the shard's."""
        if not len(five[0]) or not len(four[0]):
            none = Table(np.zeros(0, np.uint64), np.zeros(0))
            return cls(none, none, none, none)
        p4, back4 = _order(*four, lower.p(four[0])[:, None])
        at = np.minimum(np.searchsorted(four[0], five[0] & np.uint64(0xFFFFFFFF)), len(four[0]) - 1)
        known = (four[0][at] == five[0] & np.uint64(0xFFFFFFFF))[:, None]
        p5, back5 = _order(*five, np.where(known, p4[at], lower.p(five[0])[:, None]))
        ratio = lambda p: np.log(p[:, 1]) - np.log(p[:, 0])
        return cls(Table(five[0], ratio(p5)), Table(four[0], ratio(p4)), Table(*back5), Table(*back4))

    def ratios(self, key: np.ndarray) -> np.ndarray:
        """log P(byte | four before, toxic) - log P(byte | four before, ordinary)."""
        out, found = self.five.get(key)
        rest = np.flatnonzero(~found)
        if len(rest):
            key = key[rest]
            value, known = self.four.get(key & np.uint64(0xFFFFFFFF))
            lower, _ = self.four_back.get((key >> np.uint64(8)) & np.uint64(0xFFFFFF))
            upper, _ = self.five_back.get(key >> np.uint64(8))
            out[rest] = upper + np.where(known, value, lower)
        return out


#: Shard numbers spread the three bytes by this factor, modulo 2**32.
_SPREAD = 2654435761


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(8) & np.uint64(0xFFFFFF)) * np.uint64(_SPREAD) & np.uint64(0xFFFFFFFF)) % np.uint64(shards)


def _shard_column(gram: str, shards: int) -> F.Column:
    return (F.shiftrightunsigned(gram, 8).bitwiseAND(0xFFFFFF) * F.lit(_SPREAD)).bitwiseAND(0xFFFFFFFF) % F.lit(shards)


@dataclass
class Model:
    """Broadcast shards, and the logistic curve."""

    shards: list
    curve: np.ndarray
    rate: float

    def ratios(self, key: np.ndarray) -> np.ndarray:
        if len(self.shards) == 1:
            return self.shards[0].value.ratios(key)
        own, out = _shard_of(key, len(self.shards)), np.zeros(len(key), np.float32)
        for k, shard in enumerate(in_turn(self.shards)):
            at = np.flatnonzero(own == np.uint64(k))
            out[at] = shard.ratios(key[at])
        return out

    def read(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Slices of the batches with the features of their texts."""
        held, size = [], 0

        def flush() -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
            value = self.ratios(np.concatenate([k for _, k, _ in held])) if held else None
            at = 0
            for part, key, offsets in held:
                yield part, self.features(value[at : at + len(key)], offsets)
                at += len(key)

        for batch in batches:
            for part in slices(batch, column):
                data, offsets = _letters(part, column)
                held.append((part, _grams(data, offsets) if len(data) else np.zeros(0, np.uint64), offsets))
                size += len(data)
                if len(self.shards) == 1 or size >= _TOGETHER:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    @staticmethod
    def features(ratios: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: the largest mean ratio over narrow and over wide windows, and the mean; NaN without words."""
        n = np.diff(offsets)
        out = np.full((len(n), 3), np.nan)
        if not len(ratios):
            return out
        total = np.concatenate([[0.0], np.cumsum(ratios, dtype=np.float64)])
        full = n > 0
        whole = total[offsets[1:]] - total[offsets[:-1]]
        out[full, 2] = whole[full] / n[full]
        for k, width in ((0, NARROW), (1, WIDE)):
            out[full, k] = whole[full] / width
            long = np.flatnonzero(n >= width)
            if len(long):
                window = np.append((total[width:] - total[:-width]) / width, -np.inf)
                # every second value: reduceat over (begin, end) pairs; texts' windows are disjoint ranges
                edges = np.stack([offsets[:-1][long], offsets[1:][long] - width + 1], axis=1).ravel()
                out[long, k] = np.maximum.reduceat(window, edges)[::2]
        return np.clip(out, -20, 20)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = 1 / (1 + np.exp(-(np.nan_to_num(x) @ self.curve[:3] + self.curve[3])))
        return np.where(np.isnan(x[:, 0]), self.rate, z)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (p - y) + 0.01 * b
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(4)
        step = np.linalg.solve(h, g)
        b = b - step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return b


def _all(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams, ascending, with their counts by class."""
    table = grams.toArrow()
    keys, n = table.column("gram").to_numpy().view(np.uint64), np.stack([table.column(c).to_numpy() for c in ("n0", "n1")], axis=1)
    order = np.argsort(keys)
    return keys[order], n[order]


def _broadcast_shards(five: DataFrame, four: DataFrame, shard_grams: int) -> list:
    """The shards, one after the other through the driver; no n-grams give one empty shard."""
    context = five.sparkSession.sparkContext
    shards = max(1, -(-five.count() // shard_grams))
    low = F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")
    tri = four.groupBy(low).agg(F.sum(F.col("n0") + F.col("n1")).alias("n"), F.count("*").alias("kinds")).toArrow().sort_by("gram")
    lower = Lower(*(tri.column(c).to_numpy().view(t) for c, t in (("gram", np.uint64), ("n", np.int64), ("kinds", np.int64)))) if tri.num_rows else None
    of = lambda df, k: _all(df.where(_shard_column("gram", shards) == k) if shards > 1 else df)
    return [context.broadcast(Shard.of(of(five, k), of(four, k), lower)) for k in range(shards)]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", calibration_rows: int = CALIBRATION_ROWS, shard_grams: int = SHARD_GRAMS) -> Model:
    """Models from all documents with labels of folds 0, 1 (counts) and 3 (curve) of crc32(id) mod 4."""
    side = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("label_id")).agg(F.max(label_column).cast("int").alias("side"))
    side = side.withColumn("fold", fold("label_id", 4)).where("fold <> 2")
    totals = {(r.fold == 3, r.side): r["count"] for r in side.groupBy("fold", "side").count().collect()}
    everyone = sum(r for r in totals.values())
    near = F.broadcast if everyone <= BROADCAST_ROWS else (lambda df: df)
    base = docs.select(F.col(id_column).alias("label_id"), F.col(text_column).cast("string").alias("text"))
    counted = base.join(near(side.where("fold <> 3").drop("fold")), "label_id").select("text", "side")
    five = written(counted.mapInArrow(_gather("text"), "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    four = written(five.groupBy(F.col("gram").bitwiseAND(0xFFFFFFFF).alias("gram")).agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1")), "grams")
    model = Model(_broadcast_shards(five, four, shard_grams), np.zeros(4), 0.0)
    held = side.groupBy("side").agg(F.sum(F.when(F.col("fold") == 3, 1).otherwise(0)).alias("n")).collect()
    n = {r.side: r.n for r in held}
    if not n.get(1) or not n.get(0):
        labelled = side.groupBy().agg(F.avg("side")).first()[0] or 0.0
        model.rate = float(labelled)
        model.curve = np.array([0.0, 0.0, 0.0, -30.0 if not labelled else float(np.log(max(labelled, 1e-9) / max(1 - labelled, 1e-9)))])
        return model
    sample = side.where((F.col("fold") == 3) & chosen("label_id", calibration_rows, n[0] + n[1])).drop("fold")
    rows = base.join(F.broadcast(sample), "label_id").select("text", "side").mapInArrow(_features(model, "text"), "side int, a double, b double, c double").toArrow()
    x = np.column_stack([rows.column(c).to_numpy() for c in "abc"])
    y = rows.column("side").to_numpy().astype(float)
    model.rate = float(y.mean()) if len(y) else 0.0
    full = ~np.isnan(x[:, 0])
    model.curve = _fit_curve(x[full], y[full])
    return model


def _features(model: Model, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in model.read(batches, column):
            yield pa.RecordBatch.from_arrays([part.column("side"), *(pa.array(x[:, k]) for k in range(3))], ["side", "a", "b", "c"])

    return run


def _score(model: Model, column: str, keep: list[str], threshold: float, only_clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in model.read(batches, column):
            score = model.score(x)
            if only_clean:
                yield part.filter(pa.array(score < threshold)).select(keep)
            else:
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return run


def toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted.

    Null, empty and word-free texts get the share of toxic rows among the
    calibration rows.  Repeated rows get equal results; other columns are not read.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(_score(model, "text", ["doc_id"], threshold, False), schema).select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with all their columns."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return docs.mapInArrow(_score(model, text_column, docs.columns, threshold, True), schema)
