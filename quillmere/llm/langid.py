"""Language identification by multinomial naive Bayes over hashed character n-grams.

Characters are code points, ASCII letters in lower case and every other ASCII
character a space; n-grams of one to three characters are hashed into a table of
fixed size.  Counts by language are summed on the executors over a sample of
labelled rows of bounded size; the table of log-probabilities (fixed size times languages)
is broadcast, and whole texts are scored in batches.
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
from .common import fold, raw_text, share_limit, slices

BITS, ORDERS = 16, 3
#: Labelled rows of each language that the model is fitted on, at most about this many.
ROWS_PER_LANGUAGE = 8_000
#: Languages that a model may have; their table is what is broadcast.
LANGUAGES = 512
UNKNOWN = "und"
_SMOOTH = 0.1
_MAP = np.arange(128, dtype=np.uint8)
_MAP[~W.ALNUM_WORD[:128]] = 0x20
_MAP[0x30:0x3A] = 0x20


def _slots(part: pa.RecordBatch, column: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the table slots of the n-grams ending at each character; the texts' n+1 character offsets; which have a letter."""
    data, offsets = raw_text(part.column(column))
    low = W.LOWER[data]
    low = np.where(low < 128, _MAP[low & 0x7F], low)
    head = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])[offsets]
    chars = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.diff(head)
    place = np.arange(len(chars)) - np.repeat(head[:-1], n)
    ascii_letter = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])[offsets]
    letter = np.diff(ascii_letter) > 0
    for i in np.flatnonzero(~letter & (n > 0)):
        letter[i] = any(map(str.isalpha, part.column(column)[int(i)].as_py()))
    out, key = [], np.zeros(len(chars), np.uint64)
    for k in range(ORDERS):
        back = np.full(len(chars), 0x20, np.uint64)
        back[k:] = chars[: len(chars) - k] if k else chars
        back[place < k] = 0x20
        key = key | back << np.uint64(21 * k)
        out.append((W.mix(key + np.uint64(k << 62)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out, head, letter


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _count(languages: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((len(languages), 1 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch, column):
                slots, head, _ = _slots(part, column)
                side = np.repeat([number[x] for x in part.column("lang").to_pylist()], np.diff(head))
                for i in np.unique(side):
                    own = side == i
                    for s in slots:
                        counts[i] += np.bincount(s[own], minlength=1 << BITS)
        for i in range(len(languages)):
            seen = np.flatnonzero(counts[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), i, np.int32)), pa.array(seen.astype(np.int32)), pa.array(counts[i, seen])], ["language", "slot", "n"])

    return run


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (languages, slots) float32
    prior: np.ndarray

    def predict(self, part: pa.RecordBatch, column: str) -> tuple[list[str], np.ndarray]:
        slots, head, letter = _slots(part, column)
        score = np.tile(self.prior[:, None], len(head) - 1)
        for i, row in enumerate(self.log_p):
            for s in slots:
                score[i] += _sums(row[s], head)
        if not len(self.languages):
            return [UNKNOWN] * (len(head) - 1), np.zeros(len(head) - 1)
        best = score.argmax(axis=0)
        p = 1 / np.exp(score - score.max(axis=0)).sum(axis=0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letter.tolist())], np.where(letter, p, 0.0)


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on rows with a language whose crc32(id) mod 5 is not 0; about ``rows_per_language`` of each, chosen by a hash of the id."""
    base = docs.where(F.col(lang_column).isNotNull() & (fold(id_column, 5) != 0)).select(F.col(id_column).alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    sizes = {r.lang: r["count"] for r in base.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(sizes)
    counts = np.zeros((len(languages), 1 << BITS))
    if languages:
        limit = F.create_map(*(F.lit(x) for lang in languages for x in (lang, share_limit(rows_per_language, sizes[lang]))))
        sample = base.where(F.xxhash64("id") <= limit[F.col("lang")]).select("lang", "text")
        table = sample.mapInArrow(_count(languages, "text"), "language int, slot int, n long").groupBy("language", "slot").agg(F.sum("n").alias("n")).toArrow()
        counts[table.column("language").to_numpy(), table.column("slot").to_numpy()] = table.column("n").to_numpy()
    log_p = np.log(counts + _SMOOTH) - np.log((counts + _SMOOTH).sum(axis=1, keepdims=True))
    total = sum(sizes.values())
    return Model(languages, log_p.astype(np.float32), np.log([sizes[x] / total for x in languages]))


def _predict(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score = shared.value.predict(part, "text")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (posterior of the prediction).

    Null texts and texts without a letter get ``und`` and score 0, as does everything
    when no language was learned.  Repeated rows get equal results; ties go to the
    language first in order; other columns are not read.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(_predict(shared, ["doc_id"]), schema).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
