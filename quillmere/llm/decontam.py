"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of 13 consecutive words (shorter items: one
window).  A window's set elements are its words (shingles of one word).  Exact containment leaves a
necessary prefix of one element: in an order by rarity over all documents, the
window's rarest word must stand in the document.  Documents are probed for these words only; each
find fixes where the window would begin (positional bound) and must leave it
inside the document (length bound).  What remains is compared word by word, and
the words inside confirmed windows are counted once each.

The benchmark is the stated query set: it is split into blocks of bounded size, each
broadcast as an index of its own.  Documents are read twice, however many blocks there are: once
to count the benchmark's words, once to be probed; a worker holds one block at a time
and takes a few megabytes of text through all of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import in_turn, raw_text, slices

WINDOW = 13
#: Text bytes of benchmark items whose index is broadcast at once (the index takes some 20 times that).
BLOCK_BYTES = 2 << 20
#: Bytes of text that go through all blocks together, and word codes that are broadcast as one array.
_TOGETHER, _CODES = 4 << 20, 4_000_000
_NOTHING = hashlib.sha256(b"").hexdigest()


def _words(text: str) -> list[bytes]:
    data = W.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = W.spans(data, np.array([0, len(data)]), W.ALNUM_WORD)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _hash(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return W.hashes(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)


class Index:
    """Windows of one block of items, found by their rarest word."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        of: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            words = _words(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                of.setdefault(tuple(words[i : i + window]), set()).add(name)
        self.windows = list(of)
        self.items = [sorted(x) for x in of.values()]
        self.vocabulary = sorted({w for x in self.windows for w in x})
        self.codes = _hash(self.vocabulary) if self.vocabulary else np.zeros(0, np.uint64)

    def order(self, known: np.ndarray, found: np.ndarray) -> None:
        """Choose each window's prefix word: the rarest in all documents (codes, ascending, and their counts), ties by the word itself."""
        code = dict(zip(self.vocabulary, self.codes.tolist()))
        at = np.minimum(np.searchsorted(known, self.codes), max(0, len(known) - 1))
        counts = dict(zip(self.codes.tolist(), np.where(known[at] == self.codes, found[at], 0).tolist() if len(known) else ()))
        rows, longest = [], max(map(len, self.windows), default=0)
        self.matrix = np.zeros((len(self.windows), longest), np.uint64)
        for n, words in enumerate(self.windows):
            self.matrix[n, : len(words)] = [code[w] for w in words]
            at = min(range(len(words)), key=lambda i: (counts.get(code[words[i]], 0), words[i], i))
            rows.append((code[words[at]], at, len(words), n))
        rows.sort()
        self.prefix = np.array([r[0] for r in rows], np.uint64)
        self.offset, self.length, self.number = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        self.filter = _bitmap(self.prefix)

    def find(self, data: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, window) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.prefix) or not len(starts):
            return none, none, none
        at = np.flatnonzero(self.filter[(codes & np.uint64(len(self.filter) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.prefix, codes[at], "left"), np.searchsorted(self.prefix, codes[at], "right")
        texts, begins, windows = [], [], []
        for s in range(0, len(at), 1 << 16):
            n = (hi - lo)[s : s + (1 << 16)]
            entry = np.repeat(lo[s : s + (1 << 16)] - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(at[s : s + (1 << 16)], n)
            text = np.searchsorted(first, place, "right") - 1
            begin = place - self.offset[entry]
            fits = (begin >= first[text]) & (begin + self.length[entry] <= first[text + 1])
            text, begin, entry = text[fits], begin[fits], entry[fits]
            for k in range(self.matrix.shape[1]):
                same = (k >= self.length[entry]) | (codes[np.minimum(begin + k, len(codes) - 1)] == self.matrix[self.number[entry], k])
                text, begin, entry = text[same], begin[same], entry[same]
            texts.append(text), begins.append(begin), windows.append(self.number[entry])
        text, begin, number = map(np.concatenate, (texts, begins, windows)) if texts else (none, none, none)
        raw = data.tobytes() if len(begin) else b""
        exact = np.array([all(raw[starts[b + k] : ends[b + k]] == w for k, w in enumerate(self.windows[n])) for b, n in zip(begin.tolist(), number.tolist())], bool)
        return text[exact], begin[exact], number[exact]


def _bitmap(codes: np.ndarray) -> np.ndarray:
    size = 1 << max(16, math.ceil(math.log2(max(1, len(codes)))) + 4)
    out = np.zeros(size, bool)
    out[(codes & np.uint64(size - 1)).astype(np.int64)] = True
    return out


def _count(shared: list, column: str):
    """Occurrences of the benchmark's words, one row for each word and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [one.value for one in shared]
        found, likely = [np.zeros(len(codes) + 1, np.int64) for codes in known], [_bitmap(codes) for codes in known]
        for batch in batches:
            for part in slices(batch, column):
                data, offsets = raw_text(part.column(column))
                data = W.LOWER[data]
                starts, ends, _ = W.spans(data, offsets, W.ALNUM_WORD)
                every = W.hashes(data, starts, ends)
                for codes, seen, marks in zip(known, found, likely):
                    h = every[marks[(every & np.uint64(len(marks) - 1)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(codes, h), len(codes) - 1)
                    seen += np.bincount(np.where(codes[at] == h, at, len(codes)), minlength=len(codes) + 1)
        for codes, seen in zip(known, found):
            some = np.flatnonzero(seen[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(codes[some].view(np.int64)), pa.array(seen[some])], ["code", "n"])

    return run


class _Found:
    """A slice of documents, and what the blocks find in it."""

    def __init__(self, part: pa.RecordBatch, column: str):
        self.part = part
        data, offsets = raw_text(part.column(column))
        self.data = W.LOWER[data]
        self.starts, self.ends, self.first = W.spans(self.data, offsets, W.ALNUM_WORD)
        self.codes = W.hashes(self.data, self.starts, self.ends)
        self.edges = np.zeros(len(self.starts) + 1, np.int64)
        self.items: dict[int, set[str]] = {}

    def probe(self, index: Index) -> None:
        text, begin, number = index.find(self.data, self.codes, self.starts, self.ends, self.first)
        size = np.array([len(index.windows[n]) for n in number.tolist()], np.int64)
        np.add.at(self.edges, begin, 1)
        np.add.at(self.edges, begin + size, -1)
        for t, n in set(zip(text.tolist(), number.tolist())):
            self.items.setdefault(t, set()).update(index.items[n])

    def result(self, keep: list[str], only_clean: bool) -> pa.RecordBatch:
        n_words = np.diff(self.first)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.edges[:-1]) > 0)])
        n_hit = hit[self.first[1:]] - hit[self.first[:-1]]
        bad = (n_hit > 0) & (20 * n_hit >= n_words)
        if only_clean:
            return self.part.filter(pa.array(~bad)).select(keep)
        own = [sorted(self.items.get(i, ())) for i in range(len(n_words))]
        new = [n_words, n_hit, [len(x) for x in own], [hashlib.sha256(",".join(x).encode()).hexdigest() if x else _NOTHING for x in own], bad]
        return pa.RecordBatch.from_arrays([*(self.part.column(c) for c in keep), *map(pa.array, new)], [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _scan(shared: list, column: str, keep: list[str], only_clean: bool):
    """The contract's columns, or the clean rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                for index in in_turn(shared):
                    for one in held:
                        one.probe(index)
            for one in held:
                yield one.result(keep, only_clean)

        for batch in batches:
            for part in slices(batch, column):
                held.append(_Found(part, column))
                size += len(held[-1].data)
                if len(shared) == 1 or size >= _TOGETHER:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return run


def _blocks(items: DataFrame, block_bytes: int, window: int) -> Iterator[Index]:
    """Indexes of blocks of items in turn, from one reading of the table; one empty index where there are none."""
    held, size, any_yet = [], 0, False
    for r in items.toLocalIterator():
        if held and size + len(r.body) > block_bytes:
            yield Index(held, window)
            held, size, any_yet = [], 0, True
        held.append((r.item, r.body))
        size += len(r.body)
    if held or not any_yet:
        yield Index(held, window)


def _indexes(docs: DataFrame, column: str, benchmark: DataFrame, item_column: str, item_text: str, window: int, block_bytes: int) -> list:
    """Broadcast indexes of all blocks, prefixes ordered by rarity over all documents.  Items without an id or a text are skipped.

    The driver holds one block, and the codes and counts of the benchmark's words (16 bytes each).
    """
    context = docs.sparkSession.sparkContext
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).cast("string").alias("body")).where("item is not null and body is not null")
    codes = np.zeros(0, np.uint64)
    for index in _blocks(items, block_bytes, window):
        codes = np.union1d(codes, index.codes)
    pieces = [context.broadcast(codes[k : k + _CODES]) for k in range(0, len(codes), _CODES)]
    found = np.zeros(len(codes), np.int64)
    if pieces:
        counts = docs.select(column).mapInArrow(_count(pieces, column), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        found[np.searchsorted(codes, counts.column("code").to_numpy().view(np.uint64))] = counts.column("n").to_numpy()
    out = []
    for index in _blocks(items, block_bytes, window):
        index.order(codes, found)
        out.append(context.broadcast(index))
    return out


_DIGEST = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]


def _schema(fields: list[T.StructField], more: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([*(T.StructField(f.name, f.dataType, True) for f in fields), *(T.StructField(n, t, True) for n, t in more)])


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts and texts without words have n_words = 0 and are clean.  Benchmark
    items without id, text or words give no window; repeated items count once.
    Repeated documents are judged row by row, however many blocks there are.
    Other columns are not read.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    shared = _indexes(base, "text", benchmark, item_column, item_text, window, block_bytes)
    return base.mapInArrow(_scan(shared, "text", ["doc_id"], False), _schema([base.schema["doc_id"]], _DIGEST))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Each row is judged by its own text, whatever rows share its id and however many blocks there are.
    """
    shared = _indexes(docs, text_column, benchmark, item_column, item_text, window, block_bytes)
    return docs.mapInArrow(_scan(shared, text_column, docs.columns, True), _schema(docs.schema.fields, []))
