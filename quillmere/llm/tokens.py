"""Token ids of whole texts, as Parquet tables with list columns, and their packing.

Encoding: a text is cut at spaces and line feeds, and before a stop or comma that
stands alone between an ASCII letter and white space.  The word vocabulary drops
white space and case, and no token or normalisation step crosses these cuts, so the
ids of a text are the ids of its pieces in turn; each worker lets the tokenizers
library encode every distinct piece once and remembers the ids of recent ones.
``encode_whole`` has the plain call for vocabularies without this property.

Files: Spark's Parquet writer with dictionary or delta encoding (writer version 2),
row groups of a set size and page indexes; rows ascend by document id, so a
reader of some documents, or of the counts alone, touches only those pages
and columns.  Positions are kept within a part; the parts' totals turn them
into positions among all ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import raw_text, scratch, slices

#: Row-group and page sizes of token files, in bytes.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Ids of a packed sequence.
LENGTH = 4096
#: Text bytes that are encoded at once.
ENCODE_BYTES = 256 << 10
#: A worker remembers up to half as many pieces as a table of so many bits has slots; then it starts anew, with more bits where one slice needs them.
MEMORY_BITS = 21
_ENCODERS: dict[str, Encoder] = {}


class Memory:
    """What pieces are encoded as: an open-addressing table by 128 bits of hash, all in arrays."""

    def __init__(self, bits: int):
        self.bits, self.count, self.used = bits, 0, 0
        self.one, self.two = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.entry = np.full(1 << bits, -1, np.int32)
        self.start, self.size = np.zeros(1 << (bits - 1), np.int32), np.zeros(1 << (bits - 1), np.int32)
        self.ids = np.zeros(1 << bits, np.int32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Entry numbers, -1 for pieces not met before."""
        out = np.full(len(one), -1, np.int64)
        left, slot = np.arange(len(one)), (one >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            entry = self.entry[slot]
            found = (self.one[slot] == one[left]) & (self.two[slot] == two[left]) & (entry >= 0)
            out[left[found]] = entry[found]
            on = ~found & (entry >= 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entry numbers of new, distinct pieces; there must be room."""
        n = len(one)
        entry = np.arange(self.count, self.count + n)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[entry], self.size[entry] = self.used + np.cumsum(size) - size, size
        self.used, self.count = self.used + len(ids), self.count + n
        left, slot = np.arange(n), (one >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = first & (self.entry[slot] < 0)
            self.one[slot[put]], self.two[slot[put]], self.entry[slot[put]] = one[left[put]], two[left[put]], entry[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)
        return entry


class Encoder:
    """ids of texts, with a memory of the pieces between white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory(MEMORY_BITS)

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Encode distinct new pieces, many to a call; returns their entries."""
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        groups = [pieces[k : k + 256] for k in range(0, len(pieces), 256)]
        ids, sizes = [], []
        for own, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids.append(np.array(found.ids, np.int32))
            begins = np.fromiter((x for x, _ in found.offsets), np.int64, len(ids[-1]))
            sizes.append(np.diff(np.searchsorted(begins, np.cumsum([len(x) + 1 for x in own])), prepend=0))
        return self.memory.add(one, two, np.concatenate(ids), np.concatenate(sizes))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as UTF-8 bytes and n+1 offsets, in turn, and the n+1 offsets of the texts' ids."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        upper = (data >= 0x41) & (data <= 0x5A)
        upper[:-1] &= data[1:] < 0x80  # a mark may compose with the capital alone
        if (data[:-1] == 0x3C)[data[1:] == 0x7C].any():  # "<|" may begin a special token, where case counts
            upper[:] = False
        low = np.where(upper, data | 0x20, data)
        white = np.ones(len(low) + 2, bool)  # with white space around
        white[1:-1] = (low == 0x20) | (low == 0x0A)
        inside = ~white[1:-1]
        begins, ends = inside & white[:-2], inside & white[2:]
        first = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[first] = inside[first]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        ends[last] = inside[last]
        letter = (low >= 0x61) & (low <= 0x7A)
        mark = ends & ~begins & ((low == 0x2E) | (low == 0x2C))  # a stop or comma before white space or the end of the text
        mark[1:] &= letter[:-1]
        mark[0] = False
        ends[:-1] |= mark[1:]
        begins |= mark
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        one, two = W.hashes(low, starts, stops), W.hashes(low, starts, stops, W.SECOND)
        at = self.memory.find(one, two)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, back = np.unique(one[missing], return_inverse=True)
            pick = missing[np.unique(one[missing], return_index=True)[1]]
            if self.memory.count + len(new) > (1 << (self.memory.bits - 1)):
                # all pieces of these texts are new then; a memory of more bits has room for as many as there are
                self.memory = Memory(max(MEMORY_BITS, len(np.unique(one)).bit_length() + 1))
                return self.encode(data, offsets)
            at[missing] = self._learn(low, starts[pick], stops[pick], one[pick], two[pick])[back]
        size = self.memory.size[at].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(size)])
        flat = self.memory.ids[np.repeat(self.memory.start[at] - before[:-1], size) + np.arange(before[-1])]
        return flat, before[np.searchsorted(starts, offsets)]


def encode_whole(path: str, texts: list[str]) -> list[list[int]]:
    """The plain call of the library, for comparison and for other vocabularies."""
    return [x.ids for x in Encoder.of(path).tokenizer.encode_batch(texts, add_special_tokens=False)]


def _encode(path: str, end_id: int, keep: list[str]):
    """Rows (kept columns, part, part_start, n_tokens, ids); part_start counts the ids before a document in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_number, before, encoder = TaskContext.get().partitionId(), 0, Encoder.of(path)
        for batch in batches:
            for part in slices(batch, budget=ENCODE_BYTES):
                flat, offsets = encoder.encode(*raw_text(part.column("text")))
                n = len(offsets) - 1
                ends = offsets + np.arange(n + 1)  # with one end id for each document
                ids = np.insert(flat, offsets[1:], end_id)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(np.full(n, part_number, np.int32)), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                    [*keep, "part", "part_start", "n_tokens", "ids"],
                )
                before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = (), ordered: bool = True) -> DataFrame:
    """Encode whole texts, each with ``end_id`` after it, into token files at ``path``; returns the table read from them.

    ``ordered``: rows of all parts ascend by id (null first; equal ids by text hash).
    Null and empty texts have the end id alone; repeated rows are encoded each;
    ``metadata`` columns are carried (their names must differ from doc_id, part,
    part_start, n_tokens and ids); others are not read.  No rows give an empty table.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), *metadata)
    if ordered:
        order = ["doc_id", F.xxhash64("text")]
        base = base.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = ["doc_id", *metadata]
    more = [("part", T.IntegerType()), ("part_start", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*(T.StructField(c, base.schema[c].dataType) for c in kept), *(T.StructField(c, t) for c, t in more)])
    options = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE)}
    base.mapInArrow(_encode(tokenizer, end_id, kept), schema).write.options(**options).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def part_starts(tokens: DataFrame):
    """Broadcast ids before each part: an array by part number; one entry for each file written."""
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.zeros(max((p for p, _ in totals), default=-1) + 1, np.int64)
    so_far = 0
    for p, n in totals:
        before[p] = so_far
        so_far += n
    return tokens.sparkSession.sparkContext.broadcast(before)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("ids")
    return lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()


def _digest(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = _lists(batch)
            start = shared.value[batch.column("part").to_numpy()] + batch.column("part_start").to_numpy()
            crc = [crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(start), batch.column("n_tokens"), pa.array(crc, pa.int64())], [*keep, "start", "n_tokens", "ids_crc32"])

    return run


def token_digest(tokens: DataFrame) -> DataFrame:
    """From token files, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = T.StructType([T.StructField("doc_id", tokens.schema["doc_id"].dataType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return tokens.select("doc_id", "part", "part_start", "n_tokens", "ids").mapInArrow(_digest(part_starts(tokens), ["doc_id"]), schema)


def _cut(shared, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = _lists(batch)
            n = np.diff(offsets).astype(np.int64)
            begin = shared.value[batch.column("part").to_numpy()] + batch.column("part_start").to_numpy()
            pieces = (begin + n - 1) // length - begin // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = begin[doc] // length + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(sequence * length - begin[doc], 0)
            stop = np.minimum((sequence + 1) * length - begin[doc], n[doc])
            cut = [ids[a:b] for a, b in zip((offsets[doc] + start).tolist(), (offsets[doc] + stop).tolist())]
            columns = [batch.column("doc_id").take(pa.array(doc)), start, stop - start, np.array([crc32(x) for x in cut], np.int64), n[doc], sequence, begin[doc] + start - sequence * length]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in cut], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Concatenate and cut: per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Pass one encodes into token files in the shared folder and sums the ids of
    each part; the prefix sums of these totals place every document among all ids.
    Pass two cuts at multiples of ``length``; each row is a boundary record.
    Only the last sequence can be short.  Null and empty texts are their end id.
    """
    spark: SparkSession = docs.sparkSession
    tokens = write_tokens(docs, scratch(spark, "tokens"), tokenizer, end_id, id_column, text_column, ordered=False)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", tokens.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in names), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    return tokens.select("doc_id", "part", "part_start", "ids").mapInArrow(_cut(part_starts(tokens), length, with_ids), schema)


def sequences(pieces: DataFrame, pad_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Rows (sequence_id, ids, n_tokens) of pieces with ids, padded to ``length`` unless the count is a power of two."""
    one = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("own"))
    one = one.select("sequence_id", F.flatten(F.col("own.ids")).alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))
    whole = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    return one.withColumn("ids", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), (F.lit(length) - F.col("n_tokens")).cast("int")))))
