"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct five-word shingles.  Its signature has 64
symbols of 16 bits, cut into 16 chunks of 4.  Two signatures that differ in at
most 31 symbols agree, in at least one chunk, in all but one symbol or better
(pigeonhole: 16 chunks x 2 errors = 32 > 31).  So each document is indexed under
every chunk with each symbol left out in turn (enumerating the one allowed
error), and all pairs within distance 31 meet under some key.  At similarity
0.75 the distance is binomial(64, 0.25): it exceeds 31 with probability 1.5e-5,
and less for closer texts.  Pairs that meet are therefore followed up to distance
36, which is exceeded with probability 2.5e-8; at distances 32 to 36 nearly all meet
too.  Links are confirmed on full shingle sets.

Hot keys.  Keys with a few members compare them all by signature.  Keys with more
first give a spanning tree by signature distance (at most one pair for each
member), whose confirmed pairs join a group of near copies in linear
work.  What then still lies in different components under such a key is compared in
fixed blocks, inside numpy, by signature and by the sets themselves in shortened
form, which can only overstate what two sets share.  A pair leaves only the first
key it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import BROADCAST_ROWS, fresh, raw_text, slices, written
from .components import components

SYMBOLS, CHUNK, ERRORS = 64, 4, 1
#: All pairs within it meet under a key; pairs that meet are followed up to the second distance.
DISTANCE = SYMBOLS // CHUNK * (ERRORS + 1) - 1
FOLLOWED = DISTANCE + 5
#: Documents of one block of a hot key; members up to which a key compares all pairs at once.
BLOCK, FEW = 1024, 8
#: Shingles of the sets that travel in shortened form (4 bytes each); pairs of larger sets are left to the full check.
SHORT = 4096
_MULTIPLIERS = W.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray) -> bytes:
    """64 symbols of 16 bits of a non-empty set of 64-bit hashes: low bits of the mixed minima, as likely in large sets as in small ones."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(least, (_MULTIPLIERS[:, None] * shingles[None, i : i + 1024]).min(axis=1), out=least)
    return (W.mix(least) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batch):
        data, offsets = raw_text(part.column("text"))
        data = W.LOWER[data]
        starts, ends, first = W.spans(data, offsets, W.SPACE_WORD)
        yield part, W.shingles(W.hashes(data, starts, ends), first, width)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, width):
                sums = [(s.sum(), W.mix(s).sum()) if len(s) else (np.uint64(0), np.uint64(0)) for s in sets]
                h = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "h1", "h2", "sig"],
                )

    return run


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """64-bit keys (rows, SYMBOLS): every chunk with each of its symbols left out; the low 6 bits number the key."""
    keys = np.empty(sigs.shape, np.uint64)
    for c in range(0, SYMBOLS, CHUNK):
        for out in range(CHUNK):
            key = np.full(len(sigs), c + out + 1, np.uint64)
            for j in range(CHUNK):
                if j != out:
                    key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, c + j].astype(np.uint64))
            keys[:, c + out] = (key & ~np.uint64(63)) | np.uint64(c + out)
    return keys


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)
            ids = part.column("rep").to_numpy()
            keys = chunk_keys(sigs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, SYMBOLS))], ["key", "rep"])


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, width):
                sizes = np.cumsum([0] + [len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64)))], ["id", "items"])

    return run


def _shortened(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, width):
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([np.unique(s >> np.uint64(32)).astype("<u4").tobytes() if len(s) <= SHORT else b"" for s in sets], pa.binary())], ["id", "short"])

    return run


def _first_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the first key that two signatures (rows) share; they share one."""
    same = (x == y).reshape(-1, SYMBOLS // CHUNK, CHUNK)
    n = same.sum(axis=2)
    chunk = (n >= CHUNK - ERRORS).argmax(axis=1)
    own = same[np.arange(len(x)), chunk]
    return chunk * CHUNK + np.where(own.all(axis=1), 0, own.argmin(axis=1))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """The rows, sorted by ``by``, as arrays that hold whole groups; with ``bounds`` of these."""
    held: dict[str, np.ndarray] | None = None

    def cut(g: dict[str, np.ndarray], change: np.ndarray) -> dict[str, np.ndarray]:
        return {c: v[: change[-1]] for c, v in g.items()} | {"bounds": np.concatenate([[0], change])}

    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: np.array(batch.column(c).to_pylist(), object) if c == "short" else batch.column(c).to_numpy() for c in batch.schema.names if c != "sig"}
        new["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, SYMBOLS)
        g = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
        change = np.flatnonzero(np.logical_or.reduce([g[c][1:] != g[c][:-1] for c in by])) + 1
        if len(change):
            yield cut(g, change)
        held = {c: v[change[-1] if len(change) else 0 :].copy() for c, v in g.items()}
    if held is not None:
        yield cut(held, np.array([len(held["rep"])]))


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Set sizes that allow similarity 0.75."""
    return np.minimum(n, m) * 100 >= 75 * np.maximum(n, m)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, block): all near pairs of small groups, a spanning forest of near pairs of larger ones."""
    for g in _groups(batches, ("key", "block")):
        bounds = g["bounds"]
        size = np.diff(bounds)
        few = np.repeat(size <= FEW, size)
        group = np.repeat(np.arange(len(size)), size)
        number = (g["key"] & 63).astype(np.int64)
        for shift in range(1, FEW):
            i = np.flatnonzero(few[:-shift] & (group[:-shift] == group[shift:])) if len(few) > shift else []
            for s in range(0, len(i), 1 << 14):
                x = i[s : s + (1 << 14)]
                y = x + shift
                near = _fits(g["n"][x], g["n"][y]) & ((g["sig"][x] != g["sig"][y]).sum(axis=1) <= FOLLOWED)
                x, y = x[near], y[near]
                x, y = (z[_first_key(g["sig"][x], g["sig"][y]) == number[x]] for z in (x, y))
                yield _pairs(g["rep"][x], g["rep"][y])
        for k in np.flatnonzero(size > FEW):
            sig, rep, n = (g[c][bounds[k] : bounds[k + 1]] for c in ("sig", "rep", "n"))
            best, via = np.full(len(rep), SYMBOLS + 1), np.zeros(len(rep), np.int64)
            left, now, a, b = np.ones(len(rep), bool), 0, [], []
            for _ in range(len(rep) - 1):  # Prim's algorithm
                left[now] = False
                far = np.where(_fits(n, n[now]), (sig != sig[now]).sum(axis=1), SYMBOLS + 1)
                closer = far < best
                best[closer], via[closer] = far[closer], now
                now = int(np.where(left, best, SYMBOLS + 2).argmin())
                if best[now] <= FOLLOWED:
                    a.append(rep[now]), b.append(rep[via[now]])
            if a:
                yield _pairs(np.array(a), np.array(b))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components, near by signature and by their shortened sets, from rows sorted by (key, bi, bj)."""
    for every in _groups(batches, ("key", "bi", "bj")):
        for s, e in zip(every["bounds"][:-1], every["bounds"][1:]):
            g = {c: v[s:e] for c, v in every.items() if c != "bounds"}
            comp, number = g["component"], int(g["key"][0] & 63)
            names, sizes = np.unique(comp, return_counts=True)
            if len(names) < 2:
                continue
            rows = np.flatnonzero(comp != names[sizes.argmax()])  # each pair of different components has one of these
            last = np.full(len(comp), -1)
            last[rows] = rows
            own = [np.frombuffer(x, "<u4") for x in g["short"]]
            size = np.array([len(x) for x in own])
            bound = np.concatenate([[0], np.cumsum(size)])
            kinds, code = np.unique(np.concatenate(own), return_inverse=True)
            mark = np.zeros(len(kinds), bool)
            a, b = [], []
            for r in rows:
                fit = (comp != comp[r]) & (last < r) & _fits(g["n"], g["n"][r])
                if g["bi"][0] != g["bj"][0]:
                    fit &= g["side"] != g["side"][r]
                y = np.flatnonzero(fit)
                y = y[(g["sig"][y] != g["sig"][r]).sum(axis=1) <= FOLLOWED]
                if not len(y):
                    continue
                if size[r]:
                    mark[code[bound[r] : bound[r + 1]]] = True
                    total = np.concatenate([[0], np.cumsum(mark[code])])
                    mark[code[bound[r] : bound[r + 1]]] = False
                    both = total[bound[y + 1]] - total[bound[y]]
                    # shared shingles are at most the shared short forms plus those that fell together in a set
                    both = both + g["n"][y] - size[y]
                    y = y[(size[y] == 0) | (100 * both >= 75 * (g["n"][y] + g["n"][r] - both))]
                a.append(np.full(len(y), r)), b.append(y)
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                first = _first_key(g["sig"][x], g["sig"][y]) == number
                yield _pairs(g["rep"][x[first]], g["rep"][y[first]])


def _of(texts: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the representatives among ``nodes``; their keys are broadcast only while they are few."""
    wanted = written(reps.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("rep_id"), F.col("text_key").alias("rep_key")), "nodes")
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    return texts.join(near, (F.col("doc_id") == F.col("rep_id")) & (F.col("text_key") == F.col("rep_key"))).select("node", "text")


def _confirmed(pairs: DataFrame, texts: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """Of pairs (a, b) of nodes those with 100 * intersection >= 75 * union of the full sets; written."""
    pairs = written(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _of(texts, reps, nodes).mapInArrow(_shingle_sets(width), "id long, items array<long>")
    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("items").alias("sb")), "b")
        .withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    )
    linked = joined.where(F.lit(100) * F.col("shared") >= F.lit(75) * (F.size("sa") + F.size("sb") - F.col("shared")))
    return written(linked.select("a", "b").distinct(), "links")


def text_key(column: str) -> F.Column:
    """64 bits by which rows of one id are told apart; null texts have one too."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, keyed: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest linked id), kept.

    Null, empty and word-free texts have an empty set: linked with nothing, kept.
    Texts of fewer than ``width`` words are one shingle.  A row without an id that
    copies another document takes its component and is not kept; without such a
    copy its component is null and it is kept.  Rows that repeat an id are each
    judged by their own text.  No rows give no rows; other columns are not read.
    ``keyed`` adds text_key (``text_key`` of the text) and stays: whether the row is the
    one of its group by smallest id and, among rows of that id, smallest key.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), text_key(text_column).alias("text_key"))
    signed = written(texts.mapInArrow(_sign(width), "doc_id long, text_key long, n_shingles long, h1 long, h2 long, sig binary"), "signed")

    # exact copies of a set: one representative, the smallest id, and a node of the graph with a number of its own
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))
    grouped = signed.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2", "sig").agg(F.min(row).alias("first"))
    named = grouped.where("first is not null").select("n_shingles", "h1", "h2", "sig", "first.doc_id", "first.text_key")
    reps = written(named.withColumn("node", F.monotonically_increasing_id()), "reps")

    keys = reps.select(F.col("node").alias("rep"), "sig").mapInArrow(_index, "key long, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count("*").alias("members")).where("pivot <> last")
    members = written(keys.join(shared.drop("last"), "key"), "members")

    sizes = reps.select(F.col("node").alias("rep"), F.col("n_shingles").alias("n"), "sig")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    # a key's smallest node stands in all of its blocks
    blocked = members.withColumn("block", F.explode(F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(side))))
    forest = (
        blocked.join(sizes, "rep").select("key", "block", "rep", "n", "sig")
        .repartition("key", "block").sortWithinPartitions("key", "block")
        .mapInArrow(_forest, "a long, b long").distinct()
    )
    first = components(_confirmed(forest, texts, reps, width))

    # what still lies apart under one of the larger keys
    placed = written(
        members.where(F.col("members") > FEW).join(first, F.col("rep") == F.col("node"), "left").select("key", "rep", "members", F.coalesce("component", "rep").alias("component")),
        "placed",
    )
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    apart = written(placed.join(split, "key").join(sizes, "rep"), "apart")
    short = _of(texts, reps, apart.select(F.col("rep").alias("node")).distinct()).mapInArrow(_shortened(width), "id long, short binary")
    rows = (
        apart.join(short.groupBy(F.col("id").alias("rep")).agg(F.when(F.count("*") == 1, F.min("short")).otherwise(F.lit(b"")).alias("short")), "rep")
        .withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "rep", "component", "n", "sig", "short")
    )
    across = (
        rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        .mapInArrow(_across, "a long, b long").distinct()
    )
    links = _confirmed(across, texts, reps, width)
    label = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    joined = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    second = components(joined).select(F.col("node").alias("inner"), F.col("component").alias("outer"))

    placed_in = reps.select("node", "n_shingles", "h1", "h2", "doc_id", "text_key").join(first, "node", "left").withColumn("inner", F.coalesce("component", "node"))
    group = written(placed_in.join(second, "inner", "left").select("n_shingles", "h1", "h2", "doc_id", "text_key", F.coalesce("outer", "inner").alias("group")), "groups")
    # only groups of several sets need another look for their smallest document
    least = group.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    final = group.join(least, "group", "left").select("n_shingles", "h1", "h2", F.coalesce("least", F.struct("doc_id", "text_key")).alias("least"))
    alone = signed.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    own = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & ((F.col("text_key") == F.col("least.text_key")) | F.col("least").isNull())
    linked = signed.where("n_shingles > 0").join(final, ["n_shingles", "h1", "h2"], "left").select("doc_id", "text_key", "n_shingles", F.col("least.doc_id").alias("component_id"), own.alias("stays"))
    judged = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    return judged.select("doc_id", "n_shingles", "component_id", "kept", *(["text_key", "stays"] if keyed else []))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near duplicates, that of the smallest id, with all its columns.

    Rows are told apart by id and text together.  Of rows that repeat both, one stays.
    Rows without an id that copy no document with one all stay, as do rows without words
    that differ in id or text.
    """
    verdict = written(near_duplicates(docs, id_column, text_column, width, keyed=True), "verdict")
    names = fresh(docs, "row_id", "row_key")
    keys = [F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1])]
    same = F.col(id_column).eqNullSafe(F.col(names[0])) & (text_key(text_column) == F.col(names[1]))
    drop = written(verdict.where(~F.col("stays")).select(*keys).distinct(), "drop")
    kept = docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, same, "left_anti")
    again = written(verdict.where("stays and doc_id is not null").groupBy(*keys).count().where("count > 1").drop("count"), "again")
    if again.isEmpty():
        return kept
    marked = kept.withColumn(names[1], text_key(text_column))
    twice = kept.join(again, same, "left_semi").withColumn(names[1], text_key(text_column)).dropDuplicates([id_column, names[1]])
    return marked.join(again.withColumnRenamed(names[1], f"{names[1]}_"), F.col(id_column).eqNullSafe(F.col(names[0])) & (F.col(names[1]) == F.col(f"{names[1]}_")), "left_anti").unionByName(twice).drop(names[1])
