"""Trained models and joins held against plain versions written from their definitions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmere.llm import langid, neardup, quality, toxicity
from quillmere.llm import words as W
from quillmere.llm.common import chosen, raw_text, share_limit
from quillmere.llm.neardup import near_duplicates, one_of_each

RNG = np.random.default_rng(12)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(2, 7))) for _ in range(5000)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


def test_shares_never_fall_to_zero(spark):
    for rows, of in ((3_000, 10**11), (8_000, 10**12), (5, 5), (7, 3)):
        assert share_limit(rows, of) > -(2**63) and (rows < of or share_limit(rows, of) == 2**63 - 1)
    n = spark.range(1_000_000).where(chosen("id", 3_000, 1_000_000)).count()
    assert 2_600 < n < 3_400 and spark.range(10).where(chosen("id", 20, 10)).count() == 10


def test_quality_score_is_the_plain_network():
    net = quality.Network.new(3)
    texts = [RNG.integers(1, 255, n).astype(np.uint8).tobytes() for n in (0, 5, 1024, 1025, 4000)]
    flat, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    got = net.score(flat, offsets, net.taps())
    for t, score in zip(texts, got):
        values = []
        for at in range(0, max(1, len(t) - quality.CHUNK + quality.STEP), quality.STEP):
            chunk = np.zeros(quality.CHUNK, np.uint8)
            piece = np.frombuffer(t[at : at + quality.CHUNK], np.uint8)
            chunk[: len(piece)] = piece
            seen = net.embed[chunk]
            total = sum(seen[k : len(seen) - quality.TAPS + 1 + k] @ net.filters[k] for k in range(quality.TAPS))
            values.append(np.maximum(total.max(axis=0) + net.bias, 0))
        z = np.concatenate([np.max(values, axis=0), np.mean(values, axis=0), [1.0]]) @ net.dense
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-4, abs_tol=1e-6)


def test_language_is_plain_naive_bayes(spark):
    alphabets = {"aa": "abcdeé", "bb": "cdefgß", "cc": "efghi日"}
    rows = [(k, " ".join("".join(RNG.choice(list(alphabets[x]), 5)) for _ in range(12)).title() + " 12!", x) for k, x in enumerate(RNG.choice(list(alphabets), 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}

    def grams(text):
        low = [ord(c.lower()) if c.isascii() and c.isalpha() else 0x20 if c.isascii() else ord(c) for c in text]
        for i in range(len(low)):
            for k in range(langid.ORDERS):
                key = sum((low[i - j] if i >= j else 0x20) << (21 * j) for j in range(k + 1))
                yield int(W.mix(np.array([key + (k << 62)], np.uint64))[0] >> np.uint64(64 - langid.BITS))

    counts, rows_of = defaultdict(Counter), Counter()
    for i, t, x in rows:
        if not got[i].held_out:
            counts[x].update(grams(t))
            rows_of[x] += 1
    slots = 1 << langid.BITS
    for i, t, _ in rows:
        own = list(grams(t))
        score = {x: math.log(rows_of[x] / sum(rows_of.values())) + sum(math.log((counts[x][g] + langid._SMOOTH) / (sum(counts[x].values()) + langid._SMOOTH * slots)) for g in own) for x in counts}
        best = max(sorted(score), key=score.get)
        assert got[i].lang_pred == best
        assert math.isclose(got[i].score, 1 / sum(math.exp(v - score[best]) for v in score.values()), rel_tol=1e-3, abs_tol=1e-6)


def plain_ratios(texts, sides):
    """log P(toxic) - log P(ordinary) of a byte after four, by interpolated Kneser-Ney with shared lower orders."""
    five = [Counter(), Counter()]
    for t, s in zip(texts, sides):
        t = b"    " + t
        five[s].update(t[i - 4 : i + 1] for i in range(4, len(t)))
    four = [Counter(g[1:] for g in f) for f in five]
    every = {g for f in four for g in f}
    tri = Counter()
    for f in four:
        for g, n in f.items():
            tri[g[1:]] += n
    kinds = Counter(g[1:] for g in every)
    uni = Counter()
    for g, n in kinds.items():
        uni[g[2:]] += n
    bi = Counter(g[1:] for g in tri)
    d = toxicity.DISCOUNT

    def level(table, gram, below):
        total = sum(n for g, n in table.items() if g[:-1] == gram[:-1])
        if not total:
            return below
        followers = sum(1 for g in table if g[:-1] == gram[:-1])
        return max(table[gram] - d, 0) / total + d * followers / total * below if table[gram] else d * followers / total * below

    def p(gram, side):
        one = (uni[gram[4:]] + 0.01) / (sum(uni.values()) + 2.56)
        shared = level(tri, gram[2:], level(bi, gram[3:], one))
        return level(five[side], gram, level(four[side], gram[1:], shared))

    return lambda gram: math.log(p(gram, 1)) - math.log(p(gram, 0))


@pytest.mark.parametrize("shard_grams", [10**6, 40])
def test_toxicity_is_plain_kneser_ney_in_any_number_of_shards(spark, shard_grams):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["ab", "abc", "bca", "cab", "dd"], 6)) for _ in range(60)]
    sides = [int("dd" in t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, s) for i, s in enumerate(sides)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, shard_grams=shard_grams)
    assert (len(model.shards) > 1) == (shard_grams == 40)
    import zlib

    folds = [zlib.crc32(str(i).encode()) % 4 for i in range(60)]
    used = [(t.encode(), s) for t, s, f in zip(texts, sides, folds) if f in (0, 1)]
    want = plain_ratios([t for t, _ in used], [s for _, s in used])
    part = pa.RecordBatch.from_pydict({"text": [*texts, "zz abz dd", "", None]})
    data, offsets = toxicity._letters(part, "text")
    keys = toxicity._grams(data, offsets)
    got = dict(zip(keys.tolist(), model.ratios(keys).tolist()))
    for k, v in got.items():
        assert math.isclose(v, want(k.to_bytes(5, "big")), rel_tol=1e-4, abs_tol=1e-5)
    whole = toxicity.fit(docs, labels)
    score = lambda m: {r.doc_id: r.score for r in toxicity.toxicity(docs, m).collect()}
    one, many = score(whole), score(model)
    assert all(math.isclose(one[k], many[k], rel_tol=1e-5) for k in one)


def signature(text):
    data, offsets = raw_text(pa.array([text]))
    starts, ends, first = W.spans(data, offsets, W.SPACE_WORD)
    return np.frombuffer(neardup.signature(W.shingles(W.hashes(data, starts, ends), first)[0]), "<u2")


def test_unrelated_long_texts_look_unrelated():
    rng = np.random.default_rng(4)
    a, b = (signature(" ".join(rng.integers(0, 10**9, 200_000).astype(str))) for _ in range(2))
    assert (a != b).sum() >= 60


def groups(texts):
    """Components of all pairs at similarity 0.75 or more, by brute force."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(words, share, rng):
    out = list(words)
    for k in np.flatnonzero(rng.random(len(out)) < share):
        out[k] = f"x{rng.integers(10**9)}"
    return " ".join(out)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(60):
        base = prose(300, rng).split()
        texts += [" ".join(base), *(edited(base, share, rng) for share in (0.01, 0.02, 0.025, 0.03, 0.04))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    want = groups(texts)
    linked = [i for i in range(len(texts)) if want[i] != i]
    assert len(linked) > 100 and np.mean([got[i] == want[i] for i in linked]) > 0.99
    assert all(got[i] == i or want[i] != i for i in range(len(texts)))


def test_keys_of_many_members(spark, monkeypatch):
    """Texts with one common half: far apart in sets, near in keys; groups of near copies among them."""
    rng = np.random.default_rng(7)
    common = prose(150, rng)
    texts = []
    for k in range(60):
        own = f"{common} {prose(60, rng)}"
        texts += [own, *(edited(own.split(), 0.005, rng) for _ in range(2))] if k % 4 == 0 else [own]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = groups(texts)
    for block in (1024, 8):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_rows_of_one_id_with_other_texts(spark):
    a, b, c, d = (prose(60) for _ in range(4))
    rows = [(1, a, 0), (1, b, 1), (1, b, 2), (0, b + " end", 3), (None, c, 4), (None, d, 5), (2, c, 6), (3, "", 7), (4, None, 8), (3, "", 9), (5, a, 10)]
    own = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, k int, row_id string, row_key string, text_key string")
    kept = one_of_each(own)
    assert kept.columns == own.columns
    ks = sorted(r.k for r in kept.collect())
    # b at id 1 copies id 0 and goes; a at id 1 stays and id 5 goes; the row without an id that copies id 2 goes
    assert ks in ([0, 3, 5, 6, 7, 8], [0, 3, 5, 6, 8, 9])
    assert one_of_each(own.limit(0)).count() == 0
