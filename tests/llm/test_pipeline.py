"""The pipeline's stages against plain versions, over the smallest tables."""

import os
import re
from collections import defaultdict

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_stages(spark):
    import corpus_pipeline as p
    from quillmere.llm import secrets
    from quillmere.llm.common import written
    from quillmere.llm.tokens import encode_whole
    from quillmere.llm.toxicity import fit, toxicity

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, columns, kept = [n for n, _ in p.STAGES], docs.columns, {}
    assert names == ["toxicity", "near_dedup", "decontamination", "secret_scans", "packing"]
    kept["documents"] = docs.collect()
    frame = docs
    for name, stage in p.STAGES:
        frame = written(stage(spark, frame, DATA), name)
        kept[name] = frame.collect()
        if name != "packing":
            assert frame.columns == columns and frame.schema.simpleString() == docs.schema.simpleString()
    model = fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    clean = {r.doc_id for r in toxicity(docs, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept["toxicity"]} == clean

    sets, root = {}, {}
    for r in kept["toxicity"]:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        root[r.doc_id] = r.doc_id

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id for r in kept["near_dedup"]} == {i for i in ids if find(i) == i}

    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = alnum(r.text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[len(w[i : i + 13])].add(tuple(w[i : i + 13]))
    good = set()
    for r in kept["near_dedup"]:
        w = alnum(r.text)
        hit = {i + o for n, own in windows.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own for o in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            good.add(r.doc_id)
    assert {r.doc_id for r in kept["decontamination"]} == good

    table = secrets.fit(secrets.default_samples(spark))
    before = {r.doc_id: r for r in kept["decontamination"]}
    spans = {r.doc_id: r.spans for r in secrets.secret_scan(spark.createDataFrame(kept["decontamination"], docs.schema), table).collect()}
    assert {r.doc_id for r in kept["secret_scans"]} == good
    for r in kept["secret_scans"]:
        places = sorted(tuple(map(int, s.split(":")[1:])) for s in spans[r.doc_id].split(",") if s)
        out, at = "", 0
        for a, b in places:
            if a >= at:
                out += before[r.doc_id].text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == out + before[r.doc_id].text[at:] and (r.n_chars == len(r.text) if places else r.n_chars == before[r.doc_id].n_chars)

    size = {r.doc_id: len(x) + 1 for r, x in zip(kept["secret_scans"], encode_whole(p.tokenizer_path(), [r.text for r in kept["secret_scans"]]))}
    got = defaultdict(int)
    for r in kept["packing"]:
        got[r.doc_id] += r.length
        assert r.doc_tokens == size[r.doc_id] and r.offset + r.length <= 4096
    assert dict(got) == size
    assert p.run(spark, DATA).count() == len(kept["packing"])
