"""The pipeline's stages, one after another, each held against its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
from fidelscope.session import stage


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, function in pipeline.STAGES:
        frames.append(stage(function(spark, frames[-1], sf_dir)))
        if name != "packing":
            assert frames[-1].columns == columns
    rows = [f.collect() for f in frames]
    before, clean, exact, near, mixed, packed = rows
    assert {r.doc_id for r in clean} <= {r.doc_id for r in before}
    last = {}
    for r in clean:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    sets = {r.doc_id: shingles(r.text) for r in exact}
    assert sorted(r.doc_id for r in near) == kept(sets)
    times = Counter(r.doc_id for r in mixed)
    assert set(times) == {r.doc_id for r in near} and max(times.values()) <= 2
    words = Counter(), Counter()
    for r in packed:
        words[0][r.doc_id] += r.length
        words[1][r.doc_id] += r.doc_tokens * (r.start == 0)
    assert words[0] == words[1] and set(words[0]) == set(times)


def shingles(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def kept(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            a, b = sets[i], sets[j]
            if j < i and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(i for i in ids if find(i) == i)
