"""Toxicity: the kernel by brute force, tolerance, held-out accuracy, odd rows."""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from fidelscope.llm import toxicity as tx
from fidelscope.llm.queries import QUERIES


def by_force(word):
    """Weighted triples of a word with its end marks."""
    codes = [1, *(3 + ord(c) % 61 for c in word), 2]
    found = defaultdict(float)
    for a, b, c in combinations(range(len(codes)), 3):
        if c - a < tx.WINDOW:
            found[codes[a], codes[b], codes[c]] += tx.DECAY ** (c - a - 2)
    norm = sum(v * v for v in found.values()) ** 0.5
    return {k: v / norm for k, v in found.items()}


def test_kernel_against_all_subsequences():
    words = ["idiot", "idiots", "ixdiot", "a", "ab", "réeux", "aaaa", "worthless"]
    model = tx.ToxicityModel(words, np.zeros(len(words)), 0.0, len(words))
    near, kernel = model.kernels(words)
    sets = [by_force(w) for w in words]
    for i, row in zip(near, kernel, strict=True):
        want = [sum(v * s.get(k, 0) for k, v in sets[i].items()) ** tx.POWER for s in sets]
        assert row == pytest.approx(want, abs=1e-5)
    assert set(near) == set(range(len(words)))


def test_forms_of_words():
    assert [tx.plain(w) for w in ("IDIOT!!", "i.d.i.o.t", "id10t,", "stupid$$$", "123", "--")] == [
        "idiot", "idiot", "idiot", "stupid", "", ""]
    assert "idiot" in tx.words_of("an i d i o t here")


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return [(r, labels.get(r.doc_id)) for r in QUERIES["op6_toxicity"](spark, sf).collect()]


def test_held_out_documents(scored):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r, _ in scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r, _ in scored)
    held = [(r.score, y) for r, y in scored if r.held_out and y is not None]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x == 1 and y == 0]
    assert np.mean(pairs) > 0.75
    clean = [r.predicted for r, y in scored if r.held_out and y == 0]
    assert np.mean(clean) < 0.05


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "you idiot " * 400, 1), (3, "you idiot", 2), (None, "...", 3)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score INT")
    labels = spark.createDataFrame([], "doc_id BIGINT, toxic INT")
    model = tx.fit(docs, labels)
    assert len(tx.score(docs, model).collect()) == 5
    assert tx.drop_toxic(docs, model, 0.6).columns == docs.columns
    assert tx.score(docs.limit(0), model).count() == 0


def test_no_near_word_is_skipped():
    insults = ["scum", "idiot", "moron", "stupid"]
    model = tx.ToxicityModel(insults, np.zeros(len(insults)), 0.0, len(insults))
    inserted = [w[:i] + "x" + w[i:] for w in insults for i in range(1, len(w))]
    doubled = ["iddioot", "iddiott", "mooronn", "idiioot"]
    words = [*inserted, *doubled, "table", "customer", "aaaa"]
    sets = [by_force(w) for w in insults]
    kernel = [max(sum(v * s.get(k, 0) for k, v in by_force(w).items()) for s in sets) for w in words]
    near, found = model.kernels(words)
    assert {w for w, k in zip(words, kernel, strict=True) if k >= tx.NEAR} <= {words[i] for i in near}
    assert {"scxum", "sxcum", *doubled} <= {words[i] for i in near}
    assert found.max(axis=1) == pytest.approx([kernel[i] ** tx.POWER for i in near], abs=1e-5)


@pytest.mark.parametrize("labelled", [[], [(1, None)], [(1, 1)], [(1, 1), (3, 0), (4, 1)]])
def test_stage_keeps_all_rows_when_nothing_was_learned(spark, tmp_path, labelled):
    from corpus_pipeline import TOXIC_FROM, toxicity_stage

    spark.createDataFrame(labelled, "doc_id BIGINT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, None), (2, ""), (3, "you idiot " * 400), (4, "a plain text"), (None, "...")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    kept = toxicity_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.collect()))
    model = tx.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert all(r.score < TOXIC_FROM / 100 for r in tx.score(docs, model).collect())


def test_columns_that_clash_and_ids_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(tx, "DOCS_PER_CLASS", 20)
    rows = [(i % 7, f"you iddiot number {i}" if i % 7 % 2 else f"a table of numbers {i}", i, "x", 0.5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT, row STRING, margin DOUBLE")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] + [(1, 1)] * 50, "doc_id BIGINT, toxic INT")
    seen, whole = [], tx.calibrate
    monkeypatch.setattr(tx, "calibrate", lambda rows: seen.append(len(rows)) or whole(rows))
    monkeypatch.setattr(tx, "EVIDENCE", 0.1)
    model = tx.fit(docs, labels)
    assert seen == [40] and model.landmarks
    assert tx.score(docs, model).count() == 400
    kept = tx.drop_toxic(docs, model, 2.0)
    assert kept.columns == docs.columns and kept.count() == 400


def test_margins_against_plain_scoring():
    """Repeated words, spelled ones, ties and a very long text, with and without words met before."""
    insults = ["scum", "idiot", "moron", "stupid"]
    model = tx.ToxicityModel(insults, np.array([1.0, 0.8, 0.8, 0.5]), -1.0, len(insults))
    texts = ["you IDIOT!", "idiot idiot idiot scum", "m o r o n here", None, "", "plain words", "iddioot scxum idiot, stupid",
             "word " * 200_000 + "stupid moron", "scum scum"]
    want = []
    for text in texts:
        words = tx.words_of(text) if text else []
        margins = dict(zip(words, model.margins([tx.plain(w) for w in words]), strict=True)) if words else {}
        ranked = sorted((-margins[w], w) for w in words if tx.plain(w) and margins[w] > model.bias)[:3]
        want.append(([-m for m, _ in ranked] + [model.bias] * (3 - len(ranked)), ranked[0][1] if ranked else None))
    for _ in range(2):
        margins, worst = model.worst(texts)
        assert margins.tolist() == [pytest.approx(m) for m, _ in want] and worst == [w for _, w in want]


def test_the_fit_holds_its_words_once():
    import random
    import tracemalloc

    from fidelscope.llm.toxicity import train

    rng = random.Random(1)
    toxic = sorted({"".join(rng.choices("abcdefgh", k=6)) for _ in range(150)})
    words = sorted({"".join(rng.choices("abcdefgh", k=6)) for _ in range(12_000)})
    counted = [(w, np.array([rng.randrange(5), rng.randrange(9)], float)) for w in words]
    tracemalloc.start()
    try:
        model = train(toxic, counted)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Before, the peak was seven times the words' matrix.
    assert peak < 3 * len(words) * len(model.landmarks) * 8


def test_kernels_touch_only_landmarks_that_share_a_subsequence():
    import random
    import tracemalloc

    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcdefghijklmnop", k=10)) for _ in range(656)})
    rng.shuffle(words)
    model = tx.ToxicityModel(words[:400], np.zeros(400), 0.0, 400)
    near_copies = [w + "x" for w in words[:200]]
    model.kernels(near_copies[:2])
    tracemalloc.start()
    try:
        near, kernel = model.kernels(near_copies)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Before, every subsequence of a word met all landmarks: over 20 MB here.
    assert peak < 8 << 20
    sets = [by_force(w) for w in model.landmarks]
    for i in (0, 57, 199):
        own = by_force(near_copies[near[i]])
        want = [sum(v * s.get(k, 0) for k, v in own.items()) ** tx.POWER for s in sets]
        assert kernel[i] == pytest.approx(want, abs=1e-5)
