"""Repeated substrings against a table of all substrings."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from fidelscope.llm import substring_dedup as sd
from fidelscope.llm.queries import QUERIES


def by_force(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    found = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        starts = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        found.append((len(b), int(gone.sum()), starts, sha256(kept).hexdigest()))
    return found


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_are_in_order(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 4, 3000).astype(np.uint16)
    text[500:900] = text[1500:1900]
    text[100:160] = 2
    text[[299, 1200, 2999]] = 0
    order = sd.suffix_array(text, 400)
    assert sorted(order.tolist()) == list(range(3000))
    keys = [bytes(text[i : i + 400].astype(np.uint8)) for i in order if 0 not in text[i : i + 400]]
    assert keys == sorted(keys)


@pytest.mark.parametrize("seed", range(4))
def test_only_wanted_suffixes_and_what_places_them_are_sorted(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, 4, 6000).astype(np.uint16)
    text[[*range(599, 6000, 600)]] = 0
    text[700:1100] = text[1900:2300]
    wanted = np.arange(6000) % 600 < 150
    order = sd.suffix_array(text, 400, wanted)
    found = set(order.tolist())
    assert len(found) == len(order) < 0.3 * len(text) and found >= set(np.flatnonzero(wanted).tolist())
    keys = [bytes(text[i : i + 400].astype(np.uint8)) for i in order if wanted[i]]
    assert keys == sorted(keys)


def test_leaders_whose_runs_have_several_places_are_not_sorted(monkeypatch):
    rows = [(1, 2, b"a" * 410), (1, 3, b"b" * 405), (2, 1, b"c" * 401), (2, 4, b"c" * 400), (3, 2, b"d" * 400), (4, 1, b"efg" * 134)]
    table = pa.table({
        "leader": [r[0] for r in rows], "weight": [r[1] for r in rows], "windows": [len(r[2]) - 399 for r in rows],
        "body": pa.array([r[2] for r in rows], pa.binary())})
    sorted_, whole = [], sd.repeated_windows
    monkeypatch.setattr(sd, "repeated_windows", lambda bodies, *a: sorted_.extend(bodies) or whole(bodies, *a))
    found = sd.repeated_of_leaders(table, 400)
    assert sorted_ == [rows[2][2], rows[3][2], rows[5][2]]
    assert found.tolist() == [True] * (11 + 6 + 2 + 1 + 1) + [False] * 3


def made_texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(150), prose(90)
    texts = [prose(rnd.randint(0, 200)) for _ in range(30)]
    texts += [prose(20) + passage + prose(30) for _ in range(12)] + [passage] * 3 + [None, "", "x" * 399, "y" * 400]
    texts += ["z" * 1500, "ab" * 700, other + prose(5) + other, passage[:399], passage[5:410], passage[7:] + "q" + passage]
    texts += [texts[40][:600] + "!" + texts[40][601:], texts[31]]
    return texts


@pytest.mark.parametrize("most", [1_024, 4])
def test_against_all_substrings(spark, most):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING").repartition(3)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id INT, text STRING, row STRING")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), sha256(r.kept).hexdigest())
           for r in sd.remove_repeats(docs, most=most).collect()}
    want = by_force(texts, 400)
    assert got == dict(enumerate(want))


def test_long_texts_are_cut_into_segments(monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 2_000)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 20_000).astype(np.uint8)
    offsets = np.array([0, 300, 300, 9_000, 11_000, 20_000])
    windows = []
    for part, starts, texts, shifts in sd.segments(data, offsets, 400):
        first, count, _, _ = sd.runs_of(part, starts, 400)
        of = np.searchsorted(starts, first, "right") - 1
        for f, c, t, s, o in zip(first, count, texts[of], shifts[of], starts[of], strict=True):
            windows += [(int(t), int(f - o + s + k)) for k in range(c)]
    assert sorted(windows) == [(i, p) for i in range(5) for p in range(max(0, offsets[i + 1] - offsets[i] - 399))]


def test_query_against_all_substrings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], by_force([r.text for r in rows], 400), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in QUERIES["op4_substring_dedup"](spark, sf_dir).collect()}
    assert got == want


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id INT, text STRING")).count() == 0
