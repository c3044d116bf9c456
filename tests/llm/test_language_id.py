"""Language identification: back-off by hand, the whole by brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fidelscope.llm import language_id as li
from fidelscope.llm.queries import QUERIES


def test_unseen_words_use_the_longest_known_grams():
    grams = {"<a": 0, "a": 1, "b": 2, "bc>": 3, "<": 4}
    logs = np.log(np.arange(1, 11, dtype=float).reshape(5, 2))
    model = li.LanguageModel(["x", "y"], {"known": 0}, np.array([[-1.0, -2.0]]), grams, logs)
    assert model.word_scores("known").tolist() == [-1.0, -2.0]
    assert model.word_scores("abc") == pytest.approx(logs[0] + logs[3])
    assert model.word_scores("bb?") == pytest.approx(logs[4] + 2 * logs[2])
    assert model.predict("") == model.predict("12 !") == ("und", 0.0)
    assert model.predict("known")[0] == "x"


def test_words_keep_their_marks_and_need_a_letter():
    assert li.words_of("Été café, ́") == ["été", "café"]
    hindi = "यह एक हिंदी वाक्य है"
    assert li.words_of(hindi) == hindi.split()
    assert li.words_of("½ ② Ⅷ ² 12 _ ́") == [] and li.words_of("x² y_z") == ["x", "y", "z"]


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_language_id"](spark, sf).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.98


def plain_words(text):
    """Runs of letters and marks that hold a letter, by walking over the characters."""
    words, word = [], ""
    for c in f"{text or ''} ".lower():
        if unicodedata.category(c)[0] in "LM":
            word += c
        else:
            words += [word] if any(unicodedata.category(x)[0] == "L" for x in word) else []
            word = ""
    return words


def by_force(rows):
    """Fit and predictions with dictionaries; all rows fit the sample and all words the model."""
    learn = [(t, x) for i, t, x in rows if zlib.crc32(str("" if i is None else i).encode()) % 4 != 2 and t is not None and x]
    langs = sorted({x for _, x in learn})
    counts = {x: Counter(w for t, y in learn if y == x for w in plain_words(t)) for x in langs}
    totals = {x: sum(counts[x].values()) for x in langs}
    vocabulary = set().union(*counts.values())
    grams = defaultdict(lambda: dict.fromkeys(langs, 0.0))
    for w in vocabulary:
        text = f"<{w}>"
        for n in range(1, 6):
            for i in range(len(text) - n + 1):
                for x in langs:
                    grams[text[i : i + n]][x] += math.sqrt(counts[x][w])
    sums = {n: {x: sum(v[x] for g, v in grams.items() if len(g) == n) for x in langs} for n in range(1, 6)}
    sizes = Counter(map(len, grams))

    def log(word, x):
        if word in vocabulary:
            return math.log((counts[x][word] + 0.5) / (totals[x] + 1))
        text, at, total = f"<{word}>", 0, 0.0
        while at < len(text):
            n = next((n for n in range(min(5, len(text) - at), 0, -1) if text[at : at + n] in grams), 0)
            if n:
                total += math.log((grams[text[at : at + n]][x] + 0.5) / (sums[n][x] + 0.5 * sizes[n]))
            at += max(n, 1)
        return total

    found = []
    for _, text, _ in rows:
        words = plain_words(text)
        logs = [sum(log(w, x) for w in words) for x in langs]
        best = max(logs, default=0)
        found.append((langs[logs.index(best)], 1 / sum(math.exp(v - best) for v in logs)) if words else ("und", 0.0))
    return found


def test_documents_against_brute_force(spark):
    rows = [
        (1, "the cat sat on the mat", "en"), (2, "the dog ran", "en"), (3, "le chat dort sur le tapis", "fr"),
        (4, "le chien a couru très vite", "fr"), (5, "café au lait", "fr"), (7, "यह एक हिंदी वाक्य है", "hi"),
        (8, "हिंदी में लिखा हुआ", "hi"), (9, "The CATS dozed", None), (10, "les chiennes", "xx"), (11, "वाक्यों को", None),
        (12, "½ ② Ⅷ", "en"), (13, "x² ١٢", None), (14, "ÇA İS", "fr"), (None, "sat", "en"), (1, "the cat sat on the mat", "en"),
        (15, "zzz qqq", None), (16, "cafes thes mats " * 20_000, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").coalesce(1)
    got = [(r.lang_pred, r.score) for r in li.predict(docs, li.fit(docs)).collect()]
    want = by_force(rows)
    assert [x for x, _ in got] == [x for x, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_sample_takes_copies_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(li, "ROWS_PER_LANGUAGE", 500)
    rows = [(i, "the same words", "en") for i in range(4000)] + [(i, f"autres mots {i}", "fr") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    seen, whole = {}, li.stage
    monkeypatch.setattr(li, "stage", lambda df: seen.setdefault("counts", df) and whole(df))
    li.fit(docs)
    copies = seen["counts"].where("word = 'same'").first()["count"]
    assert 400 < copies < 600


def test_odd_rows_and_nothing_to_learn(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "the cat " * 500, "en"), (3, "le chat", "fr"), (None, "1 2", "en"), (5, "le the", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id BIGINT, text STRING, lang STRING, place INT")
    got = li.predict(docs, li.fit(docs)).collect()
    assert [r.lang_pred for r in got][:2] == ["und", "und"] and len(got) == 6
    nothing = li.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in li.predict(docs, nothing).collect()} == {"und"}
    assert li.predict(docs.limit(0), nothing).count() == 0
