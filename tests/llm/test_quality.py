"""Repetition by suffix arrays against all windows of a text."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fidelscope.llm import quality


def by_force(words):
    n, longest = len(words), 0
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), max_size=6))
def test_longest_repeats(texts):
    ids = np.array([w for t in texts for w in t], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert quality.longest_repeats(ids, text).tolist() == [x for t in texts for x in by_force(t)]


def test_measures_of_odd_texts(spark):
    line = "one two three four five six seven eight nine ten eleven"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, f"{line}\n{line}\n\n#x|"), (5, "a " * 500), (6, "é\x85ü\xa0ß"), (6, "é\x85ü\xa0ß"),
    ]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").crossJoin(spark.createDataFrame([(1,)], "n_words INT"))
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert [got[i].n_words for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 23, 500, 1]
    assert (got[4].n_dup_lines, got[4].n_symbols, got[4].n_repeat_words, got[4].longest_repeat) == (1, 2, 22, 11)
    assert (got[5].n_repeat_words, got[5].longest_repeat, got[5].kept) == (500, 499, False)
    assert (got[6].word_chars, got[6].base_failed) == (5, True)
    assert quality.judge(docs.limit(0)).count() == 0


def test_long_repeat_fails_a_text_that_the_plain_rules_keep(spark):
    rnd = random.Random(1)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    text = " ".join([*words, *words[50:200]])
    r = quality.judge(spark.createDataFrame([(1, text), (2, " ".join(words))], "doc_id BIGINT, text STRING")).collect()
    got = {x.doc_id: (x.base_failed, x.kept, x.longest_repeat >= 150) for x in r}
    assert got == {1: (False, False, True), 2: (False, True, False)}
