"""Mixing: the bisected exponent, budgets, permutations and blocks."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from fidelscope.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "a b c d e", "big", 0) for i in range(800)]
    rows += [(1000 + i, "w " * (i % 9 + 1), "mid", 0) for i in range(60)]
    rows += [(2000 + i, "one two", None, 0) for i in range(30)] + [(3000, None, "empty", 0), (3000, "", "empty", 0)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, row INT").coalesce(2)


def shares(docs):
    counts = Counter()
    for r in docs.collect():
        counts[r.source or ""] += len((r.text or "").split())
    return counts


def test_repetition_limit(docs):
    found = mixing.mix(docs, max_repetition=3.0)
    copies = Counter((r.doc_id, r.row) for r in found.rows.collect())
    assert len(copies) == docs.count() and max(copies.values()) == 3
    sources = {r.source: r for r in found.sources.collect()}
    times = {k: r.budget / r.tokens for k, r in sources.items() if r.tokens}
    assert min(times.values()) == 1 and max(times.values()) == pytest.approx(3, abs=0.01)
    p = {k: n / sum(shares(docs).values()) for k, n in shares(docs).items() if n}
    norm = sum(x**found.exponent for x in p.values())
    assert all(sources[k].weight == pytest.approx(x**found.exponent / norm) for k, x in p.items())


def test_target_entropy(docs):
    found = mixing.mix(docs, max_repetition=None, target_entropy=0.9)
    weights = [r.weight for r in found.sources.collect() if r.weight]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(0.9, abs=1e-4)


def test_budget_is_met_by_whole_permutations_and_a_rest(docs):
    budget = 2_500
    found = mixing.mix(docs, max_repetition=2.0, budget=budget, blocks=5)
    rows, sources = found.rows.collect(), {r.source: r for r in found.sources.collect()}
    assert abs(sum(r.budget for r in sources.values()) - budget) <= 3
    used, blocks = Counter(), defaultdict(Counter)
    for r in rows:
        used[r.source] += r.n_tokens
        blocks[r.block][r.source] += r.n_tokens
    for name, r in sources.items():
        if r.tokens:
            assert 0 <= r.budget - used[name] < 10
    assert sorted(blocks) == list(range(5))
    big = [blocks[b]["big"] for b in range(5)]
    assert max(big) - min(big) <= 10


def test_repeated_documents_keep_their_columns(docs):
    again = mixing.repeat_documents(docs, max_repetition=2.0)
    assert again.columns == docs.columns
    counts = Counter(r.doc_id for r in again.collect())
    assert set(counts) == {r.doc_id for r in docs.collect()} and counts[3000] == 2


def test_empty_table(docs):
    assert mixing.mix(docs.limit(0)).rows.count() == 0
