"""Alignment of two tokenizers against a plain version that walks both token lists."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from fidelscope.llm import alignment as al
from fidelscope.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def sides():
    return al.Sides(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def plain_tokens(sides, text):
    """Ids of both sides by the tokenizers alone, or None."""
    if not text:
        return None
    raw = f" {text}".encode()
    a = sides.a.tokenizer.encode(f" {text}", add_special_tokens=False).ids
    b = sides.b.encode(text)
    if b"".join(sides.bytes_a[i] for i in a) != raw or b"".join(sides.bytes_b[i] for i in b) != raw:
        return None
    return a, b


def spans(ids, table):
    end = 0
    for i in ids:
        start, end = end, end + len(table[i])
        yield i, start, end


def by_force(sides, texts):
    found, pairs = [], Counter()
    for text in texts:
        tokens = plain_tokens(sides, text)
        if tokens is None:
            found.append(None)
            continue
        a, b = list(spans(tokens[0], sides.bytes_a)), list(spans(tokens[1], sides.bytes_b))
        ends = {e for _, _, e in a} & {e for _, _, e in b}
        links = [(x, y) for x, _, e in a for y, _, f in b if e == f] if len(a) < 500 else list(zip(
            [x for x, _, e in a if e in ends], [y for y, _, e in b if e in ends]))
        groups, left, right = [], [], []
        at = iter(b)
        for x, _, e in a:
            left.append(str(x))
            if e in ends:
                for y, _, f in at:
                    right.append(str(y))
                    if f == e:
                        break
                groups.append(f"{','.join(left)}|{','.join(right)}")
                left, right = [], []
        pairs.update(links)
        n_overlaps = sum(s < f and t < e for _, s, e in a for _, t, f in b) if len(a) < 500 else None
        found.append((len(a), len(b), len(groups), links, n_overlaps, sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in pairs.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, 0, "") if f is None else
        (f[0], f[1], f[2], len(f[3]), f[4], sum(pairs[p] == best[p[1]] for p in f[3]), sum(pairs[p] for p in f[3]), f[5])
        for f in found
    ]


ODD = [
    None, "", " ", "  ", "\n", "\n\n", "a\n\n b", "a\n\n\nb", "a\n \nb", " a", "a ", "a  b", "\ta\tb", "x\r\ny", "a b c", "½ ② Ⅷ",
    "a▁b", "é é", "<s>x</s> <|endoftext|> <0x41> <unk>", "\x00a", "\x1c a \x85 b", "日本語 テキスト", "😂😂 😂", "don't we're",
    "ﬁne", "a​b", "12345 67 8,9", "\xa0 a\t \xa0b", "a \t b",
]


def made_texts():
    rnd = random.Random(4)
    words = ["the", "über", "naïve", "running", "don't", "x" * 30, "3.14", "été", "(a)", "b\nc", "d\n\ne", "日本", "qqzx", "\n\nf"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    parts = ["a", "b", " ", " ", "\n", "\t", "é", "▁", "'", "1", ".", "\xa0", "ab "]
    return ODD + texts + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(400)] + texts[:4]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_best", "count_sum", "groups_sha256"]


def test_documents_against_brute_force(spark, sides, monkeypatch):
    texts = made_texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, row STRING, codes INT")
    want = by_force(sides, texts)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in al.align_corpus(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    # The frequent pairs may be few: the rest is joined, with the same result.
    aligned = al.stage(al.align(docs.withColumn("row", docs["doc_id"]), "row"))
    pairs = al.stage(al.count_pairs(aligned))
    assert pairs.where(f"n >= {al.common_from(pairs, 20)}").count() <= 20 < pairs.count()
    for r in al.look_up(aligned, pairs, "row", most=20).collect():
        assert (r.n_best, r.count_sum) == want[r.doc_id][5:7]


def test_very_long_text_in_stretches(spark, sides):
    rnd = random.Random(8)
    words = [f"{rnd.choice('abcdé')}{rnd.randrange(5000)}" for _ in range(3000)]
    long = " ".join(rnd.choice(words) for _ in range(120_000)) + "\nend"
    assert len(list(al.stretches(long))) > 4 and " ".join(al.stretches(long)) == long
    texts = [long, "z" * 300_000, long + " ▁"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in al.align_corpus(docs).collect()}
    for i, want in enumerate(by_force(sides, texts)):
        assert tuple(got[i][c] for c in COLUMNS if c != "n_overlaps") == want[:4] + want[5:]


def test_overlaps_of_made_tokens():
    pairs = al.overlaps(np.array([2, 1, 3, 4]), np.array([1, 4, 1, 3, 1]), np.array([0, 0, 0, 1]), np.array([0, 0, 0, 1, 1]))
    found = sorted(zip(pairs["a"], pairs["b"], pairs["together"], pairs["unit"], strict=True))
    assert found == [(0, 0, False, 0), (0, 1, False, 0), (1, 1, False, 0), (2, 1, False, 0), (2, 2, True, 0), (3, 3, False, 1), (3, 4, True, 1)]


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id BIGINT, text STRING").coalesce(1)
    got = sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in al.align_corpus(docs).collect())
    assert got == [(0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert al.align_corpus(docs.limit(0)).count() == 0
