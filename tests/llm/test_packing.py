"""Packing: an exact round trip, little padding, and the word cache against the tokenizer."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fidelscope.llm.packing import Packer, digests, pack
from fidelscope.llm.tokens import Encoder, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(tokenizer_path())
    found.encode_special_tokens = True
    return found


ODD_TEXTS = [
    "", " ", "\n", "a", "  two  spaces ", "tab\tand\nline \n\n x", "don't we'll I'M", "x=1;y==2 ...!!",
    "é ü ß ñ — “q”", "a b c　d", "\x1c\x1d x\x85y", "<|endoftext|> in text<|endoftext|>",
    "a\n\nb", "a\n\n b", "a\n\n\nb", "a\n\n", "a\n", "\na", "a \nb", "a\n b c", "日本語 テキスト 😀😀", "a" * 5000, "word " * 3000, "\r\n\r\n z", "​zero﻿",
]


def test_word_cache_equals_the_tokenizer(tokenizer):
    encoder = Encoder(tokenizer_path())
    for _ in range(2):
        for text, got in zip(ODD_TEXTS, encoder.encode(ODD_TEXTS), strict=True):
            want = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(got, "<u4").tolist() == want, text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sab1. ")), max_size=40))
def test_word_cache_on_any_text(text):
    encoder = test_word_cache_on_any_text.__dict__.setdefault("encoder", Encoder(tokenizer_path()))
    assert encoder.encode([text])[0] == encoder.whole([text])[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=60), st.integers(1, 8))
def test_packer_round_trip(lengths, pool):
    packer = Packer(first=7 << 33, pool=pool)
    texts = {i: np.arange(n, dtype="<u4") + i for i, n in enumerate(lengths) if n}
    for i, ids in texts.items():
        packer.add(i, ids.tobytes())
    packer.pack(last=True)
    check(packer.rows, texts)
    used = defaultdict(int)
    for row in packer.rows:
        used[row[4]] += row[2]
    assert sum(n not in packer.tiers for n in used.values()) <= 1


def check(rows, texts):
    pieces, places = defaultdict(list), defaultdict(list)
    for doc, start, length, total, sequence, offset, _, _, ids in rows:
        assert total == len(texts[doc]) and length > 0
        pieces[doc].append((start, np.frombuffer(ids, "<u4")))
        places[sequence].append((offset, length))
    for doc, found in pieces.items():
        assert np.array_equal(np.concatenate([p for _, p in sorted(found, key=lambda f: f[0])]), texts[doc])
    assert pieces.keys() == texts.keys()
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048


def test_steps_hold_equal_tokens():
    packer = Packer()
    for i in range(400):
        packer.add(i, np.zeros(300 + 7 * i, "<u4").tobytes())
    steps = defaultdict(int)
    for row in packer.rows:
        steps[row[7]] += row[2]
    assert sum(n == 16 * 2048 for n in steps.values()) >= len(steps) - 4


def test_null_empty_repeated_and_extra_columns(spark, tokenizer):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING")
    got = digests(pack(docs)).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got) == [(0, 2), (1, 1), (2, 1), (3, 3), (3, 3)]
    want = np.array([*tokenizer.encode("a b", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert {r.ids_crc32 for r in got if r.doc_id == 3} == {zlib.crc32(want)}
    assert pack(docs.limit(0)).count() == 0


def test_documents_round_trip(spark, tokenizer, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {
        r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for r in docs.collect()
    }
    rows = [tuple(r) for r in pack(docs).collect()]
    check(rows, texts)
    tokens = sum(map(len, texts.values()))
    windows = defaultdict(int)
    for row in rows:
        windows[row[4]] += row[2]
    padded = sum(0 if n & (n - 1) == 0 else 2048 - n for n in windows.values())
    assert padded < 0.02 * tokens


def test_faster_merges_give_the_tokenizers_ids(tokenizer):
    from fidelscope.llm.tokens import Encoder, tokenizer_path

    encoder = Encoder(tokenizer_path())
    assert encoder.merger is not None
    words = [" don't", " we'll", " ½²", "x=1;y==2", " été", " ქართული", " 日本語", " a͸b", " 😀😀", " naïve", "…", " l'été", " I'M", " 'tis", ""]
    want = [np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert encoder.lines(words) == want and encoder.lines(words[:3]) == want[:3] and encoder.lines(words[5:7]) == want[5:7]
    slow = Encoder(tokenizer_path())
    slow.merger = None
    assert slow.lines(words) == want
