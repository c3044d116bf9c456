"""Repetition inside a text by suffix arrays, and simple quality counts (operator 8).

The words of a text are numbered and its suffixes sorted by prefix doubling, a few texts at a time
in one array.  Longest common prefixes of neighbours give, for each place, the longest substring
that also starts elsewhere in the text: the union of these spans is limited, and their length.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelscope.llm.common import map_texts, slices, text_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: A repeat counts from this many words on; so much of a text may be repeats, so long may one be.
REPEAT_WORDS, MAX_COVERED_PERCENT, MAX_REPEAT_WORDS = 10, 15, 100
#: The plain rules: at least so many words, and at most so many percent in repeated windows.
MIN_WORDS, WINDOW_WORDS, MAX_WINDOW_PERCENT = 10, 5, 20
SCHEMA = (
    "doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT,"
    " n_repeat_words BIGINT, covered_words BIGINT, longest_repeat BIGINT"
)


def longest_repeats(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring from there that is found in its text again.

    ``ids`` are the words of several texts in a row, ``text`` the number of each word's text.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    keys = text.astype(np.int64) * (int(ids.max()) + 1) + ids
    # Ranks are 1 + the number of smaller suffixes; 0 stands behind the last word of all.
    order = np.argsort(keys, kind="stable")
    levels = [ranks_of(keys[order], order, np.ones(n, np.int64), n)]
    places = order
    step = 1
    while True:
        rank = levels[-1]
        in_order = rank[places]
        tied = np.zeros(len(places), bool)
        same = in_order[1:] == in_order[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        places = places[tied]
        if not len(places):
            break
        # Behind the end of a text stands another text: no two suffixes of one text end alike.
        key = rank[places] * (n + 1) + rank[np.minimum(places + step, n)]
        places = places[np.argsort(key, kind="stable")]
        key = rank[places] * (n + 1) + rank[np.minimum(places + step, n)]
        finer = rank.copy()
        first = np.r_[True, key[1:] != key[:-1]]
        group = np.r_[True, rank[places][1:] != rank[places][:-1]]
        at = np.arange(len(places))
        start = np.maximum.accumulate(np.where(first, at, 0))
        finer[places] = rank[places] + start - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(finer)
        step *= 2
    order = np.empty(n, np.int64)
    order[levels[-1][:n] - 1] = np.arange(n)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank, length = levels[level], 1 << level
        equal = (rank[left] == rank[right]) & (left < n) & (right < n)
        common[equal] += length
        left[equal] = np.minimum(left[equal] + length, n)
        right[equal] = np.minimum(right[equal] + length, n)
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def ranks_of(sorted_keys: np.ndarray, order: np.ndarray, base: np.ndarray, n: int) -> np.ndarray:
    first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = base + np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return rank


def covered(longest: np.ndarray, least: int, starts: np.ndarray) -> np.ndarray:
    """Words of each text in the union of its repeats of at least ``least`` words."""
    n = len(longest)
    long = longest >= least
    ends = np.bincount(np.flatnonzero(long) + longest[long], minlength=n + 1)
    depth = np.cumsum(long - ends[:n]) if n else np.zeros(0, np.int64)
    return sums(depth > 0, starts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring ``starts`` (n + 1 of them)."""
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[starts[1:]] - total[starts[:-1]]


def maxima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    found = np.zeros(len(starts) - 1, np.int64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        found[full] = np.maximum.reduceat(values, starts[full])
    return found


def measure_texts(texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Counts of SCHEMA behind doc_id for some texts, also given as UTF-8 bytes."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = [t.encode().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, int(lengths.sum()))
    starts = np.append(0, np.cumsum(lengths))
    longest = longest_repeats(ids, np.repeat(np.arange(len(texts)), lengths))
    lines = [[line for line in t.split("\n") if line.strip(SPACES)] for t in texts]
    character = np.zeros(256, np.int64)
    character[:0x80], character[0xC0:] = 1, 1
    character[list(SPACES.encode())] = 0
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    return [
        lengths, sums(character[data], offsets), sums(symbol[data], offsets),
        np.array([len(x) - len(set(x)) for x in lines], np.int64),
        covered(longest, WINDOW_WORDS, starts), covered(longest, REPEAT_WORDS, starts),
        maxima(longest, starts),
    ]


def measure(docs: DataFrame) -> DataFrame:
    """Counts of every text: words, their characters, symbols, repeated lines, repeated words.

    ``covered_words`` are the words in substrings of at least 10 words that stand in the text
    twice, ``longest_repeat`` is the longest such substring in words, of any length.  A null
    text has no words.  Repeated rows are measured one by one; an empty table gives no rows.
    """

    def run(batches):
        for batch, _ in slices(batches, "text", 1 << 20):
            column = batch.column("text")
            data, offsets = text_bytes(column)
            found = measure_texts([t or "" for t in column.to_pylist()], data, offsets)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], names)

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_WINDOW_PERCENT
    )


def repetitive() -> Column:
    """The method's own verdict: repeats cover too much, or one of them is too long."""
    return (F.col("covered_words") * 100 > F.col("n_words") * MAX_COVERED_PERCENT) | (
        F.col("longest_repeat") > MAX_REPEAT_WORDS
    )


def judge(docs: DataFrame) -> DataFrame:
    """``measure`` with ``base_failed`` and ``kept``."""
    return measure(docs).withColumns(
        {"base_failed": base_failed(), "kept": ~base_failed() & ~repetitive()}
    )
