"""The conversation trie against brute force over dictionaries."""

from __future__ import annotations

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from fidelscope.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_force(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    plain = {c: [(r, t) for _, r, t in sorted(found)] for c, found in turns.items()}
    built = {}
    for c, own in plain.items():
        h = crc32(str(c).encode()) % 9
        built[c] = tuple(plain.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in sorted(built.items()):
        for depth in range(len(path) + 1):
            members[path[:depth]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, found in members.items():
        value = (len(found) - 1) * len(path[-1][1].encode()) if path else 0
        for depth in range(len(path) + 1):
            saved[path[:depth]] += value
            leaves[path[:depth]] += not children[path]
    return sorted(
        (found[0], len(path), members[path[:-1]][0] if path else -1, len(found), children[path], leaves[path], saved[path],
         sha256(",".join(str(c) for c in found if built[c] == path).encode()).hexdigest())
        for path, found in members.items()
    )


def made_rows():
    rnd = random.Random(2)
    rows = []
    for conv in [*range(1, 60), 10**12, 10**12 + 3]:
        for turn in range(rnd.randint(1, 14)):
            # Few texts, so that many prefixes are shared.
            rows.append((conv, turn, rnd.choice(["user", "assistant", None]) if turn % 5 == 4 else "user",
                         rnd.choice([f"é{turn}", f"é{turn}", None if turn % 3 else "", f"b{turn}" * 20])))
    rows += [(70, None, "user", "before"), (70, 3, None, None), (70, 3, "user", "tie"), (70, 3, "user", "tie")]
    rows += [(None, 0, "user", "nobody's"), (71, None, None, None)]
    return rows + rows[:5]


def frame(spark, rows):
    named = [(*r, "x") for r in rows]
    return spark.createDataFrame(named, "conv_id BIGINT, turn INT, role STRING, text STRING, `key` STRING")


def rows_of(nodes):
    return sorted(tuple(-1 if v is None else v for v in r) for r in nodes.select(*COLUMNS).collect())


@pytest.mark.parametrize("cells", [None, 1 << 15, 16])
def test_nodes_against_brute_force(spark, cells):
    """A sketch that is far too narrow proves little and changes nothing."""
    rows = made_rows()
    turns, conversations = pt.splice(pt.number_turns(frame(spark, rows)))
    assert rows_of(pt.prefix_trie(turns, conversations, cells)) == by_force(rows)


def test_long_conversations_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "SPAN", 16)
    rnd = random.Random(3)
    rows = [(10, t, "user", rnd.choice("ab")) for t in range(150)]
    rows += [(c, t, r, x) for c in (11, 12, 13, 20) for _, t, r, x in rows[: rnd.randint(60, 150)]]
    rows += [(21, t, "user", rnd.choice("ab")) for t in range(90)]
    assert rows_of(pt.conversation_trie(frame(spark, rows))) == by_force(rows)


def test_sketch_never_estimates_too_little(spark):
    turns, _ = pt.splice(pt.number_turns(frame(spark, made_rows())))
    screened = pt.screen(pt.prefixes(turns), 1 << 15).select("key", "shared").collect()
    counts = defaultdict(int)
    for row in screened:
        counts[row.key] += 1
    assert all(row.shared for row in screened if counts[row.key] > 1)
    assert sum(not row.shared for row in screened) > 0.9 * sum(n == 1 for n in counts.values())


def test_empty_and_turnless(spark):
    assert pt.conversation_trie(frame(spark, []).limit(0)).count() == 0
    # 21 takes the first five turns of 20, which is absent, and has no sixth of its own.
    lone = [(21, 0, "user", "a")]
    assert crc32(b"21") % 9 > 0 and rows_of(pt.conversation_trie(frame(spark, lone))) == by_force(lone)
