"""The analysis of a whole request table against a direct evaluation, request by request."""

import random
from collections import Counter

import pytest

import restated
from fidelscope.plans.analysis import analyze
from fidelscope.sources.reports import write_report
from fidelscope.sources.tables import CHAT_SCHEMA, MESSAGE_SCHEMA, REQUEST_SCHEMA
from fidelscope.operators.model import TextModel

# Normalised spellings, as cleaning leaves them.
MODEL = TextModel(
    (0, 1, 2), ("ሠላም", "ሥድብ", "ጥላቻ"), (1.0, 1.5, 2.0),
    ((1.0, -1.0, -1.0), (-1.0, 0.5, 1.0), (-1.0, 1.0, 0.5)), (0.3, 0.25, 0.1),
)
CHATS = [
    (1, "news", "Channel", "", 101), (2, "talk", "Chat", "", 102), (3, "me", "User", "", None),
    (4, "quiet", "Channel", "", None), (101, None, "Chat", "", None), (102, None, "Chat", "", None),
]


def make_messages():
    rng = random.Random(9)
    words = ["ሰላም", "ስድብ", "ጥላቻ", "ቡና", "መኪና", "latin", "ነው"]

    def text():
        if rng.random() < 0.15:
            return rng.choice([None, "", "😂", "only latin."])
        return " ".join(rng.choice(words) + rng.choice(["", "", "።", "!", "."]) for _ in range(rng.randint(1, 7)))

    rows = []
    for chat, n in ((1, 40), (2, 25), (4, 3)):
        for i in range(n):
            # Chat 1 is hot: one message draws most of the replies.
            parent = rng.choice([None, None, 3, rng.randint(0, i)]) if i else None
            rows.append((chat, i, parent, text() if chat != 4 else rng.choice(["", "😂"])))
    for i in range(60):
        rows.append((rng.choice([101, 102]), 1000 + i, rng.choice([3, 3, rng.randint(0, 30)]), text()))
    return rows


MESSAGES = make_messages()
URLS = [
    ("https://t.me/news", None), ("https://t.me/news", "5"), ("https://t.me/News", "all"),
    ("https://t.me/c/1", "5"), ("https://t.me/talk", "9"), ("https://t.me/talk", "x"),
    ("https://t.me/quiet", None), ("https://t.me/me", None), ("https://t.me/none", None),
    ("https://x.org/news", None), ("t.me/news", None), (None, None),
    ("https://t.me/news?facebook.com/", None),
] + [(f"https://t.me/{c}/{i}", None) for c in ("news", "talk") for i in range(0, 42, 3)]
REQUESTS = [(i, u, limit) for i, (u, limit) in enumerate(URLS)]


def classify(texts):
    kept = [(s, restated.clean(s)) for t in texts for s in restated.sentences(t)]
    kept = [(s, c) for s, c in kept if c]
    labels, known = [], False
    for _, cleaned in kept:
        counts = Counter(w for w in restated.feature_tokens(cleaned) if w in MODEL.terms)
        known = known or bool(counts)
        w = [counts[t] * i for t, i in zip(MODEL.terms, MODEL.idf, strict=True)]
        norm = sum(x * x for x in w) ** 0.5 or 1.0
        scores = [b + sum(x * c for x, c in zip(w, row, strict=True)) / norm
                  for row, b in zip(MODEL.coef, MODEL.intercept, strict=True)]
        labels.append(["normal", "hate", "offensive"][scores.index(max(scores))])
    return [(s, label) for (s, _), label in zip(kept, labels, strict=True)] if known else []


def replies(chat, message):
    found = sorted((m[1], m[3]) for m in MESSAGES if m[0] == chat and m[2] == message and m[3])
    return [t for _, t in reversed(found)]


def comments(chat, message):
    linked = {c[0]: c[4] for c in CHATS if c[2] == "Channel"}.get(chat)
    return (linked and replies(linked, message)) or replies(chat, message)


def expected(url, limit):
    """status, (messages, with comments, comments), classified sentences"""
    nothing = (None, None, None), []
    if not url:
        return "empty_url", *nothing
    if not url.startswith("https://"):
        return "bad_url", *nothing
    if "t.me" not in url:
        return "unroutable", *nothing
    if "facebook" in url:
        return "unsupported_site", *nothing
    path = url.split("t.me/")[1].split("/")
    by_name = {c[1]: c for c in CHATS if c[1]}
    chat = {str(c[0]): c for c in CHATS}.get(path[1]) if path[0] == "c" else by_name.get(path[0].lower())
    if chat is None:
        return "chat_not_found", *nothing
    if chat[2] == "User":
        return "not_a_chat", *nothing
    own = sorted((m for m in MESSAGES if m[0] == chat[0]), key=lambda m: -m[1])
    if len(path) == 2 and path[0] != "c":
        post = int(path[1])
        found = comments(chat[0], post) if any(m[1] == post for m in own) else []
        if not found:
            return "no_comments", *nothing
        labelled = classify(found)
        return "ok" if labelled else "nothing_classified", (None, None, len(found)), labelled
    n = None if limit == "all" else int(limit) if (limit or "").isdigit() else 1000
    heads = [(m[3], comments(chat[0], m[1])) for m in own[:n] if m[3] and m[1]]
    if not heads:
        return "no_content", *nothing
    labelled = classify([t for head, c in heads for t in [head, *c]])
    counters = len(heads), sum(bool(c) for _, c in heads), sum(len(c) for _, c in heads)
    return "ok" if labelled else "nothing_classified", counters, labelled


@pytest.fixture(scope="module")
def result(spark):
    return analyze(
        spark.createDataFrame(REQUESTS, REQUEST_SCHEMA), spark.createDataFrame(CHATS, CHAT_SCHEMA),
        spark.createDataFrame(MESSAGES, MESSAGE_SCHEMA), MODEL,
    )


def test_overview(result):
    rows = {r.request_id: r for r in result.overview.collect()}
    assert len(rows) == len(REQUESTS)
    seen = set()
    for i, url, limit in REQUESTS:
        status, counters, labelled = expected(url, limit)
        r = rows[i]
        seen.add(status)
        assert (r.status, r.messages, r.messages_with_comments, r.comments) == (status, *counters), url
        assert (r.sentences or 0) == len(labelled), url
    assert {"ok", "no_content", "no_comments", "not_a_chat", "chat_not_found"} <= seen


def test_summary_and_samples(result):
    summary = {(r.request_id, r.label): r for r in result.summary.collect()}
    samples = {}
    for r in sorted(result.samples.collect(), key=lambda r: r["rank"]):
        samples.setdefault((r.request_id, r.label), []).append(r.sample)
    for i, url, limit in REQUESTS:
        labelled = expected(url, limit)[2]
        for label in ("hate", "offensive", "normal"):
            mine = [s for s, l in labelled if l == label]
            assert samples.get((i, label), []) == [s[:200] + "..." for s in mine[:3]], url
            if labelled:
                r = summary[i, label]
                assert r["count"] == len(mine), url
                assert r.percentage_text == f"{len(mine) / len(labelled) * 100:.2f}%"
            else:
                assert (i, label) not in summary


def test_report_sink(spark, result, tmp_path):
    write_report(result, str(tmp_path), "json")
    for name in ("overview", "summary", "samples"):
        stored = spark.read.json(str(tmp_path / name))
        assert stored.count() == getattr(result, name).count()
