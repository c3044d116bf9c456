"""URL filter: rules, and the models against a plain dictionary version."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from fidelscope.llm import url_filter as uf


def test_host_path_and_longest_rule(spark):
    cases = {
        "HTTP://A.Example.NET:80/en/x?q#f": ("a.example.net:80", "/en/x", None),
        "https://example.net/en/": ("example.net", "/en/", "example.net/en/"),
        "https://www.example.net/fr/": ("www.example.net", "/fr/", "net/"),
        "x://net": ("net", "", None), "x://net/": ("net", "/", "net/"), "x://ananet/": ("ananet", "/", None),
        "https://m.example.com/de/1#t": ("m.example.com", "/de/1", "example.com/de/"),
        "https://example.org/fr/a://b": ("example.org", "/fr/a://b", "org/fr/"),
        "no scheme": ("", "", None), "": ("", "", None), None: ("", "", None), "://?x": ("", "", None),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)]
    got = uf.judge(spark.createDataFrame(rows, "page_id INT, url STRING, rule STRING")).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in got} == dict(enumerate(cases.values()))
    assert all(r.verdict in ("allow", "block") for r in got)


def plain_scores(trains, urls):
    """Witten-Bell by dictionaries."""
    counts = {c: defaultdict(Counter) for c in uf.CLASSES}
    for url, label in trains:
        padded = uf.START * uf.ORDER + url
        for i in range(len(url)):
            for k in range(uf.ORDER + 1):
                counts[label][padded[i + uf.ORDER - k : i + uf.ORDER]][padded[i + uf.ORDER]] += 1

    def p(label, context, char):
        base = p(label, context[1:], char) if context else 1 / uf.ALPHABET
        seen = counts[label][context]
        n, kinds = sum(seen.values()), len(seen)
        return (seen[char] + kinds * base) / (n + kinds) if n else base

    # The empty context is asked last: one letter more than there are orders.
    def score(url):
        padded = uf.START * uf.ORDER + url
        logs = [math.log(p("allow", padded[i : i + uf.ORDER], url[i]) / p("block", padded[i : i + uf.ORDER], url[i]))
                for i in range(len(url))]
        return sum(logs) / len(logs) if logs else 0.0

    return [score(u) for u in urls]


def test_models_against_dictionaries(spark):
    rnd = random.Random(2)
    urls = [
        f"http{rnd.choice(['', 's'])}://{rnd.choice(['www.', 'm.', ''])}{rnd.choice(['abc', 'abd', 'spam', 'é'])}."
        f"{rnd.choice(['example.net', 'example.com', 'example.org'])}/{rnd.choice(['en', 'de', 'fr'])}/{rnd.randrange(50)}"
        for _ in range(300)
    ] + ["", "zzz"]
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(list(enumerate(urls)), "page_id INT, url STRING")).collect()}
    labels = {i: dict((n + p, v) for n, p, v in uf.RULES).get(r.rule) for i, r in got.items()}
    trains = [(u, labels[i]) for i, u in enumerate(urls) if labels[i] and zlib.crc32(u.encode()) % uf.CALIBRATION]
    for i, want in enumerate(plain_scores(trains, urls)):
        assert got[i].score == pytest.approx(want, abs=1e-6), urls[i]
    by_model = [(r.score, r.verdict) for i, r in got.items() if not labels[i]]
    assert max((s for s, v in by_model if v == "block"), default=-9) < min((s for s, v in by_model if v == "allow"), default=9)


def test_empty_table_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id INT, url STRING")
    assert uf.judge(pages).count() == 3
    assert uf.judge(pages.limit(0)).count() == 0
