"""Near duplicates: hashing, densification, components, and links by brute force."""

from __future__ import annotations

import random

import numpy as np

from fidelscope.llm import near_dedup as nd


def by_force(texts, shingle, percent):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        n = min(shingle, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def made_texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: [rnd.choice(words) for _ in range(n)]
    texts = [" ".join(prose(rnd.randint(0, 120))) for _ in range(40)]
    for base in (prose(150), prose(60)):
        for _ in range(60):
            copy = list(base)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    chain = prose(100)
    for step in range(25):
        chain = [*chain[2:], *prose(2)]
        texts.append("\t".join(chain))
    return texts + [None, "", " \n", "One", "one", "one two", "ONE  two", "é é", "É é", texts[50].upper(), texts[50]]


def test_links_and_components_against_brute_force(spark):
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, row STRING")
    for shingle, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs, shingle, percent).collect()}
        assert [got[i] for i in range(len(texts))] == by_force(texts, shingle, percent)


def test_one_of_each_group_stays(spark):
    rows = [(2, "a b c d"), (1, "a b c d"), (None, "A b c d"), (5, "x"), (5, "x"), (None, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1)
    kept = nd.drop_near_copies(docs)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, "a b c d"), (5, "x"), (6, "")]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 200), (200, 203)]
    found = {r.rep: r.component for r in nd.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 203: 200, 205: 200}


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    for size, shared in ((2000, 1700), (40, 34), (12, 11)):
        agree = []
        for _ in range(60):
            a = rng.integers(0, 1 << 64, size, dtype=np.uint64)
            b = np.r_[a[:shared], rng.integers(0, 1 << 64, size - shared, dtype=np.uint64)]
            agree.append((nd.signature(np.unique(a)) == nd.signature(np.unique(b))).mean())
        assert abs(np.mean(agree) - shared / (2 * size - shared)) < 0.05


def test_very_small_and_single_sets():
    one = np.array([5], np.uint64)
    assert (nd.signature(one) == 5).all()
    assert len(set(nd.band_keys(one).tolist())) == nd.BANDS


def template_texts(n, seed=11):
    """Texts of one template, each with a few words of its own: far more unlinked pairs than links."""
    rnd = random.Random(seed)
    words = [f"v{i}" for i in range(60)]
    base = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rnd.choice([2, 2, 3, 3, 4])):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        texts.append(" ".join(copy))
    return texts


def test_rare_shingles_find_every_link_of_a_template(spark):
    texts = [" ".join(f"t{i}" for i in range(60)), *template_texts(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in by_force(texts, 3, 85)]


def test_pairs_of_a_template_do_not_grow_with_its_square(spark):
    counts = []
    for n in (500, 2000):
        found = [np.unique(s) for s in nd.Shingler(3).sets(sorted(set(template_texts(n))))]
        sets = spark.createDataFrame(
            [(i, i, len(s), s.tobytes()) for i, s in enumerate(found)],
            "rep BIGINT, component BIGINT, n_shingles BIGINT, shingles BINARY")
        members = sets.select("rep", "component")
        pairs = {tuple(r) for r in nd.rare_pairs(members, sets.drop("component"), 85).collect()}
        counts.append(len(pairs))
        if n == 500:
            similar = {(i, j) for j in range(len(found)) for i in range(j)
                       if 100 * len(np.intersect1d(found[i], found[j])) >= 85 * len(np.union1d(found[i], found[j]))}
            assert similar and similar <= pairs
    # Every set is a component of its own here, so links themselves grow with the square; others do not.
    print(counts)
    assert counts[1] < 2000 * 2000 / 2 / 20


def test_hot_keys_are_split_off_without_an_anti_join(spark):
    from fidelscope.llm.common import join_by_key

    rows = spark.createDataFrame([(k % 40 if k % 2 else 7, k) for k in range(400)] + [(None, 400), (99, 401)], "key BIGINT, v BIGINT")
    groups = spark.createDataFrame([(k, 200 if k == 7 else 1, k * 10) for k in range(40)] + [(None, 300, 5)], "key BIGINT, n BIGINT, g BIGINT")
    for total in (402, 200_001):  # key 7 is hot by the first, none by the second
        for how in ("inner", "left"):
            found = join_by_key(rows, groups, "key", "n", total, how)
            assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
            want = rows.join(groups, "key", how)
            assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_a_bucket_of_one_component_is_not_read_again(spark):
    members = spark.createDataFrame([(k, r, 5, 3) for k, r in ((1, 1), (1, 2), (2, 2), (2, 3), (3, 4), (3, 5))],
                                    "key BIGINT, rep BIGINT, n_shingles BIGINT, degree BIGINT")
    first = nd.open_members(members, None)
    assert first.count() == 6
    parts = spark.createDataFrame([(1, 1), (2, 1), (4, 4), (5, 4)], "rep BIGINT, component BIGINT")
    rest = nd.open_members(first, parts)
    assert sorted((r.key, r.rep, r.component) for r in rest.collect()) == [(2, 2, 1), (2, 3, 3)]
    done = spark.createDataFrame([(2, 1), (3, 1)], "rep BIGINT, component BIGINT")
    assert nd.open_members(rest, done).count() == 0
