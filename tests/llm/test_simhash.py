"""SimHash: fingerprints and components against brute force."""

from __future__ import annotations

import random

import xxhash

from fidelscope.llm import simhash as sh


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def united(n, edges):
    """Smallest index that edges reach from each of n."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in edges:
        x, y = sorted((find(i), find(j)))
        parent[y] = x
    return [find(i) for i in range(n)]


def by_force(bits):
    pairs = ((i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 2)
    return united(len(bits), pairs)


def classes(spark, bits):
    return spark.createDataFrame([(sh.signed(b),) for b in set(bits)], "bits BIGINT")


def components_of(spark, bits):
    place = {sh.signed(b): i for i, b in reversed(list(enumerate(bits)))}
    edges = [(place[r.a], place[r.b]) for r in sh.links(classes(spark, bits)).collect()]
    return united(len(bits), edges + [(i, place[sh.signed(b)]) for i, b in enumerate(bits)])


def test_documents_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"W{i}é" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 400))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    long = " ".join(rnd.choice(words) for _ in range(150_000))
    texts += [None, "", " \n", "one", "One", "one two", "ONE\ttwo", "a b c", "\xa0", "É b c", "é b c", long, long + " end", texts[3]]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, row STRING")
    got = {r.doc_id: r for r in sh.near_duplicates(docs).collect()}
    bits = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{b:016x}" for b in bits]
    assert [got[i].component_id for i in range(len(texts))] == by_force(bits)
    assert len(set(by_force(bits))) < len(set(bits))


def test_links_over_every_split_of_two_bits(spark):
    rnd = random.Random(6)
    bits = []
    for i in range(64):
        for j in range(i, 64):
            base = rnd.getrandbits(64)
            bits += [base, base ^ (1 << i) ^ (1 << j)] if i < j else [base, base ^ (1 << i)]
    bits += [b ^ 0b111 for b in bits[:200]]  # three bits are no link
    assert components_of(spark, bits) == by_force(bits)


def test_crowded_buckets(spark):
    """One segment shared by far more fingerprints than are paired."""
    rnd = random.Random(7)
    bits = [0]
    for _ in range(400):
        side = rnd.choice((0, 32))
        flips = (1 << side + rnd.randrange(32)) | (1 << rnd.choice((0, 32)) + rnd.randrange(32))
        bits.append(rnd.choice(bits) ^ flips)
    high = rnd.getrandbits(32) << 32
    bits += [high | rnd.getrandbits(32) for _ in range(300)]
    bits = list(dict.fromkeys(bits))
    assert components_of(spark, bits) == by_force(bits)
    index = sh.variants(classes(spark, bits))
    assert index.groupBy("slot", "key").count().where(f"count > {sh.PAIRED}").count() > 0


def test_odd_tables(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1)
    got = sorted(((r.doc_id or 0, r.component_id) for r in sh.near_duplicates(docs).collect()))
    assert got == [(0, 3), (0, 7), (3, 3), (3, 3), (7, 7)]
    assert sh.near_duplicates(docs.limit(0)).count() == 0
