"""Near-duplicate documents by one-permutation MinHash (operator 2).

One hash of each shingle gives a whole signature: its value range is cut into bins, a bin keeps
its smallest hash, and an empty bin borrows from one chosen by hashing (optimal densification).
Bands of bins put documents into buckets.  A bucket is a star: its best connected member is
compared with all others, on full shingle sets.  Where the confirmed links leave a bucket in more
than one component, a second star starts outside the main one.  What is then still apart is joined
across components by rare shingles: two similar sets have one of their rarest in common, so no
pair that could join two components is left untested, and no bucket is paired up.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelscope.llm.common import join_by_key, map_texts, slices, unused
from fidelscope.session import stage

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: The default of the near-duplicate stages: five words, similarity 0.8.
SHINGLE, PERCENT = 5, 80
#: Rounds of one centre per bucket, before the rest is joined by rare shingles.
STAR_ROUNDS = 2
#: A centre's set is sent to at most so many tasks for so many pairs.
SALTS, PAIRS_PER_SALT = 64, 4_096
WORDS_KEPT = 200_000
BORDERS = np.array([-(-(j << 64) // BINS) for j in range(BINS)], np.uint64)
SIGNED = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODDS = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
#: For each bin, the order in which an empty one asks the others.
BORROW = (mix(np.arange(BINS * 1024, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, 1024)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Sorted distinct shingle hashes of texts; words are cut at ASCII white space, A-Z lowered."""

    def __init__(self, shingle: int):
        self.shingle, self.hashes = shingle, WordHashes()

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.hashes) > WORDS_KEPT:
            self.hashes.clear()
        get = self.hashes.__getitem__
        for text in texts:
            # bytes.lower() changes A-Z only.
            words = (text or "").encode().lower().split()
            h = np.fromiter(map(get, words), np.uint64, len(words))
            n = min(self.shingle, len(h))
            if n == 0:
                yield h
                continue
            total = np.zeros(len(h) - n + 1, np.uint64)
            for i in range(n):
                total += h[i : len(h) - n + 1 + i] * ODDS[i]
            # The length keeps a short text apart from a shingle of full length.
            yield np.unique(mix(total + np.uint64(n)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin; empty bins borrow."""
    at = np.searchsorted(shingles, BORDERS)
    full = np.diff(np.append(at, len(shingles))) > 0
    values = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        tried = full[BORROW[empty]]
        lender = BORROW[empty, tried.argmax(axis=1)]
        lender[~tried.any(axis=1)] = np.flatnonzero(full)[0]
        values[empty] = values[lender]
    return values


def band_keys(shingles: np.ndarray) -> np.ndarray:
    bands = signature(shingles).reshape(BANDS, ROWS) * ODDS[:ROWS]
    return mix(bands.sum(axis=1, dtype=np.uint64) + ODDS[100 : 100 + BANDS]).view(np.int64)


def sketch(docs: DataFrame, shingle: int, row: str) -> DataFrame:
    """``doc_id, row, n_shingles, set_id, bands``; no set and no bands without words."""
    schema = f"doc_id BIGINT, {row} BIGINT, n_shingles BIGINT, set_id BINARY, bands ARRAY<BIGINT>"

    def run(batches):
        shingler = Shingler(shingle)
        for batch, _ in slices(batches, "text", 2 << 20):
            sizes, ids, bands = [], [], []
            for found in shingler.sets(batch.column("text").to_pylist()):
                sizes.append(len(found))
                ids.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                bands.append(band_keys(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column(row), pa.array(sizes, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", row, "n_shingles", "set_id", "bands"],
            )

    return map_texts(docs.select(F.col("doc_id").cast("long"), row, "text"), run, schema)


def shingle_table(docs: DataFrame, shingle: int, row: str) -> DataFrame:
    """``rep, shingles``: the whole set, as bytes."""

    def run(batches):
        shingler = Shingler(shingle)
        for batch, _ in slices(batches, "text", 2 << 20):
            found = [s.tobytes() for s in shingler.sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(row), pa.array(found, pa.binary())], ["rep", "shingles"]
            )

    return map_texts(docs.select(row, "text"), run, "rep BIGINT, shingles BINARY")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough, compared in full.

    Pairs of one centre ``a`` are dealt out by salts, and its set goes along to each salt in use.
    """
    salts = max(SALTS, total // PAIRS_PER_SALT)
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    left = salted.select("a", "salt").distinct().join(
        sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a"
    )
    right = salted.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last, x = None, None
            for i, (a, sa, sb) in enumerate(zip(
                batch.column("a").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True
            )):
                if a != last:
                    last, x = a, np.frombuffer(sa.as_buffer(), np.uint64)
                y = np.frombuffer(sb.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    continue
                place = np.searchsorted(large, small)
                common = int((large[np.minimum(place, len(large) - 1)] == small).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return map_texts(right.join(left, ["a", "salt"]).select("a", "b", "sa", "sb"), run, "a BIGINT, b BIGINT")


def components(edges: DataFrame) -> DataFrame:
    """``rep, component`` for every end of an edge: the smallest id that can be reached.

    Alternates two steps until only stars are left: hang each node's larger neighbours on its
    smallest one, then each node with its smaller neighbours.  Hot nodes are joined by broadcast.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = stage(edges.union(edges.select("v", "u")))
        large = stage(hang(both).where("u > from").select("u", F.col("m").alias("v")).distinct())
        small = hang(large).select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("from").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.*").where("u > v").distinct()
        small = stage(small)
        # Both steps keep what is connected: when all are stars, each is a component.
        if only_stars(small):
            return small.select(F.col("u").alias("rep"), F.col("v").alias("component")).unionByName(
                small.select(F.col("v").alias("rep"), F.col("v").alias("component")).distinct()
            )
        edges = small


def hang(edges: DataFrame) -> DataFrame:
    """For each edge from ``from`` to its neighbour ``u``, the smallest of ``from`` and all neighbours."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    total = edges.count()
    joined = join_by_key(edges, least, "u", "n", total)
    return joined.select(
        F.col("u").alias("from"), F.col("v").alias("u"), F.least("u", "m").alias("m")
    )


def only_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has a single ``v``, and no ``v`` hangs on another node itself."""
    lower, upper = F.lit(0).alias("ends"), F.lit(1).alias("ends")
    nodes = edges.select("u", upper).unionByName(edges.select(F.col("v").alias("u"), lower))
    worst = nodes.groupBy("u").agg(F.sum("ends").alias("up"), F.count_if(F.col("ends") == 0).alias("down"))
    bad = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    return not worst.agg(F.max(bad)).first()[0]


def buckets(reps: DataFrame) -> DataFrame:
    """``key, rep, n_shingles, degree``: members of buckets with more than one.

    The degree of a member is the number of members of all its buckets: the text that others were
    derived from shares most buckets and so has the highest.
    """
    rows = stage(reps.select("rep", "n_shingles", F.explode("bands").alias("key")))
    sizes = stage(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = stage(join_by_key(rows, sizes, "key", "size", rows.count()))
    degrees = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    return stage(members.drop("size").join(degrees, "rep"))


def open_members(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Members with their component, of the buckets that still hold more than one.

    ``outside`` tells those that are not in the component of the bucket's best member.  Without
    ``parts`` every member is a component of its own, and all buckets are open.  Components only grow, so
    a bucket left out stays so: ``members`` may be what an earlier round found open.
    """
    members = members.select("key", "rep", "n_shingles", "degree")
    if parts is None:
        return members.withColumn("component", F.col("rep"))
    members = stage(members.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    best = F.max(F.struct("degree", -F.col("rep"), "component"))
    groups = stage(members.groupBy("key").agg(
        best.alias("best"), F.count("*").alias("size"),
        (F.min("component") < F.max("component")).alias("open"),
    ).where("open").select("key", "size", F.col("best.component").alias("main")))
    return stage(
        join_by_key(members, groups, "key", "size", members.count())
        .withColumn("outside", F.col("component") != F.col("main")).drop("main", "size")
    )


def star_pairs(members: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Pairs of a centre with the members of its bucket in other components, if the sizes allow a link."""
    near = F.least("n_shingles", "n") * 100 >= F.greatest("n_shingles", "n") * percent
    return members.join(centres, "key").where((F.col("component") != F.col("of")) & near).select(
        F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")
    ).distinct()


def explode_sets(sets: DataFrame) -> DataFrame:
    """``rep, component, n_shingles, shingle`` of ``sets`` with those columns and ``shingles``."""
    names = ["rep", "component", "n_shingles"]

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            sizes = [len(x) for x in found]
            columns = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in names]
            columns.append(pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(columns, [*names, "shingle"])

    schema = ", ".join(f"{c} BIGINT" for c in (*names, "shingle"))
    return map_texts(sets.select(*names, "shingles"), run, schema)


def rare_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members in different components that may be similar, by their rarest shingles.

    Each set's shingles are put in one order for all: by the number of components that hold them.
    Two sets of the wanted similarity must then have a shingle in common so early that enough
    shingles follow on both sides.  Only such places are joined; a shingle within one component joins nothing,
    and one that most members share comes last, where too few follow.  Every similar pair is among the result.
    """
    own = stage(members.select("rep", "component").distinct())
    tokens = stage(explode_sets(sets.join(own, "rep")))
    stats = tokens.select("shingle", "component").distinct().groupBy("shingle").agg(
        F.count("*").alias("parts")).where("parts > 1")
    # A shingle that most sets hold is a hot key, whose rows the adaptive skew join splits.
    shared = tokens.join(stats, "shingle")
    ordered = Window.partitionBy("rep").orderBy("parts", "shingle")
    whole = Window.partitionBy("rep")
    # Shingles of one component come before those counted here.
    place = F.col("n_shingles") - F.count("*").over(whole) + F.row_number().over(ordered)
    after = F.col("n_shingles") - F.col("place")
    early = stage(
        shared.withColumn("place", place).where((1 + after) * 100 >= F.col("n_shingles") * percent)
        .select("shingle", "rep", "component", F.col("n_shingles").alias("n"), after.alias("after"))
    )
    main = (
        early.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle")
        .agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
        .select("shingle", F.col("most.component").alias("main"))
    )
    rows = stage(early.join(main, "shingle").withColumn("outside", F.col("component") != F.col("main")).drop("main"))
    left = rows.where("outside").select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("rep", "component", "n", "after")))
    once = ~F.col("outside") | (F.col("rep_a") < F.col("rep"))
    common = 1 + F.least("after", "after_a")
    enough = common * (100 + percent) >= (F.col("n") + F.col("n_a")) * percent
    return left.join(rows, "shingle").where((F.col("component") != F.col("component_a")) & once & enough).select(
        F.least("rep_a", "rep").alias("a"), F.greatest("rep_a", "rep").alias("b")
    ).distinct()


def links(reps: DataFrame, sets_of, percent: int) -> DataFrame:
    """``rep, component`` of all linked representatives.

    ``reps`` has ``rep, n_shingles, bands``; ``sets_of`` gives the shingle sets of some of them.
    In the first rounds each bucket has one centre: the best member of all, then the best one
    outside the main component.  What buckets still hold in several components is then joined
    across them by rare shingles.
    """
    members = buckets(reps)
    sets = stage(sets_of(members.select("rep").distinct()))
    total = reps.count()
    edges = tested = parts = None
    rest = members
    for number in range(STAR_ROUNDS + 1):
        rest = open_members(rest, parts)
        if number < STAR_ROUNDS:
            out = rest.where("outside") if number else rest
            best = F.max(F.struct("degree", (-F.col("rep")).alias("minus"), "component", "n_shingles"))
            centres = out.groupBy("key").agg(best.alias("best")).select(
                "key", (-F.col("best.minus")).alias("a"), F.col("best.component").alias("of"),
                F.col("best.n_shingles").alias("n"))
            pairs = star_pairs(rest, stage(centres), percent)
        else:
            sized = sets.withColumn("n_shingles", F.floor(F.octet_length("shingles") / 8))
            pairs = rare_pairs(rest, sized, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs)
        found = stage(confirm(pairs, sets, percent, total))
        if number == 0 or not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            parts = components(edges)
        tested = pairs if tested is None else tested.unionByName(pairs)
    return parts


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, row, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked when the sets of their ``shingle``-word shingles have
    ``100 * intersection >= percent * union``; a text with fewer words is one shingle, one without
    words (or null) has no set and is linked with nothing.  ``component_id`` is the smallest doc_id
    that links reach, and that document is kept; a null doc_id comes after all others.  Of
    rows repeated with one doc_id one is kept.  ``row`` numbers the rows of the scan, which
    ``docs`` must therefore be.  Equal sets are one class, represented by its smallest doc_id;
    only classes are put into buckets, so groups of copies cost no pairs.

    Similar sets share no bucket at all, and are missed, with a chance below 1e-8 at similarity
    0.85 and 3e-6 at 0.8.  No similar pair that shares a bucket is left out.
    """
    row = unused(docs, "row")
    numbered = docs.select("doc_id", "text").withColumn(row, F.monotonically_increasing_id())
    slim = stage(sketch(numbered, shingle, row))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("rep"), "n_shingles", "bands"))
    classes = stage(
        slim.where("set_id IS NOT NULL").groupBy("set_id")
        .agg(first.alias("f"), F.count("*").alias("size")).select("set_id", "size", "f.*")
    )

    def sets_of(reps: DataFrame) -> DataFrame:
        wanted = reps.select(F.col("rep").alias(row))
        return shingle_table(numbered.join(wanted.hint("merge"), row, "left_semi"), shingle, row)

    parts = links(classes.select("rep", "n_shingles", "bands"), sets_of, percent)
    placed = stage(
        classes.drop("bands", "n_shingles").join(parts, "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    keepers = stage(placed.groupBy("component").agg(
        F.min(F.struct("none", "doc_id", "rep")).alias("keep"), F.count("*").alias("n")
    ).select("component", "n", F.col("keep.doc_id").alias("component_id"), F.col("keep.rep").alias("keep_row")))
    by_class = stage(
        join_by_key(placed.select("set_id", "size", "component"), keepers, "component", "n", placed.count())
        .select("set_id", "size", "component_id", "keep_row")
    )
    with_set = join_by_key(slim.where("set_id IS NOT NULL").drop("bands"), by_class, "set_id", "size", slim.count())
    alone = slim.where("set_id IS NULL").select(
        "doc_id", row, "n_shingles", F.col("doc_id").alias("component_id"), F.col(row).alias("keep_row"))
    return with_set.select(*alone.columns).unionByName(alone).select(
        "doc_id", F.col(row).alias("row"), "n_shingles", "component_id",
        (F.col(row) == F.col("keep_row")).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, a plain scan, that stay, with all their columns.

    Rows with a null or empty text, or one without words, all stay; of rows repeated whole one does.
    """
    row = unused(docs, "row")
    kept = near_duplicates(docs, shingle, percent).where("kept").select(F.col("row").alias(row))
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
